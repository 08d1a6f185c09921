"""A study made from the order tables: customers as members, order totals as weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.cohort import Rules
from .extracts import Study

#: Market segments play the member types, brands the module titles.
RULES = Rules(
    treated="MACHINERY",
    reference="BUILDING",
    core=r"^Brand#(1[1-5])$",
    core_titles=5,
    domains=(("mindset", r"^Brand#(2[1-5])$", 5), ("nutrition", r"^Brand#(3[1-5])$", 5), ("physical_activity", r"^Brand#(4[1-5])$", 5)),
)

# The same text runs in Spark and in DuckDB.
DEMOGRAPHICS = """
select cast(c_custkey as string) as member_id,
       case when c_custkey % 40 = 0 then 'PAUSED' when c_custkey % 40 = 1 then ' active ' when c_custkey % 3 = 0 then 'FINISHED' else 'ACTIVE' end as subscription_status,
       case when c_custkey % 50 = 7 then null when c_nationkey % 2 = 0 then 'FEMALE' else 'MALE' end as sex,
       case when c_custkey % 30 = 9 then '  ' when c_nationkey < 12 then 'GROUP A' when c_nationkey < 20 then 'GROUP B' else 'GROUP C' end as ethnicity
from customer"""

_FIRST_LAST = """
select o_custkey,
       min(o_orderdate) as first_weight_at, max(o_orderdate) as last_weight_at,
       min_by(o_totalprice, %PAIR%(o_orderdate, o_orderkey)) as first_weight, max_by(o_totalprice, %PAIR%(o_orderdate, o_orderkey)) as last_weight
from orders group by o_custkey"""

WEIGHTS = f"""
select cast(o_custkey as string) as member_id, c_mktsegment as member_type, first_weight_at, last_weight_at, first_weight, last_weight,
       first_weight - last_weight as weight_difference,
       cast(days_between as double) as weight_days, cast(days_between + o_custkey % 9 as double) as tenure_days
from (select f.*, c_mktsegment, %DAYS% as days_between from ({_FIRST_LAST}) f join customer on c_custkey = o_custkey where o_custkey % 25 <> 3) w"""

ENGAGEMENT = """
select cast(o_custkey as string) as member_id, l_shipdate as activity_at, l_returnflag || '_' || l_linestatus as event_type
from lineitem join orders on l_orderkey = o_orderkey"""

MODULES = """
select cast(o_custkey as string) as member_id, p_brand as questionnaire_title, l_shipdate as answered_at
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"""

_SPARK_DAYS = "datediff(last_weight_at, first_weight_at)"
_DUCK_DAYS = "date_diff('day', first_weight_at, last_weight_at)"


def duck_views() -> str:
    """The views as a WITH list for DuckDB."""
    own = {"v_demographics": DEMOGRAPHICS, "v_weights": WEIGHTS.replace("%DAYS%", _DUCK_DAYS).replace("%PAIR%", "row"), "v_engagement": ENGAGEMENT, "v_modules": MODULES}
    return ", ".join(f"{name} as ({sql})" for name, sql in own.items())


def order_study(spark: SparkSession, sf_dir: str) -> Study:
    """The study of a folder's order tables, as lazy DataFrames."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def view(sql: str, *names: str) -> DataFrame:
        for n in names:
            sql = sql.replace(f"from {n}", f"from {{{n}}}").replace(f"join {n}", f"join {{{n}}}")
        return spark.sql(sql, **{n: table(n) for n in names})

    return Study(
        view(DEMOGRAPHICS, "customer"),
        view(WEIGHTS.replace("%DAYS%", _SPARK_DAYS).replace("%PAIR%", "struct"), "customer", "orders"),
        view(ENGAGEMENT, "lineitem", "orders"),
        view(MODULES, "lineitem", "orders", "part"),
    )

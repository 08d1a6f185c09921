"""Registry of the engine's queries over the order study, and the DuckDB SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import adjust_p, equal_count_bins
from ..operators import cohort as c
from ..operators import describe as d
from ..operators import features as f
from ..operators.quality import key_quality
from ..sources.extracts import Study
from ..sources.views import RULES, duck_views, order_study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

STRICT = c.Rules(**{**RULES.__dict__, "repeatable_ratio": 6.72})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: the order of sums must not show."""
    return df.select(*[F.round(x, digits).alias(x) if t == "double" else F.col(x) for x, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def register(make: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(make(order_study(spark, sf_dir)))
        if sql is not None:
            ORACLE_SQL[name] = f"with {PREFIX} {sql}"
        return make

    return register


_STATUS = r"upper(regexp_replace(subscription_status, '^\s+|\s+$', '', 'g'))"
_KINDS = f"('{RULES.treated}', '{RULES.reference}')"

_STAGED = f"""staged as (
  select d.*, w.* exclude (member_id), w.member_id is not null as has_weights,
    case when w.member_id is null then 1
         when not coalesce({_STATUS} in ('ACTIVE', 'FINISHED'), false) then 2
         when first_weight is null or last_weight is null then 3
         when not (first_weight > 0 and last_weight > 0) then 4
         when weight_days is null then 5
         when not weight_days > 0 then 6
         when not coalesce(member_type in {_KINDS}, false) then 7 else 0 end as stage
  from v_demographics d left join v_weights w on d.member_id = w.member_id)"""

_COHORT = f"""cohort as (
  select member_id, {_STATUS} as subscription_status, sex, ethnicity, member_type, first_weight_at, last_weight_at, first_weight, last_weight, weight_days, tenure_days,
    first_weight - last_weight as absolute_weight_loss, 100.0::double * (first_weight - last_weight) / first_weight as percentage_loss,
    100.0::double * (first_weight - last_weight) / first_weight >= 5.0 as weight_loss_success
  from staged where stage = 0)"""


def _types(ratio: float) -> str:
    return f"""types as (
  select event_type, events, distinct_members, events::double / distinct_members as events_per_member,
    events::double / distinct_members >= {ratio} and distinct_members >= 30 as is_repeatable
  from (select event_type, count(*) as events, count(distinct member_id) as distinct_members from v_engagement group by event_type) t)"""


_COUNTS = """counts as (
  select e.member_id, e.event_type, count(*) as event_count, any_value(is_repeatable) as is_repeatable
  from v_engagement e join cohort k on e.member_id = k.member_id join types t on t.event_type = e.event_type
  where activity_at <= last_weight_at group by e.member_id, e.event_type)"""

_CASES = " ".join(f"when regexp_matches(questionnaire_title, '{p}') then '{n}'" for n, p, _ in RULES.module_domains)
_TITLES = f"""titles as (
  select member_id, questionnaire_title, case {_CASES} end as domain from (
    select distinct m.member_id, questionnaire_title from v_modules m join cohort k on m.member_id = k.member_id where answered_at <= last_weight_at) t)"""

_NAMES = [n for n, _, _ in RULES.module_domains]
_FEATURES = f"""features as (
  select k.*, coalesce(breadth, 0)::bigint as engagement_breadth, coalesce(volume, 0)::bigint as engagement_volume_repeatable,
    coalesce(volume, 0)::double / greatest(tenure_days, 7.0) as engagement_volume_repeatable_rate,
    {', '.join(f'coalesce({n}, 0)::bigint as module_{n}_count' for n in _NAMES)},
    {', '.join(f'coalesce({n}, 0)::double / {t} as module_{n}' for n, _, t in RULES.module_domains)},
    ({' + '.join(f'coalesce({n}, 0)::double / {t}' for n, _, t in RULES.module_domains)}) / 4 as module_mean
  from cohort k
  left join (select member_id, count(*) as breadth, sum(case when is_repeatable then event_count else 0 end) as volume from counts group by member_id) e on e.member_id = k.member_id
  left join (select member_id, {', '.join(f"count(*) filter (domain = '{n}') as {n}" for n in _NAMES)} from titles group by member_id) m on m.member_id = k.member_id)"""

_SCOPED = f"""(select 1 as scope_order, 'Overall' as scope, * from %T% union all
  select case when member_type = '{RULES.treated}' then 2 else 3 end, member_type, * from %T%)"""

PREFIX = ", ".join([duck_views(), _STAGED, _COHORT, _types(RULES.repeatable_ratio), _COUNTS, _TITLES, _FEATURES])


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) as {name}"


def _summary(v: str) -> str:
    stats = {"mean": f"avg({v})", "standard_deviation": f"stddev_samp({v})", "median": f"quantile_cont({v}, 0.5)", "q1": f"quantile_cont({v}, 0.25)", "q3": f"quantile_cont({v}, 0.75)", "minimum": f"min({v})", "maximum": f"max({v})"}
    return f"count(*) as n_total, count({v}) as n_observed, count(*) - count({v}) as n_missing, " + ", ".join(_r(e, n) for n, e in stats.items())


def _tall(source: str, values: list[str], name: str, order: str) -> str:
    return " union all ".join(f"select scope_order, scope, {k} as {order}, '{v}' as {name}, {v}::double as value from {source}" for k, v in enumerate(values, 1))


_SCOPED_FEATURES = _SCOPED.replace("%T%", "features")
_SCOPED_COHORT = _SCOPED.replace("%T%", "cohort")
_OUTCOMES = ["first_weight", "last_weight", "absolute_weight_loss", "percentage_loss", "weight_days"]
_Z = "1.959963984540054"
_WILSON_P, _WILSON_N = "(numerator::double / n_observed)", "n_observed::double"
_MIDDLE = f"(({_WILSON_P} + {_Z} * {_Z} / (2 * {_WILSON_N})) / (1 + {_Z} * {_Z} / {_WILSON_N}))"
_HALF = f"({_Z} * sqrt({_WILSON_P} * (1 - {_WILSON_P}) / {_WILSON_N} + {_Z} * {_Z} / (4 * {_WILSON_N} * {_WILSON_N})) / (1 + {_Z} * {_Z} / {_WILSON_N}))"


@query("q01_outcomes_by_member_type", f""", scoped as {_SCOPED_COHORT}, flat as ({_tall('scoped', _OUTCOMES, 'outcome', 'outcome_order')})
select scope_order, scope, outcome_order, outcome, {_summary('value')}, null::double as numerator, null::double as denominator, null::double as percentage, null::double as ci_lower, null::double as ci_upper
from flat group by all
union all
select scope_order, scope, 6, 'weight_loss_success', n_total, n_observed, n_total - n_observed, null, null, null, null, null, null, null, numerator::double, n_observed::double,
  round(100.0::double * numerator / n_observed, 6), round(100 * greatest(0, {_MIDDLE} - {_HALF}), 6), round(100 * least(1, {_MIDDLE} + {_HALF}), 6)
from (select scope_order, scope, count(*) as n_total, count(weight_loss_success) as n_observed, count(*) filter (weight_loss_success) as numerator from scoped group by all) t""")
def _(s: Study) -> DataFrame:
    return d.outcomes(c.members(s, RULES), RULES)


@query("q02_cohort_funnel_stage_counts", "select g::int as stage, count(stage) as n from range(8) r(g) left join staged on stage = g group by g")
def _(s: Study) -> DataFrame:
    return c.stage_counts(s, RULES)


_LABELS = "['enrolled', " + ", ".join(f"'{x}'" for x in c.STAGES) + "]"


@query("q03_cohort_flow", f""", t as (select g::int as stage, count(stage) as n from range(8) r(g) left join staged on stage = g group by g),
u as (select stage as flow_order, case when stage = 0 then 0 else n end as excluded_n, sum(n) over () as enrolled, sum(case when stage = 0 then 0 else n end) over (order by stage) as gone from t)
select flow_order, {_LABELS}[flow_order + 1] as stage_id, (enrolled - gone + excluded_n)::bigint as starting_n, excluded_n::bigint as excluded_n, (enrolled - gone)::bigint as retained_n, {_r('100.0::double * (enrolled - gone) / enrolled', 'percent_of_enrolled')} from u""")
def _(s: Study) -> DataFrame:
    return c.cohort_flow(s, RULES)


@query("q04_orphan_weight_rows", "select w.member_id, w.member_type, round(w.first_weight, 6) as first_weight from v_weights w where not exists (select 1 from v_demographics d where d.member_id = w.member_id and d.subscription_status <> 'PAUSED')")
def _(s: Study) -> DataFrame:
    # nobody is an orphan in the order tables, so the paused are left out of the frame
    active = s.demographics.where("subscription_status <> 'PAUSED'")
    return c.orphan_weights(Study(active, s.weights, s.engagement, s.modules)).select("member_id", "member_type", "first_weight")


@query("q05_excluded_type_audit", "select member_type, count(*) as n from staged where stage = 7 group by member_type")
def _(s: Study) -> DataFrame:
    return c.excluded_types(s, RULES)


@query("q06_key_quality", r"""select coalesce(sum(n), 0)::bigint as n_rows, coalesce(sum(n) filter (k is null), 0)::bigint as n_null, coalesce(sum(n) filter (trim(k) = ''), 0)::bigint as n_blank,
coalesce(sum(n) filter (regexp_replace(k, '^\s+|\s+$', '', 'g') <> k), 0)::bigint as n_untrimmed, coalesce(sum(n) filter (n > 1 and k is not null), 0)::bigint as n_duplicated
from (select subscription_status as k, count(*) as n from v_demographics group by 1) t""")
def _(s: Study) -> DataFrame:
    return key_quality(s.demographics, "subscription_status")


@query("q07_long_weights", """select member_id, member_type, 0 as time, 'first' as occasion, cast(first_weight_at as varchar) as measurement_at, round(first_weight, 6) as weight from cohort
union all select member_id, member_type, 1, 'last', cast(last_weight_at as varchar), round(last_weight, 6) from cohort""")
def _(s: Study) -> DataFrame:
    return c.long_weights(c.members(s, RULES)).withColumn("measurement_at", F.col("measurement_at").cast("string"))


@query("q08_repeatable_event_classification", f", {_types(6.72).replace('types as', 'strict as')} select event_type, events, distinct_members, {_r('events_per_member', 'events_per_member')}, is_repeatable from strict")
def _(s: Study) -> DataFrame:
    return f.classify_events(s.engagement, STRICT)


@query("q09_engagement_cutoff_audit", """select (select count(*) from v_engagement) as source_rows, count(*) as cohort_rows, count(*) filter (activity_at <= last_weight_at) as kept_rows,
count(*) filter (activity_at > last_weight_at) as late_rows, count(*) filter (activity_at is null or last_weight_at is null) as undated_rows
from v_engagement e join cohort k on e.member_id = k.member_id""")
def _(s: Study) -> DataFrame:
    return f.cutoff_audit(s.engagement, c.members(s, RULES), "activity_at")


@query("q10_sparse_member_event_counts", "select * from counts")
def _(s: Study) -> DataFrame:
    return f.event_counts(s.engagement, c.members(s, RULES), RULES)


@query("q11_member_engagement_features", f"select member_id, engagement_breadth, engagement_volume_repeatable, {_r('engagement_volume_repeatable_rate', 'engagement_volume_repeatable_rate')} from features")
def _(s: Study) -> DataFrame:
    k = c.members(s, RULES)
    return f.engagement_features(k, f.event_counts(s.engagement, k, RULES), RULES).select("member_id", "engagement_breadth", "engagement_volume_repeatable", "engagement_volume_repeatable_rate")


@query("q12_module_domain_classification", "select member_id, questionnaire_title, domain from titles")
def _(s: Study) -> DataFrame:
    return f.kept_modules(s.modules, c.members(s, RULES), RULES)


@query("q13_module_pivot_counts", f"select member_id, {', '.join(f'module_{n}_count' for n in _NAMES)} from features")
def _(s: Study) -> DataFrame:
    k = c.members(s, RULES)
    return f.module_features(k, f.kept_modules(s.modules, k, RULES), RULES).select("member_id", *[f"module_{n}_count" for n in _NAMES])


@query("q14_module_proportions", f"select member_id, {', '.join(_r(f'module_{n}', f'module_{n}') for n in _NAMES)}, {_r('module_mean', 'module_mean')} from features")
def _(s: Study) -> DataFrame:
    k = c.members(s, RULES)
    return f.module_features(k, f.kept_modules(s.modules, k, RULES), RULES).select("member_id", *[f"module_{n}" for n in _NAMES], "module_mean")


def features_of(s: Study) -> DataFrame:
    return f.member_features(s.engagement, s.modules, c.members(s, RULES).persist(), RULES)


_DOUBLES = ["first_weight", "last_weight", "weight_days", "tenure_days", "absolute_weight_loss", "percentage_loss", "engagement_volume_repeatable_rate", *[f"module_{n}" for n in _NAMES], "module_mean"]


@query("q15_member_features", f"select * replace (cast(first_weight_at as varchar) as first_weight_at, cast(last_weight_at as varchar) as last_weight_at, {', '.join(_r(x, x) for x in _DOUBLES)}) from features")
def _(s: Study) -> DataFrame:
    return features_of(s).drop("weight_difference").withColumns({x: F.col(x).cast("string") for x in ("first_weight_at", "last_weight_at")})


@query("q16_dense_member_event_counts", "select k.member_id, t.event_type, coalesce(event_count, 0)::bigint as event_count from cohort k cross join types t left join counts n on n.member_id = k.member_id and n.event_type = t.event_type")
def _(s: Study) -> DataFrame:
    k = c.members(s, RULES)
    return f.dense_counts(k, f.event_counts(s.engagement, k, RULES), f.classify_events(s.engagement, RULES))


@query("q17_sample_characteristics", f""", scoped as {_SCOPED_COHORT}, flat as (
  select scope_order, scope, 1 as characteristic_order, 'member_type' as characteristic, coalesce(nullif(trim(member_type), ''), 'Missing') as level from scoped where scope_order = 1
  union all select scope_order, scope, 2, 'sex', coalesce(nullif(trim(sex), ''), 'Missing') from scoped
  union all select scope_order, scope, 3, 'ethnicity', coalesce(nullif(trim(ethnicity), ''), 'Missing') from scoped),
n as (select scope_order, scope, characteristic_order, characteristic, level, count(*) as count from flat group by all),
spine as (select a.scope_order, a.scope, a.characteristic_order, b.characteristic, b.level from (select distinct scope_order, scope, characteristic_order from n) a join (select * from n where scope_order = 1) b on a.characteristic_order = b.characteristic_order),
whole as (select s.*, coalesce(count, 0)::bigint as count from spine s left join n on n.scope_order = s.scope_order and n.characteristic_order = s.characteristic_order and n.level = s.level),
t as (select *, (sum(count) over w)::bigint as n_total, (sum(case when level = 'Missing' then count else 0 end) over w)::bigint as n_missing from whole window w as (partition by scope_order, characteristic_order))
select scope_order, scope, characteristic_order, characteristic, level, n_total, n_total - n_missing as n_observed, n_missing, count,
  round(100.0::double * count / nullif(case when level = 'Missing' then n_total else n_total - n_missing end, 0), 6) as percentage from t""")
def _(s: Study) -> DataFrame:
    return d.levels(c.members(s, RULES), RULES)


@query("q18_engagement_by_scope", f""", scoped as (select *, engagement_volume_repeatable::double / greatest(weight_days, 7.0) as rate_by_weight_days from {_SCOPED_FEATURES} x), flat as ({_tall('scoped', list(d.ENGAGEMENT_METRICS), 'metric', 'metric_order')})
select scope_order, scope, metric_order, metric, {_summary('value')}, count(*) filter (value = 0) as zero_n, count(*) filter (value > 0) as reached_n from flat group by all""")
def _(s: Study) -> DataFrame:
    return d.engagement(features_of(s), RULES)


@query("q19_activity_descriptives", f""", dense as (select k.member_id, t.event_type, t.is_repeatable, coalesce(event_count, 0)::bigint as n from cohort k cross join types t left join counts n on n.member_id = k.member_id and n.event_type = t.event_type)
select event_type, any_value(is_repeatable) as is_repeatable, count(*) as n_analysis, count(*) filter (n > 0) as n_reached, count(*) filter (n = 0) as n_zero, sum(n)::bigint as total_events,
  {_r('sum(n)::double / nullif(count(*) filter (n > 0), 0)', 'events_per_reached_member')}, {_r('quantile_cont(n, 0.5) filter (n > 0)', 'median_events_among_reached')}, {_r('quantile_cont(n, 0.25) filter (n > 0)', 'q1_events_among_reached')}, {_r('quantile_cont(n, 0.75) filter (n > 0)', 'q3_events_among_reached')}
from dense group by event_type""")
def _(s: Study) -> DataFrame:
    k = c.members(s, RULES)
    return d.activities(f.event_counts(s.engagement, k, RULES), k.count(), f.classify_events(s.engagement, RULES))


_MODULE_ROWS = " union all ".join(
    f"select scope_order, scope, {k} as module_order, '{v}' as module_variable, {t} as available_title_denominator, {n}::double as value, {v}::double as share from scoped"
    for k, (v, n, t) in enumerate([*[(f"module_{n}", f"module_{n}_count", t) for n, _, t in RULES.module_domains], ("module_mean", "(" + " + ".join(f"module_{n}_count" for n in _NAMES) + ")", sum(t for _, _, t in RULES.module_domains))], 1)
)


@query("q20_modules_by_scope", f""", scoped as {_SCOPED_FEATURES}, flat as ({_MODULE_ROWS})
select scope_order, scope, module_order, module_variable, available_title_denominator, count(*) as n_members, count(*) filter (value > 0) as n_members_with_completion, count(*) filter (value = 0) as n_members_without_completion,
  {_r('100.0::double * count(*) filter (value > 0) / count(*)', 'member_completion_percentage')}, sum(value)::bigint as total_unique_completions, {_r('avg(value)', 'mean_completion_count')}, {_r('stddev_samp(value)', 'standard_deviation_count')},
  {_r('quantile_cont(value, 0.5)', 'median_completion_count')}, {_r('quantile_cont(value, 0.25)', 'q1_completion_count')}, {_r('quantile_cont(value, 0.75)', 'q3_completion_count')}, {_r('min(value)', 'minimum_completion_count')}, {_r('max(value)', 'maximum_completion_count')},
  {_r('avg(share)', 'mean_completion_proportion')}, {_r('stddev_samp(share)', 'standard_deviation_proportion')}, max(value) = 0 as zero_completion_group_flag
from flat group by all""")
def _(s: Study) -> DataFrame:
    return d.modules(features_of(s), RULES)


@query("q21_missingness", " union all ".join(f"select 'demographics' as table_name, '{x}' as column_name, count(*) as n_rows, count(*) - count({x}) as n_missing, round((count(*) - count({x}))::double / count(*), 6) as missing_rate from v_demographics" for x in ("member_id", "subscription_status", "sex", "ethnicity")))
def _(s: Study) -> DataFrame:
    return d.missingness(s.demographics, "demographics")


@query("q22_subgroup_rare_collapse", """select case when n < 10 then '<SUPPRESSED>' else level end as level, sum(n)::bigint as n from (select coalesce(sex, '<MISSING>') || '/' || coalesce(nullif(trim(ethnicity), ''), 'Missing') as level, count(*) as n from cohort group by 1) t group by 1""")
def _(s: Study) -> DataFrame:
    groups = c.members(s, RULES).select(F.concat(F.coalesce("sex", F.lit("<MISSING>")), F.lit("/"), F.coalesce(F.nullif(F.trim("ethnicity"), F.lit("")), F.lit("Missing"))).alias("g"))
    return d.subgroup_counts(groups, "g")


@query("q23_fdr_adjustment", """, t as (select questionnaire_title as test, ((sum(hash_key) % 997) + 1)::double / 1000 as p from (select questionnaire_title, cast(member_id as bigint) as hash_key from v_modules) x group by 1),
r as (select *, row_number() over (order by p, test) as rank, count(*) over () as m from t)
select test, round(p, 6) as p, round(least(1.0, min(p * m / rank) over (order by rank desc rows unbounded preceding)), 6) as fdr_adjusted_p_value from r""")
def _(s: Study) -> DataFrame:
    key = F.col("member_id").cast("bigint")
    tests = s.modules.groupBy(F.col("questionnaire_title").alias("test")).agg((((F.sum(key) % 997) + 1).cast("double") / 1000).alias("p"))
    return adjust_p(tests, "p")


@query("q24_equal_count_bins", f"select bin::int as bin, count(*) as n, {_r('avg(first_weight)', 'mean_x')}, {_r('avg(percentage_loss)', 'mean_y')} from (select *, ntile(10) over (order by first_weight, member_id) as bin from cohort) t group by bin")
def _(s: Study) -> DataFrame:
    binned = equal_count_bins(c.members(s, RULES), "first_weight", "member_id", bins=10)
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("first_weight").alias("mean_x"), F.avg("percentage_loss").alias("mean_y"))


from . import catalog_models  # noqa: E402, F401  (registers the model queries)

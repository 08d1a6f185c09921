"""The eligibility funnel in one pass, and the tables of those who are left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import holds, ratio, strip
from ..sources.extracts import Study


@dataclass(frozen=True)
class Rules:
    """What makes a member eligible; the labels are the study's own."""

    statuses: tuple[str, ...] = ("ACTIVE", "FINISHED")
    treated: str = "Active GLP-1 for Weight-loss"
    reference: str = "Coaching Only"
    success_percent: float = 5.0
    repeatable_ratio: float = 2.0
    repeatable_members: int = 30
    floor_days: float = 7.0
    core: str = r"^(?:01|0[5-9]|1[0-2])_"
    domains: tuple[tuple[str, str, int], ...] = (
        ("mindset", r"^MINDSET W0[1-4]:", 4),
        ("nutrition", r"^NUTRITION W0[1-4]:", 4),
        ("physical_activity", r"^PHYSICAL ACTIVITY W0[1-4]:", 4),
    )
    core_titles: int = 9

    @property
    def module_domains(self) -> tuple[tuple[str, str, int], ...]:
        return (("core", self.core, self.core_titles), *self.domains)


#: Stages in the order of the funnel; a member is excluded at the first that fails.
STAGES = (
    "missing_weight_row",
    "ineligible_status",
    "missing_weights",
    "nonpositive_weights",
    "missing_interval",
    "nonpositive_interval",
    "other_member_type",
)


def matched(study: Study) -> DataFrame:
    """Every enrolled member with the weight row, if there is one, and whether there is."""
    right = study.weights.withColumn("has_weights", F.lit(True))
    return study.demographics.join(right, "member_id", "left").withColumn("has_weights", holds(F.col("has_weights")))


def stage(rules: Rules) -> Column:
    """0 for members who stay, or the 1-based stage that excludes them."""
    status = F.upper(strip(F.col("subscription_status")))
    a, b, days = F.col("first_weight"), F.col("last_weight"), F.col("weight_days")
    passes = (
        F.col("has_weights"),
        holds(status.isin(*rules.statuses)),
        a.isNotNull() & b.isNotNull(),
        holds((a > 0) & (b > 0)),
        days.isNotNull(),
        holds(days > 0),
        holds(F.col("member_type").isin(rules.treated, rules.reference)),
    )
    out = F.when(~passes[0], 1)
    for k, p in enumerate(passes[1:], start=2):
        out = out.when(~p, k)
    return out.otherwise(0)


def staged(study: Study, rules: Rules) -> DataFrame:
    return matched(study).withColumn("stage", stage(rules))


def with_outcomes(df: DataFrame, rules: Rules) -> DataFrame:
    """Absolute loss, percentage of the first weight, and whether it reaches the success threshold (unrounded)."""
    lost = F.col("first_weight") - F.col("last_weight")
    percent = ratio(100.0 * lost, F.col("first_weight"))
    return df.withColumns({"absolute_weight_loss": lost, "percentage_loss": percent}).withColumn("weight_loss_success", F.col("percentage_loss") >= rules.success_percent)


def members(study: Study, rules: Rules, *, primary_only: bool = True) -> DataFrame:
    """The cohort: complete pairs, of the two primary types unless all types are wanted."""
    keep = F.col("stage") == 0
    if not primary_only:
        keep = F.col("stage").isin(0, len(STAGES))
    kept = staged(study, rules).where(keep).drop("stage", "has_weights")
    return with_outcomes(kept.withColumn("subscription_status", F.upper(strip(F.col("subscription_status")))), rules)


def stage_counts(study: Study, rules: Rules) -> DataFrame:
    """(stage, n) over all stages, those that exclude nobody included; one pass over the join."""
    spark = study.demographics.sparkSession
    spine = spark.range(len(STAGES) + 1).select(F.col("id").cast("int").alias("stage"))
    counts = staged(study, rules).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def cohort_flow(study: Study, rules: Rules) -> DataFrame:
    """The funnel as running counts: who starts a stage, who goes, who stays, in percent of the enrolled.

    The window is over the eight rows of the funnel.
    """
    counts = stage_counts(study, rules)
    order = Window.partitionBy(F.lit(0)).orderBy("flow_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(0))
    flow = counts.select(F.col("stage").alias("flow_order"), F.when(F.col("stage") == 0, 0).otherwise(F.col("n")).cast("bigint").alias("excluded_n"), "n")
    enrolled = F.sum("n").over(whole)
    gone = F.sum("excluded_n").over(order)
    out = flow.withColumns({"enrolled": enrolled, "retained_n": enrolled - gone})
    labels = F.element_at(F.array(*[F.lit(x) for x in ("enrolled", *STAGES)]), F.col("flow_order") + 1)
    return out.select(
        "flow_order",
        labels.alias("stage_id"),
        (F.col("retained_n") + F.col("excluded_n")).alias("starting_n"),
        "excluded_n",
        "retained_n",
        ratio(100.0 * F.col("retained_n"), F.col("enrolled")).alias("percent_of_enrolled"),
    )


def orphan_weights(study: Study) -> DataFrame:
    """Weight rows of nobody enrolled."""
    return study.weights.join(study.demographics, "member_id", "left_anti")


def excluded_types(study: Study, rules: Rules) -> DataFrame:
    """(member_type, n) of complete pairs that the type restriction excludes."""
    return staged(study, rules).where(F.col("stage") == len(STAGES)).groupBy("member_type").agg(F.count(F.lit(1)).alias("n"))


def long_weights(cohort: DataFrame) -> DataFrame:
    """Two rows a member, first and last, from one scan."""
    pairs = F.array(
        F.struct(F.lit(0).alias("time"), F.lit("first").alias("occasion"), F.col("first_weight_at").alias("measurement_at"), F.col("first_weight").alias("weight")),
        F.struct(F.lit(1).alias("time"), F.lit("last").alias("occasion"), F.col("last_weight_at").alias("measurement_at"), F.col("last_weight").alias("weight")),
    )
    return cohort.select("member_id", "member_type", F.inline(pairs))

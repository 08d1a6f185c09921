"""Descriptive tables by scope: all members, and each of the two member types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at_least, ratio, strip
from ..functions.quantiles import aggregate_with_quantiles
from ..functions.stats import wilson
from .cohort import Rules

OVERALL = "Overall"


def scopes(df: DataFrame, rules: Rules) -> DataFrame:
    """Each row once for all members and once for its type: (scope_order, scope) added."""
    kinds = F.array(
        F.struct(F.lit(1).alias("scope_order"), F.lit(OVERALL).alias("scope")),
        F.struct(F.when(F.col("member_type") == rules.treated, 2).otherwise(3).alias("scope_order"), F.col("member_type").alias("scope")),
    )
    return df.select("*", F.inline(kinds))


QUARTILES = (0.25, 0.5, 0.75)


def summarize(rows: DataFrame, keys: Sequence[str], *more: Column, value: str = "value") -> DataFrame:
    """Counts, mean, sample SD, exact linear quartiles and extremes by ``keys``, and ``more`` aggregates; missing values are counted and left out."""
    v = F.col(value)
    own = [
        F.count(F.lit(1)).alias("n_total"), F.count(v).alias("n_observed"), F.count_if(v.isNull()).alias("n_missing"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("standard_deviation"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), *more
    ]
    out = aggregate_with_quantiles(rows, keys, value, QUARTILES, own)
    extra = [c for c in out.columns if c not in {*keys, *_SUMMARY, "q"}]
    named = out.withColumns({"median": F.col("q")[1], "q1": F.col("q")[0], "q3": F.col("q")[2]})
    return named.select(*keys, *_SUMMARY, *extra)


_SUMMARY = ("n_total", "n_observed", "n_missing", "mean", "standard_deviation", "median", "q1", "q3", "minimum", "maximum")


def tall(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str, order: str) -> DataFrame:
    """The values as rows: name, its 1-based order, and the value as double."""
    rows = F.array(*[F.struct(F.lit(k).alias(order), F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for k, c in enumerate(values, start=1)])
    return df.select(*keys, F.inline(rows))


def outcomes(cohort: DataFrame, rules: Rules, extra: Sequence[str] = ("first_weight", "last_weight", "absolute_weight_loss", "percentage_loss", "weight_days")) -> DataFrame:
    """Continuous outcomes and the success rate with its score interval, by scope."""
    own = scopes(cohort, rules)
    rows = tall(own, ("scope_order", "scope"), extra, "outcome", "outcome_order")
    continuous = summarize(rows, ("scope_order", "scope", "outcome_order", "outcome"))
    none = F.lit(None).cast("double")
    continuous = continuous.select("*", none.alias("numerator"), none.alias("denominator"), none.alias("percentage"), none.alias("ci_lower"), none.alias("ci_upper"))
    s = F.col("weight_loss_success")
    rate = own.groupBy("scope_order", "scope").agg(
        F.count(F.lit(1)).alias("n_total"), F.count(s).alias("n_observed"), F.count_if(s.isNull()).alias("n_missing"),
        F.count_if(s).alias("numerator")
    )
    low, high = wilson(F.col("numerator"), F.col("n_observed"))
    binary = rate.select(
        "scope_order", "scope", F.lit(len(extra) + 1).alias("outcome_order"), F.lit("weight_loss_success").alias("outcome"), "n_total", "n_observed", "n_missing",
        *[none.alias(c) for c in ("mean", "standard_deviation", "median", "q1", "q3", "minimum", "maximum")],
        F.col("numerator").cast("double").alias("numerator"), F.col("n_observed").cast("double").alias("denominator"), ratio(100.0 * F.col("numerator"), F.col("n_observed")).alias("percentage"), (100.0 * low).alias("ci_lower"), (100.0 * high).alias("ci_upper"),
    )
    return continuous.unionByName(binary)


ENGAGEMENT_METRICS = ("engagement_breadth", "engagement_volume_repeatable", "engagement_volume_repeatable_rate", "tenure_days", "rate_by_weight_days")


def engagement(features: DataFrame, rules: Rules) -> DataFrame:
    """Engagement metrics by scope, with how many members are at zero and above."""
    own = features.withColumn("rate_by_weight_days", ratio(F.col("engagement_volume_repeatable"), at_least(F.col("weight_days"), rules.floor_days)))
    rows = tall(scopes(own, rules), ("scope_order", "scope"), ENGAGEMENT_METRICS, "metric", "metric_order")
    zero, reached = F.count_if(F.col("value") == 0).alias("zero_n"), F.count_if(F.col("value") > 0).alias("reached_n")
    return summarize(rows, ("scope_order", "scope", "metric_order", "metric"), zero, reached)


def modules(features: DataFrame, rules: Rules) -> DataFrame:
    """Completions by scope for each domain, and for all domains together."""
    names = [n for n, _, _ in rules.module_domains]
    own = features.withColumns({"module_mean_count": sum((F.col(f"module_{n}_count") for n in names[1:]), F.col(f"module_{names[0]}_count"))})
    pairs = [
        *[(f"module_{n}_count", f"module_{n}", f"module_{n}", k) for n, _, k in rules.module_domains],
        ("module_mean_count", "module_mean", "module_mean", sum(k for _, _, k in rules.module_domains))
    ]
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("module_order"), F.lit(label).alias("module_variable"), F.lit(titles).alias("available_title_denominator"),
            F.col(c).cast("double").alias("value"), F.col(p).cast("double").alias("share")
        ) for k,
        (c, p, label, titles) in enumerate(pairs, start=1)
    ])
    flat = scopes(own, rules).select("scope_order", "scope", F.inline(rows))
    v, p = F.col("value"), F.col("share")
    keys = ("scope_order", "scope", "module_order", "module_variable", "available_title_denominator")
    out = aggregate_with_quantiles(flat, keys, "value", QUARTILES, [
        F.count(F.lit(1)).alias("n_members"), F.count_if(v > 0).alias("n_members_with_completion"), F.count_if(v == 0).alias("n_members_without_completion"),
        ratio(100.0 * F.count_if(v > 0), F.count(F.lit(1))).alias("member_completion_percentage"), F.sum(v).cast("bigint").alias("total_unique_completions"),
        F.avg(v).alias("mean_completion_count"), F.stddev_samp(v).alias("standard_deviation_count"),
        F.min(v).alias("minimum_completion_count"), F.max(v).alias("maximum_completion_count"), F.avg(p).alias("mean_completion_proportion"), F.stddev_samp(p).alias("standard_deviation_proportion"),
        (F.max(v) == 0).alias("zero_completion_group_flag"),
    ])
    return out.withColumns({"median_completion_count": F.col("q")[1], "q1_completion_count": F.col("q")[0], "q3_completion_count": F.col("q")[2]}).drop("q")


def levels(cohort: DataFrame, rules: Rules, characteristics: Sequence[tuple[str, bool]] = (("member_type", False), ("sex", True), ("ethnicity", True))) -> DataFrame:
    """Counts of each characteristic's levels by scope, zero counts included.

    Blank and missing values are the level Missing, in percent of all; other
    levels are in percent of the observed.  A characteristic with False is
    shown for all members only.  The levels are those of the whole cohort.
    """
    own = scopes(cohort, rules)
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("characteristic_order"), F.lit(c).alias("characteristic"), F.lit(every).alias("every"),
            F.coalesce(F.nullif(strip(F.col(c)), F.lit("")), F.lit("Missing")).alias("level")
        ) for k,
        (c, every) in enumerate(characteristics, start=1)
    ])
    flat = own.select("scope_order", "scope", F.inline(rows)).where(F.col("every") | (F.col("scope_order") == 1)).drop("every")
    counts = flat.groupBy("scope_order", "scope", "characteristic_order", "characteristic", "level").agg(F.count(F.lit(1)).alias("n"))
    # the spine: a few levels for three scopes
    seen = counts.where("scope_order = 1").select("characteristic_order", "characteristic", "level")
    spine = counts.select("scope_order", "scope", "characteristic_order").distinct().join(seen, "characteristic_order")
    keys = ["scope_order", "scope", "characteristic_order", "characteristic", "level"]
    full = spine.join(counts, keys, "left").withColumn("count", F.coalesce("n", F.lit(0)).cast("bigint"))
    w = Window.partitionBy("scope_order", "characteristic_order")
    total, missing = F.sum("count").over(w), F.sum(F.when(F.col("level") == "Missing", F.col("count")).otherwise(0)).over(w)
    out = full.withColumns({"n_total": total, "n_missing": missing}).withColumn("n_observed", F.col("n_total") - F.col("n_missing"))
    base = F.when(F.col("level") == "Missing", F.col("n_total")).otherwise(F.col("n_observed"))
    return out.select(*keys, "n_total", "n_observed", "n_missing", "count", ratio(100.0 * F.col("count"), base).alias("percentage"))


def activities(counts: DataFrame, members: int, types: DataFrame) -> DataFrame:
    """Per event type over all members: reach, zeros, events, and their spread among those reached.

    ``counts`` are those of members with events; the others are what is left
    of ``members``, the number of all.
    """
    n = F.col("event_count")
    per = aggregate_with_quantiles(counts.where(n > 0), ["event_type"], "event_count", QUARTILES, [F.count(F.lit(1)).alias("reached"), F.sum(n).alias("events")])
    reached, events = F.coalesce("reached", F.lit(0)).cast("bigint"), F.coalesce("events", F.lit(0)).cast("bigint")
    return types.select("event_type", "is_repeatable").join(per, "event_type", "left").select(
        "event_type", F.lit(members).cast("bigint").alias("n_analysis"), reached.alias("n_reached"), (F.lit(members).cast("bigint") - reached).alias("n_zero"), events.alias("total_events"),
        ratio(events, reached).alias("events_per_reached_member"), F.col("q")[1].alias("median_events_among_reached"), F.col("q")[0].alias("q1_events_among_reached"), F.col("q")[2].alias("q3_events_among_reached"), "is_repeatable",
    )


# The event types and their classes.
ACTIONABILITY = {
    "CHART_REVIEW": "care_delivery",
    "COMPLETED_CONSULTATION": "care_delivery",
    "COMPLETED_LAB_TEST": "clinical_or_administrative",
    "CONSUMED_DIGITAL_CONTENT": "member_behavior",
    "MEAL_PLAN_GENERATED": "care_delivery",
    "MEDICAL_QUESTIONNAIRE_ANSWERED": "clinical_or_administrative",
    "MEDICATION_CHANGE": "care_delivery",
    "QUESTIONNAIRE_ANSWERED": "member_behavior",
    "RECORD_BLOOD_GLUCOSE": "member_behavior",
    "RECORD_BLOOD_GLUCOSE_WITH_REVIEW": "care_delivery",
    "RECORD_BLOOD_PRESSURE": "member_behavior",
    "RECORD_BLOOD_PRESSURE_WITH_REVIEW": "care_delivery",
    "RECORD_BODY_WEIGHT": "member_behavior",
    "RECORD_STEPS": "member_behavior",
    "REGISTRATION": "clinical_or_administrative",
    "SUBSCRIPTION_STARTED": "clinical_or_administrative",
    "TEXT_MESSAGE_CARE_ONLY": "care_delivery",
    "VIDEO_CALL_COMPLETED": "care_delivery",
    "VOICE_MESSAGE_CARE_ONLY": "care_delivery",
}


def classify_strictly(types: DataFrame, mapping: dict[str, str], name: str = "actionability_class") -> DataFrame:
    """Event types with their class; a type without one, or a class without its type, is an error."""
    table = types.sparkSession.createDataFrame(sorted(mapping.items()), f"event_type string, {name} string")
    unknown = types.join(table, "event_type", "left_anti").select("event_type").limit(20).collect()
    absent = table.join(types, "event_type", "left_anti").select("event_type").limit(20).collect()
    if unknown or absent:
        raise ValueError(f"event types without a class: {[r[0] for r in unknown]}; classes without events: {[r[0] for r in absent]}")
    return types.join(F.broadcast(table), "event_type")


def missingness(df: DataFrame, name: str) -> DataFrame:
    """Missing counts and rates of every column, in one aggregation."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m{k}") for k, c in enumerate(df.columns)])
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"m{k}").alias("n_missing"),
            ratio(F.col(f"m{k}"), F.col("n")).alias("missing_rate")
        ) for k,
        c in enumerate(df.columns)
    ])
    return one.select(F.inline(rows))


def subgroup_counts(df: DataFrame, by: str, *, least: int = 10, rare: str = "<SUPPRESSED>", missing: str = "<MISSING>") -> DataFrame:
    """(level, n): levels of fewer rows than ``least`` are one; missing values are a level."""
    counts = df.groupBy(F.coalesce(F.col(by), F.lit(missing)).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(F.when(F.col("n") < least, F.lit(rare)).otherwise(F.col("level")).alias("level")).agg(F.sum("n").alias("n"))


def feature_summary(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, statistic, value): seven statistics of each variable, from one aggregation."""
    flat = summarize(tall(features, (), columns, "variable", "variable_order"), ("variable_order", "variable"))
    stats = ("n_observed", "n_missing", "mean", "standard_deviation", "minimum", "median", "maximum")
    return flat.select("variable_order", "variable", F.inline(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value")) for s in stats])))

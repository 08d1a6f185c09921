"""Engagement and curriculum features, censored at each member's last weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at_least, holds, ratio
from .cohort import Rules

#: Event types that a study may have at most where members meet all of them.
MOST_TYPES = 1000


def classify_events(engagement: DataFrame, rules: Rules) -> DataFrame:
    """Per event type: events, distinct members, their ratio, and whether both reach the thresholds.

    Always over the whole engagement table, whoever is in a cohort.
    """
    return _classified(engagement.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("member_id").alias("distinct_members")), rules)


def classify_pairs(pairs: DataFrame, rules: Rules) -> DataFrame:
    """:func:`classify_events` from the pairs of :func:`event_pairs`."""
    return _classified(pairs.groupBy("event_type").agg(F.sum("events").alias("events"), F.count("member_id").alias("distinct_members")), rules)


def _classified(per: DataFrame, rules: Rules) -> DataFrame:
    per = per.withColumn("events_per_member", ratio(F.col("events"), F.col("distinct_members")))
    return per.withColumn("is_repeatable", holds((F.col("events_per_member") >= rules.repeatable_ratio) & (F.col("distinct_members") >= rules.repeatable_members)))


def _cut(facts: DataFrame, cohort: DataFrame, at: str) -> DataFrame:
    """The cohort's rows, with ``kept``: not after the last weight, both dates known."""
    dates = cohort.select("member_id", F.col("last_weight_at").alias("_until"))
    known = F.col(at).isNotNull() & F.col("_until").isNotNull()
    return facts.join(dates, "member_id").withColumns({"kept": known & ~holds(F.col(at) > F.col("_until")), "late": known & holds(F.col(at) > F.col("_until"))}).drop("_until")


def cutoff_audit(facts: DataFrame, cohort: DataFrame, at: str) -> DataFrame:
    """One row of counts: all rows, the cohort's, kept, late, and without a date."""
    of = _cut(facts, cohort, at)
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")
    own = of.agg(
        F.count(F.lit(1)).alias("cohort_rows"), count(F.col("kept")).alias("kept_rows"), count(F.col("late")).alias("late_rows"),
        count(~F.col("kept") & ~F.col("late")).alias("undated_rows")
    )
    return facts.agg(F.count(F.lit(1)).alias("source_rows")).crossJoin(own)


def event_pairs(engagement: DataFrame, cohort: DataFrame) -> DataFrame:
    """(member, event type) with all ``events`` and the cohort's kept ones, ``event_count``; a row a pair, whoever is in the cohort.

    Classes and counts both come from it: who keeps it reads the engagement
    table once.
    """
    dates = cohort.select("member_id", F.col("last_weight_at").alias("_until"))
    kept = F.col("_until").isNotNull() & holds(F.col("activity_at") <= F.col("_until"))
    return engagement.join(dates, "member_id", "left").groupBy("member_id", "event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if(kept).alias("event_count"))


def event_counts(engagement: DataFrame, cohort: DataFrame, rules: Rules, pairs: DataFrame | None = None) -> DataFrame:
    """Sparse (member, event type) counts of kept events, with the type's class; absent pairs have no row.

    ``pairs`` are those of :func:`event_pairs`, if the caller keeps them.
    """
    if pairs is None:
        kept = _cut(engagement, cohort, "activity_at").where(F.col("kept") & F.col("event_type").isNotNull())
        own, classes = kept.groupBy("member_id", "event_type").agg(F.count(F.lit(1)).alias("event_count")), classify_events(engagement, rules)
    else:
        own, classes = pairs.where((F.col("event_count") > 0) & F.col("event_type").isNotNull()), classify_pairs(pairs, rules)
    return own.join(classes.select("event_type", "is_repeatable"), "event_type", "left").select("member_id", "event_type", "event_count", "is_repeatable")


def engagement_features(cohort: DataFrame, counts: DataFrame, rules: Rules) -> DataFrame:
    """Members with breadth, repeatable volume and its rate per day of tenure (of seven at least)."""
    per = counts.groupBy("member_id").agg(F.count("event_type").alias("breadth"), F.sum(F.when(holds(F.col("is_repeatable")), F.col("event_count")).otherwise(0)).alias("volume"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    joined = cohort.join(per, "member_id", "left").withColumns({
        "engagement_breadth": zero(F.col("breadth")), "engagement_volume_repeatable": zero(F.col("volume"))
    }).drop("breadth", "volume")
    return joined.withColumn("engagement_volume_repeatable_rate", ratio(F.col("engagement_volume_repeatable"), at_least(F.col("tenure_days"), rules.floor_days)))


def module_domain(title: Column, rules: Rules) -> Column:
    """The curriculum domain of a title, or null."""
    out = None
    for name, pattern, _ in rules.module_domains:
        out = (F if out is None else out).when(holds(title.rlike(pattern)), F.lit(name))
    return out


def kept_modules(modules: DataFrame, cohort: DataFrame, rules: Rules) -> DataFrame:
    """(member, title, domain) of completions by the last weight, each title once."""
    kept = _cut(modules, cohort, "answered_at").where("kept").select("member_id", "questionnaire_title").distinct()
    return kept.withColumn("domain", module_domain(F.col("questionnaire_title"), rules))


def module_features(cohort: DataFrame, kept: DataFrame, rules: Rules) -> DataFrame:
    """Members with each domain's count, its share of the domain's titles, and the shares' mean."""
    names = [n for n, _, _ in rules.module_domains]
    wide = kept.where(F.col("domain").isNotNull()).groupBy("member_id").pivot("domain", names).count()
    joined = cohort.join(wide, "member_id", "left")
    joined = joined.withColumns({f"module_{n}_count": F.coalesce(F.col(n), F.lit(0)).cast("bigint") for n in names}).drop(*names)
    joined = joined.withColumns({f"module_{n}": F.col(f"module_{n}_count") / F.lit(float(k)) for n, _, k in rules.module_domains})
    return joined.withColumn("module_mean", sum((F.col(f"module_{n}") for n in names[1:]), F.col(f"module_{names[0]}")) / float(len(names)))


def member_features(engagement: DataFrame, modules: DataFrame, cohort: DataFrame, rules: Rules, pairs: DataFrame | None = None) -> DataFrame:
    """The cohort with all features: two fact scans, each aggregated once to members."""
    counts = event_counts(engagement, cohort, rules, pairs)
    wide = engagement_features(cohort, counts, rules)
    return module_features(wide, kept_modules(modules, cohort, rules), rules)


def dense_counts(cohort: DataFrame, counts: DataFrame, types: DataFrame) -> DataFrame:
    """Every member with every event type: 0 where there is no count.

    ``types`` is the table of event types, a vocabulary of at most
    ``MOST_TYPES``, which is checked; each member is repeated for each of it.
    """
    known = [r[0] for r in types.select("event_type").distinct().limit(MOST_TYPES + 1).collect()]
    if len(known) > MOST_TYPES:
        raise ValueError(f"over {MOST_TYPES} event types: the column is no vocabulary")
    vocabulary = F.array(*[F.lit(t).cast("string") for t in known]) if known else F.array().cast("array<string>")
    spine = cohort.select("member_id", F.explode(vocabulary).alias("event_type"))
    return spine.join(
        counts.select("member_id", "event_type", "event_count"), ["member_id", "event_type"], "left"
    ).withColumn("event_count", F.coalesce("event_count", F.lit(0)).cast("bigint"))

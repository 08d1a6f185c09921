"""Exact quantiles by rank selection: no task sorts or holds all values of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of the sketch that brackets the wanted ranks: its rank error is at most a group's rows over this.
ACCURACY = 20_000


def aggregate_with_quantiles(rows: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], aggregates: Sequence[Column] = (), out: str = "q") -> DataFrame:
    """``rows`` aggregated by ``keys``, with the array ``out`` of the exact quantiles of ``value`` (linear between ranks).

    One aggregation makes the ``aggregates`` and a mergeable sketch, which
    brackets every wanted rank closely.  A second one counts what lies
    between the brackets and every value inside them, all groups at once:
    some 2 / ``ACCURACY`` of a group's values each.  Running sums then find
    the wanted ranks.  The sketch decides how much is sorted, not the result:
    a rank outside its bracket is the smallest or largest value next to it,
    or an error.

    Null values are left out; a group of none has a null array.  Groups are
    those of a report (null keys are one): their brackets are broadcast.
    """
    wide = 2.0 / ACCURACY
    edges = F.array(*[F.lit(min(1.0, max(0.0, p + s))) for p in at for s in (-wide, wide)])
    v = F.col(value).cast("double")
    first = rows.groupBy(*keys).agg(*aggregates, F.percentile_approx(v, edges, ACCURACY).alias("_edges"))
    bounds = F.broadcast(first.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_edges"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    edge = lambda k: F.col("_edges")[k]
    held = rows.where(v.isNotNull()).select(*keys, v.alias("_v")).join(bounds, same)
    v = F.col("_v")
    # parts in order of their values: even ones lie between brackets, odd ones are brackets
    part = F.lit(2 * len(at))
    for k in reversed(range(len(at))):
        part = F.when(v < edge(2 * k), 2 * k).when(v <= edge(2 * k + 1), 2 * k + 1).otherwise(part)
    parts = held.select(*keys, v, part.alias("_part"))
    counts = parts.groupBy(*keys, "_part", F.when(F.col("_part") % 2 == 1, v).alias("_in")).agg(F.count(F.lit(1)).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    own = [F.col(k) for k in keys] or [F.lit(0)]
    up_to = Window.partitionBy(*own).orderBy("_part", "_in").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("_end", F.sum("_n").over(up_to)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*own)))
    begin, end = F.col("_end") - F.col("_n"), F.col("_end")

    def rank(r: Column) -> Column:
        """The value of rank ``r`` (from 0), on the row that has it."""
        unknown = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
        return F.max(F.when((begin <= r) & (r < end), F.when((r == begin) | (F.col("_lo") == F.col("_hi")), F.col("_lo")).when(r == end - 1, F.col("_hi")).otherwise(unknown)))

    place = [(F.col("_all") - 1) * F.lit(float(p)) for p in at]
    picked = placed.groupBy(*keys).agg(
        *[rank(F.floor(p)).alias(f"_a{k}") for k, p in enumerate(place)], *[rank(F.floor(p) + 1).alias(f"_b{k}") for k, p in enumerate(place)],
        *[F.max(p - F.floor(p)).alias(f"_f{k}") for k, p in enumerate(place)],
    )
    a, b, f = ([F.col(f"_{x}{k}") for k in range(len(at))] for x in "abf")
    found = picked.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.array(*[F.when(f[k] == 0, a[k]).otherwise(a[k] * (1 - f[k]) + b[k] * f[k]) for k in range(len(at))]).alias(out))
    # the table of one row for all rows has no key to join by
    return first.join(F.broadcast(found), same, "left").drop("_edges", *[f"_key_{k}" for k in keys])

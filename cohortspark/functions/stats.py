"""Statistical functions: closed forms as Columns, windows for rank-based ones."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def z_value(confidence: float = 0.95) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def two_sided_p(z: float) -> float:
    """Of a standard normal statistic."""
    return math.erfc(abs(z) / math.sqrt(2))


def wilson_interval(numerator: float, denominator: float, confidence: float = 0.95) -> tuple[float, float]:
    """The score interval of a proportion; (nan, nan) for an empty denominator."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    if numerator < 0 or denominator < 0 or numerator > denominator:
        raise ValueError("the numerator must lie between 0 and the denominator")
    if denominator == 0:
        return math.nan, math.nan
    z, n = z_value(confidence), denominator
    p = numerator / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return max(0.0, middle - half), min(1.0, middle + half)


def wilson(numerator: Column, denominator: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """:func:`wilson_interval` as Columns, null for an empty denominator."""
    z = F.lit(z_value(confidence))
    n = F.when(denominator > 0, denominator.cast("double"))
    p = numerator.cast("double") / n
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def adjust_p(df: DataFrame, p: str, family: list[str] | None = None, out: str = "fdr_adjusted_p_value") -> DataFrame:
    """Benjamini-Hochberg adjusted p values within each family; null p values take no part.

    The adjusted value is the smallest of p * m / rank over this and all
    larger p values, at most 1.  A family is a table of tests, one window.
    """
    by = [F.col(c) for c in family or []] or [F.lit(0)]
    known = F.col(p).isNotNull()
    rank = F.row_number().over(Window.partitionBy(*by, known).orderBy(p))
    m = F.sum(known.cast("int")).over(Window.partitionBy(*by))
    raw = F.when(known, F.col(p) * m / rank)
    ranked = df.withColumn("_raw", raw).withColumn("_rank", rank)
    down = Window.partitionBy(*by, known).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn(out, F.when(known, F.least(F.lit(1.0), F.min("_raw").over(down)))).drop("_raw", "_rank")


#: Ranges of an order, for each shuffle partition and at most; and sampled rows for each range.
RANGES, MOST_RANGES, SAMPLED = 4, 512, 20


def range_edges(df: DataFrame, value: str, tie: str, parts: int) -> list[tuple]:
    """At most ``parts`` - 1 (value, tie) pairs that cut the order of ``df`` into ranges of nearly equal counts, in order.

    The sample is the ``SAMPLED * parts`` rows of the smallest hashes, so the
    edges are the same whenever they are asked for.
    """
    h = F.xxhash64(value, tie)
    rows = df.select(F.col(value).alias("v"), F.col(tie).alias("t"), h.alias("h")).orderBy("h", "v", "t").limit(SAMPLED * parts).collect()
    lowest = lambda x: (x is not None, 0 if x is None else x)
    order = sorted(((r["v"], r["t"]) for r in rows), key=lambda z: (lowest(z[0]), lowest(z[1])))
    cuts = [order[k * len(order) // parts] for k in range(1, parts)] if order else []
    return sorted(set(cuts), key=lambda z: (lowest(z[0]), lowest(z[1])))


def range_of(df: DataFrame, value: str, tie: str, edges: list[tuple]) -> Column:
    """How many of the edges are at most a row's (value, tie), by halving."""
    kinds = dict(df.dtypes)
    own = F.struct(F.col(value).alias("v"), F.col(tie).alias("t"))
    edge = lambda z: F.struct(F.lit(z[0]).cast(kinds[value]).alias("v"), F.lit(z[1]).cast(kinds[tie]).alias("t"))

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(own < edge(edges[middle]), among(lo, middle)).otherwise(among(middle + 1, hi))

    return among(0, len(edges))


def placed(df: DataFrame, value: str, tie: str, out: str = "place") -> tuple[DataFrame, int]:
    """Each row's place from 0 in the order of ``value`` and ``tie`` (nulls first), and the number of rows.

    Rows are sorted in ranges that are numbered on from each other, so the
    whole order is no single task.  The ranges' borders are values, so they
    are the same in every run and nothing has to be kept in memory.
    """
    parts = min(MOST_RANGES, RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.withColumn("_range", range_of(df, value, tie, range_edges(df, value, tie, parts)))
    sizes = dict(ranged.groupBy("_range").count().collect())
    first, start = {}, 0
    for p in sorted(sizes):
        first[p], start = start, start + sizes[p]
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), F.col("_range")) if first else F.lit(0)
    order = (F.asc_nulls_first(value), F.asc_nulls_first(tie))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn(out, (offset + number).cast("bigint")).drop("_range"), start


def rank_positions(df: DataFrame, value: str, tie: str, out: str = "position") -> DataFrame:
    """Each row's plotting position, (place + 1/2) / rows."""
    ordered, n = placed(df, value, tie, "_place")
    return ordered.withColumn(out, (F.col("_place") + 0.5) / max(n, 1)).drop("_place")


def equal_count_bins(df: DataFrame, value: str, tie: str, bins: int | None = None, by: list[str] | None = None, most: int = 10, out: str = "bin") -> DataFrame:
    """Each row's bin, 1-based: bins of equal counts in the order of ``value`` and ``tie``.

    Unless given there are as many bins as pairs of rows, ``most`` at most;
    with ``by`` there are bins in each group.
    """
    if by:
        return df.withColumn(out, F.ntile(bins or most).over(Window.partitionBy(*by).orderBy(value, tie)))
    ordered, n = placed(df, value, tie, "_place")
    k, place = bins or max(1, min(most, n // 2)), F.col("_place")
    # the first n % k bins have one row more than the others
    size, more = n // k, n % k
    edge = more * (size + 1)
    number = F.when(place < edge, F.floor(place / (size + 1))).otherwise(more + F.floor((place - edge) / max(size, 1)))
    return ordered.withColumn(out, (number + 1).cast("int")).drop("_place")

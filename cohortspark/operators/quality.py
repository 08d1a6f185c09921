"""Contracts of keys and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import holds, strip


def key_quality(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, null keys, blank keys, untrimmed keys, and rows whose key is another row's too."""
    k = F.col(key)
    per_key = df.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    count = lambda c: F.coalesce(F.sum(F.when(holds(c), n).otherwise(0)), F.lit(0)).cast("bigint")
    key_ = F.col("k")
    return per_key.agg(
        count(F.lit(True)).alias("n_rows"),
        count(key_.isNull()).alias("n_null"),
        count(strip(key_) == "").alias("n_blank"),
        count(strip(key_) != key_).alias("n_untrimmed"),
        count((n > 1) & key_.isNotNull()).alias("n_duplicated"),
    )


def require_keys(df: DataFrame, key: str, what: str) -> None:
    """Fail unless every key is there, trimmed, not blank and unique."""
    r = key_quality(df, key).first()
    bad = {c: r[c] for c in ("n_null", "n_blank", "n_untrimmed", "n_duplicated") if r[c]}
    if bad:
        raise ValueError(f"{what}.{key}: {bad}")

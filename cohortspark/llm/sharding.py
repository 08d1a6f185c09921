"""Sharding by weighted rendezvous hashing, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import fresh

#: Buckets of a shard over which its slots are numbered; a bucket is one sort.
SLOT_BUCKETS = 4096


def rendezvous_shard(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard (0-based) with the best weighted score for the key.

    Each shard's score is ``ln(u) / weight`` with ``u`` in (0, 1) from a hash of
    the key and the shard number, so a further shard only ever takes records
    into itself, and a shard's share is proportional to its weight.  A null
    key is a key like any other.  Ties (equal hashes) go to the larger number.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive and not empty")
    scores = []
    for shard, weight in enumerate(weights):
        unit = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        scores.append(F.struct((F.log(unit) / F.lit(float(weight))).alias("s"), F.lit(shard).alias("n")))
    return scores[0]["n"] if len(scores) == 1 else F.greatest(*scores)["n"]


def assign_shards(
    df: DataFrame, key: str, weights: Sequence[float], *, shard: str = "shard", slot: str = "slot", grown: str = "grown_shard",
    grown_weight: float = 1.0, tie_break: Sequence[str] = (), buckets: int = SLOT_BUCKETS
) -> DataFrame:
    """``df`` with its shard, its slot in the shard and its shard if there were one more.

    Slots are gapless from 0 in each shard.  They are numbered without
    gathering a shard: records fall into ``buckets`` hash buckets a shard, the
    buckets' sizes (``shards * buckets`` rows at most, which bounds what is
    broadcast) give each bucket its first slot, and a sort within the bucket
    the rest.  Rows with equal keys are ordered by ``tie_break``; rows equal in
    all of it get their slots in any order, in one sort.  Columns named as
    ``shard``, ``slot`` and ``grown`` say are replaced.  Texts of any length are
    only hashed.  An empty table gives none.
    """
    b, first = fresh(df, "bucket"), fresh(df, "first")
    out = df.withColumns({shard: rendezvous_shard([F.col(key)], weights), grown: rendezvous_shard([F.col(key)], [*weights, grown_weight])})
    # rows of one key are spread by tie_break too, so that no key is a bucket of its own
    out = out.withColumn(b, F.pmod(F.xxhash64(F.col(key), *[F.col(c) for c in tie_break]), F.lit(buckets)).cast("int"))
    sizes = out.groupBy(shard, b).agg(F.count(F.lit(1)).alias("n"))
    # sizes has at most shards * buckets rows, so one sort of a shard's sizes is bounded
    starts = sizes.withColumn(first, F.sum("n").over(Window.partitionBy(shard).orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n")
    within = Window.partitionBy(shard, b).orderBy(F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in tie_break])
    numbered = out.withColumn(slot, F.row_number().over(within).cast("bigint") - 1)
    return numbered.join(F.broadcast(starts), [shard, b]).withColumn(slot, F.col(slot) + F.col(first)).drop(b, first)

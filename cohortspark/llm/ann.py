"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Every row is coded once: the packed signs of its rotated direction and two
correction scalars are stored in blocks beside the vectors.  A block's codes
give each query estimates with error bounds, and only vectors whose bounds
reach those of the best are compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import materialize

#: Rows of a block of candidates and of a block of queries.
BLOCK_ROWS = 4096
QUERY_ROWS = 16384
#: Parts of the candidates; a query's best are told once for each.
GROUPS = 16
#: Parts in which the copies of one vector are ranked before they are ranked together.
SALTS = 64
#: Standard errors of the estimate within which a vector is reranked.
BOUND = 2.0
SEED = 11


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for the same arguments."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths, without overflow of the squares."""
    most = np.abs(vectors).max(1, initial=0.0)
    most[most == 0] = 1
    return most * np.linalg.norm(vectors / most[:, None], axis=1)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, spread): packed signs of the rotated vectors and two correction scalars each.

    With x the unit vector of the signs and u the vector's direction, both
    rotated, <u, q> is estimated by <x, q> / <x, u>; its error has the
    standard deviation sqrt((1 - <x, u>^2) / <x, u>^2 / (dim - 1)) for unit q.
    ``scale`` is the norm over <x, u>, ``spread`` that deviation times the norm.
    """
    dim = vectors.shape[1]
    norm = norms(vectors)
    turned = (vectors / norm[:, None]) @ turn
    inner = np.abs(turned).sum(1) / np.sqrt(dim)
    spread = norm * np.sqrt(np.maximum(1 - inner**2, 0) / inner**2 / max(dim - 1, 1))
    return np.packbits(turned > 0, axis=1), norm / inner, spread


def estimate(codes: np.ndarray, scale: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Estimated inner products with rotated unit queries, a row a query, from packed signs."""
    dim = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    return (turned.astype(np.float32) @ signs.T).astype(np.float64) * (scale / np.sqrt(dim))


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return (vectors.astype(np.float64) * query.astype(np.float64)).sum(1)


def search_block(
    ids: np.ndarray, vectors: np.ndarray, coded: tuple[np.ndarray, np.ndarray, np.ndarray], query_ids: np.ndarray, queries: np.ndarray,
    turn: np.ndarray, k: int, bound: float = BOUND, reached: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vec_id, score) of each query's best ``k`` of a block, ties to the smaller id.

    A vector is reranked exactly unless its upper bound is below the k-th
    largest lower bound of the block, or below what the query's k-th best of
    earlier blocks has ``reached``; bounds that are no numbers exclude none.
    A query's own id is no candidate.
    """
    codes, scale, spread = coded
    guess = estimate(codes, scale, (queries / norms(queries)[:, None]) @ turn)
    slack = bound * spread[None, :] + 1e-6 * np.abs(guess)
    own = query_ids[:, None] == ids[None, :]
    low = np.where(own | ~np.isfinite(guess - slack), -np.inf, guess - slack)
    least = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(queries), -np.inf)
    if reached is not None:
        least = np.maximum(least, reached)
    maybe = ~(guess + slack < least[:, None]) & ~own
    q, v, s = [], [], []
    for n in range(len(queries)):
        at = np.flatnonzero(maybe[n])
        score = exact(queries[n], vectors[at])
        if len(at) > 4 * k:
            cut = np.partition(np.nan_to_num(score, nan=-np.inf), len(at) - k)[len(at) - k]
            keep = ~(score < cut)
            at, score = at[keep], score[keep]
        best = np.lexsort((ids[at], -score))[:k]
        q.append(np.full(len(best), n)), v.append(ids[at][best]), s.append(score[best])
    return np.concatenate(q), np.concatenate(v), np.concatenate(s)


class Best:
    """The best ``k`` of each of some queries so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.q, self.v, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.reached = np.full(queries, -np.inf)

    def add(self, q: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        q, v, s = np.concatenate([self.q, q]), np.concatenate([self.v, v]), np.concatenate([self.s, s])
        order = np.lexsort((v, -s, np.isnan(s), q))
        q, v, s = q[order], v[order], s[order]
        first = np.searchsorted(q, q)  # where the query's rows begin
        place = np.arange(len(q)) - first
        keep = place < self.k
        full = (place == self.k - 1) & ~np.isnan(s)
        self.reached[q[full]] = s[full]
        self.q, self.v, self.s = q[keep], v[keep], s[keep]


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, not zero, without null or non-finite components."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def nearest(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, bound: float = BOUND) -> DataFrame:
    """The ``k`` nearest rows by inner product of each row whose id is divisible by ``every``.

    Every row is coded, once, into blocks that are dealt evenly over
    ``GROUPS`` groups.  A task has one block of queries and goes through one
    group's blocks, keeping each query's best ``k`` and what they have reached;
    so ``GROUPS`` times k rows a query are shuffled after, however many rows
    there are.  All candidates travel once for every ``QUERY_ROWS`` queries:
    the comparisons are rows times queries, and with one bit a component the
    bounds leave too many to rerank for them to be fetched one by one.

    Rows with the id of the query are not its candidates.  Repeated ids are
    candidates once for each row, and a query once, with the smallest of
    their vectors.  Of equal vectors only the rows of the ``k + 1`` smallest
    ids, and of one id ``k`` rows, can be among the nearest, so the others are
    not compared.  Vectors of another length than the most frequent one (the
    larger of two) take no part.  Products that are no numbers come last.  An
    empty table has an empty result.
    """
    rows = materialize(usable(df, vec_id, vector), "vectors")
    spark = df.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["dim"]
    rows = rows.where(F.size("v") == dim)
    # of one id k rows at most, of equal vectors those of the k + 1 smallest ids: in parts first
    few = rows.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("copies")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for by in (["v", "salt"], ["v"]):
        few = few.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("n") <= k + 1)
    pool = few.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))).alias("_")).select("vec_id", "v")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        group = TaskContext.get().partitionId() % GROUPS
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                codes, scale, spread = encode(flat.reshape(-1, dim), turn)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x.tobytes()], pa.binary()) for x in (np.asarray(part.column(0)), codes, scale, spread, flat)), pa.array([group], pa.int32())],
                    names=["ids", "codes", "scale", "spread", "flat", "group"]
                )

    # each group has the same number of even parts
    parts = GROUPS * max(1, -(-rows.count() // (GROUPS * 2 * BLOCK_ROWS)))
    coded = materialize(pool.repartition(parts).mapInArrow(code, "ids binary, codes binary, scale binary, spread binary, flat binary, group int"), "codes")
    # an id's smallest vector is the query; queries in blocks by a hash of their id, one row for each task that held some of it
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-asked.count() // QUERY_ROWS))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, ids = np.asarray(b.column(2)), np.asarray(b.column(0))
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            for n in np.unique(number):
                at = np.flatnonzero(number == n)
                for lo in range(0, len(at), QUERY_ROWS):
                    own = at[lo : lo + QUERY_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[own].tobytes()], pa.binary()), pa.array([flat[own].tobytes()], pa.binary()), pa.array([int(n)], pa.int32())],
                        names=["q_ids", "q_flat", "qb"]
                    )

    queries = asked.select("vec_id", "v", block.alias("qb")).mapInArrow(by_block, "q_ids binary, q_flat binary, qb int").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("group")
    )
    candidates = coded.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("qb"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        key, best, q_ids, q = None, None, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(q_ids[best.q]), pa.array(best.v), pa.array(best.s)], names=["query_id", "vec_id", "score"])

        for b in batches:
            for own, codes, scale, spread, flat, asked_ids, asked_flat, group in zip(*(c.to_pylist() for c in b.columns)):
                if key != (group, asked_ids):  # rows come in order of the join's key
                    if best is not None:
                        yield told()
                    key, q_ids, q = (group, asked_ids), np.frombuffer(asked_ids, np.int64), np.frombuffer(asked_flat, np.float64).reshape(-1, dim)
                    best = Best(len(q), k)
                ids, vectors = np.frombuffer(own, np.int64), np.frombuffer(flat, np.float64).reshape(-1, dim)
                code_of = np.frombuffer(codes, np.uint8).reshape(len(ids), -1), np.frombuffer(scale, np.float64), np.frombuffer(spread, np.float64)
                new = [search_block(ids, vectors, code_of, q_ids[lo : lo + 256], q[lo : lo + 256], turn, k, bound, best.reached[lo : lo + 256]) for lo in range(0, len(q), 256)]
                best.add(np.concatenate([n + 256 * j for j, (n, _, _) in enumerate(new)]), *(np.concatenate([x[c] for x in new]) for c in (1, 2)))
        if best is not None:
            yield told()

    met = candidates.join(queries.hint("merge"), ["qb", "group"]).select("ids", "codes", "scale", "spread", "flat", "q_ids", "q_flat", "group")
    found = met.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

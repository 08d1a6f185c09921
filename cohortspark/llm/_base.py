"""Helpers shared by the operators: shared scratch tables and Arrow text access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_SCOPE: ContextVar[dict[str, DataFrame] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only on one machine, as in tests, a temporary folder may take its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="corpus-shared-"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The copy is on storage that outlives executors, so a lost executor costs
    no recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if (own := _SCOPE.get()) is not None:
        own[path] = out
    return out


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at the end, also after a failure, all that :func:`materialize` wrote inside.

    What the yielded function is given stays; it belongs to the scope around
    this one, if there is one.  Threads have scopes of their own.
    """
    outer, own = _SCOPE.get(), {}
    token = _SCOPE.set(own)

    def keep(df: DataFrame) -> DataFrame:
        own.pop(df.written_to)
        if outer is not None:
            outer[df.written_to] = df
        return df

    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        discard(*own.values())


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the files of finished shuffles go.

    They are deleted when the driver's collector finds that nothing refers to
    them any more, and a driver with little garbage seldom looks.
    """
    spark.sparkContext._jvm.System.gc()


#: A key is a crowd's if it has at least so many rows, and a thousandth of them all.
CROWD = 1000


def crowds(counts: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """(key) of the at most a thousand keys of a table of ``rows`` rows that have the most of them, written."""
    return materialize(counts.where(F.col(n) >= max(CROWD, rows // 1000)).select(key), "crowds")


def left_join(left: DataFrame, right: DataFrame, key: str, crowd: DataFrame, salt: Column) -> DataFrame:
    """``left`` with the columns of ``right``, whose ``key`` is unique, without one task for a crowd's or the null key.

    Rows of the ``crowd`` keys (few, see :func:`crowds`) get theirs from a
    broadcast of their rows of ``right``, which have to be small; they and
    rows without a key are then dealt by ``salt``, which equals no key.
    """
    others = [c for c in right.columns if c != key]
    warm, own, dealt = fresh(left, "warm", *others), fresh(left, "own", *others), fresh(left, "dealt", *others)
    few = right.join(F.broadcast(crowd), key, "left_semi").select(F.col(key).alias(own), F.struct(*others).alias(warm))
    cold = right.join(F.broadcast(crowd), key, "left_anti").select(F.col(key).alias(dealt), *others)
    told = left.join(F.broadcast(few), F.col(key) == F.col(own), "left").withColumn(dealt, F.when(F.col(own).isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(salt))
    out = told.join(cold, dealt, "left")
    return out.select(*left.columns, *[F.coalesce(F.col(c), F.col(f"{warm}.{c}")).alias(c) for c in others])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null value is empty.

    ``bytes[offsets[i]:offsets[i + 1]]`` is the UTF-8 of row ``i``.
    """
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = column.fill_null(empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes each, or of one longer row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their text as bytes and offsets; bounds the arrays that the caller makes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        for lo, hi in row_slices(offsets, most):
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def fresh(df: DataFrame, stem: str, *taken: str) -> str:
    """A column name that ``df`` does not have and that is not ``taken``."""
    have = {c.lower() for c in (*df.columns, *taken)}
    name = f"_{stem}"
    while name in have:
        name = f"_{name}"
    return name

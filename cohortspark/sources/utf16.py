"""Delimited UTF-16 text in parallel: a file is read in byte ranges, and records are put together across them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What stands at a place of a record: a field's start, inside a plain one, inside a quoted one, behind its closing quote.
START, FIELD, QUOTED, CLOSED = range(4)
#: Where a range can begin: at a record, in a quoted field's next line, or (odd) in the middle of a character.
BEGINNINGS = ((False, START), (False, QUOTED), (True, FIELD), (True, QUOTED))

_EVENT = re.compile('["\t]')


def _follow(text: str, at: int) -> int:
    """The place after ``text``; a quote opens a field only at its start, and two inside one are a character of it."""
    end = 0
    for m in _EVENT.finditer(text):
        if m.start() > end and at != QUOTED:
            at = FIELD
        end = m.end()
        if m[0] == "\t":
            at = at if at == QUOTED else START
        elif at == START:
            at = QUOTED
        elif at == QUOTED:
            at = CLOSED
        elif at == CLOSED:
            at = QUOTED if text[m.start() - 1] == '"' else FIELD
    return FIELD if len(text) > end and at != QUOTED else at


class Lines:
    """The order of one range's lines: which of them end a record, from a beginning on.

    Lines are what stands between the bytes of a line feed, wherever these
    are.  The two bytes can also be halves of two characters; then the line
    before has an odd number of bytes, and so has what follows up to the next
    true line feed.
    """

    def __init__(self, little: bool, beginning: tuple[bool, int]) -> None:
        self.codec, self.little = ("utf-16-le" if little else "utf-16-be"), little
        self.odd, self.at = beginning

    def ends(self, raw: bytes) -> bool:
        """Whether the line ends a record."""
        own = raw
        if self.odd:  # the first byte belongs to the character before
            own = raw[1:]
        self.odd ^= len(raw) % 2 == 1
        if b'"' in own or self.at != START:
            self.at = _follow(own[: len(own) // 2 * 2].decode(self.codec, "surrogatepass"), self.at)
        if self.odd:
            self.at = QUOTED if self.at == QUOTED else FIELD
            return False
        if self.at == QUOTED:
            return False
        self.at = START
        return True

    @property
    def state(self) -> tuple[bool, int]:
        return self.odd, self.at


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, in_first, id): the records of a UTF-16 file as text, without their line ends; those of the first range are marked.

    A byte order mark tells the order of bytes; without one the low byte
    comes first.  Tabs part fields, quotes may hold tabs and line feeds.  A
    first pass tells, for each byte range of the file and each state in which
    it can begin, the state in which it ends; a few numbers a range come to
    the driver.  The second pass makes the records; what begins in one range
    and ends in another is put together by a small shuffle.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        mark = bytes(x & 255 for x in (stream.read(), stream.read()) if x >= 0)
    finally:
        stream.close()
    little = mark != b"\xfe\xff"
    codec = "UTF-16LE" if little else "UTF-16BE"
    feed = b"\n\0" if little else b"\0\n"
    lines = spark.read.option("encoding", codec).option("lineSep", "\n").text(path)
    raw = lines.select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, list[Lines]] = {}
        for batch in batches:
            for block, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s in states.setdefault(block, [Lines(little, b) for b in BEGINNINGS]):
                    s.ends(line)
        rows = [(b, *(v for s in own for v in s.state)) for b, own in states.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=_NAMES) if rows else pa.RecordBatch.from_pylist([], _SUMMARY)

    ends = {r[0]: [(bool(r[1 + 2 * k]), r[2 + 2 * k]) for k in range(4)] for r in raw.mapInArrow(summary, "block bigint, o0 boolean, a0 bigint, o1 boolean, a1 bigint, o2 boolean, a2 bigint, o3 boolean, a3 bigint").collect()}
    begins, now = {}, BEGINNINGS[0]
    for block in sorted(ends):
        begins[block] = now
        now = ends[block][BEGINNINGS.index(now)]
    first = min(begins, default=0)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: dict[int, Lines] = {}
        held: dict[int, list[bytes]] = {}
        whole: dict[int, bool] = {}
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for block, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block not in order:
                    order[block], held[block], whole[block] = Lines(little, begins[block]), [], begins[block] == BEGINNINGS[0]
                held[block].append(line)
                if order[block].ends(line):
                    # 0: a record; 1: the end of one that began in a range before
                    out.append((block, 0 if whole[block] else 1, feed.join(held[block])))
                    held[block], whole[block] = [], True
            yield _batch(out)
        # 2: the beginning of one, or (3) a piece from the middle
        yield _batch([(b, 2 if whole[b] else 3, feed.join(x)) for b, x in held.items() if x])

    made = raw.mapInArrow(records, "block bigint, kind bigint, bytes binary").withColumn("id", F.monotonically_increasing_id())
    text = lambda c: F.regexp_replace(F.decode(c, codec), "\r$", "")
    complete = made.where("kind = 0").select(text(F.col("bytes")).alias("record"), "block", "id")
    # a range has two pieces at most; the one that begins a record numbers those that go on with it
    piece = made.where("kind > 0").withColumn("turn", F.when(F.col("kind") == 2, 1).otherwise(0))
    ordered = Window.orderBy("block", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chains = piece.withColumn("chain", F.sum("turn").over(ordered)).groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("block", "turn", F.hex("bytes").alias("h")))).alias("p"), F.min("block").alias("block"), F.min("id").alias("id"))
    joined = F.unhex(F.array_join(F.transform("p", lambda z: z["h"]), feed.hex().upper()))
    every = complete.unionByName(chains.select(text(joined).alias("record"), "block", "id"))
    mark_free = F.when(F.col("block") == first, F.regexp_replace("record", "^\ufeff", "")).otherwise(F.col("record"))
    return every.select(mark_free.alias("record"), (F.col("block") == first).alias("in_first"), "id")


_NAMES = ["block", *(f"{x}{k}" for k in range(4) for x in "oa")]
_SUMMARY = pa.schema([("block", pa.int64()), *((f"{x}{k}", pa.bool_() if x == "o" else pa.int64()) for k in range(4) for x in "oa")])


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    block, kind, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(kind, pa.int64()), pa.array(data, pa.binary())], names=["block", "kind", "bytes"])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file with a header as text columns; empty fields are null, empty records are left out."""
    every = read_records(spark, path).where(F.trim("record") != "")
    head = every.where("in_first").orderBy("id").select("id", "record").first()
    if head is None:
        raise ValueError(f"{path} is empty")
    width = head["record"].count("\t") + 1
    options = {"sep": "\t", "quote": '"', "escape": '"', "lineSep": "\uffff", "maxCharsPerColumn": "-1"}
    schema = ", ".join(f"c{k} string" for k in range(width))
    parsed = lambda rows: rows.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
    names = parsed(spark.createDataFrame([(head["record"],)], "record string")).first()
    body = parsed(every.where(F.col("id") != head["id"]))
    return body.toDF(*[(n if n is not None else f"_c{k}") for k, n in enumerate(names)])

"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents, as search engines partition theirs:
each row is a shard of about a megabyte of text, with every term that stands
in it, and for each term the sorted list of its positions.  It is made once,
whatever the test set, and holds every word.  The test set is read block by
block; each block's windows are looked up in all shards, and the matches of
all blocks are brought together by shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import materialize, pieces
from ._words import FOLD, LETTERS, word_hashes

WINDOW = 10
#: Bytes of text of an index shard, or one longer document.
SHARD_BYTES = 1 << 20
#: Bytes of test text that the driver reads and sends at a time.
BLOCK_BYTES = 4 << 20
#: Candidate places that are looked at together.
CANDIDATES = 1 << 21

HITS_SCHEMA = "shard bigint, names array<array<string>>, window binary, start binary, length binary"


@dataclass(frozen=True)
class TestTerms:
    """The words of a block of test items, numbered, and the windows over them.

    ``terms`` are the sorted hashes of the distinct words; ``windows`` holds a
    row of term numbers for each different window, -1 beyond a short window's
    end.  The items that a window stands in are ``item[begin[w]:begin[w + 1]]``.
    """

    terms: np.ndarray
    windows: np.ndarray
    length: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    item_ids: np.ndarray

    def names(self, w: int) -> list[str]:
        """The ids of the items that a window stands in."""
        return sorted({str(i) for i in self.item_ids[self.item[self.begin[w] : self.begin[w + 1]]]})


def read_test_set(items: list[tuple[int, str | None]], window: int = WINDOW) -> TestTerms:
    """Windows of ``window`` words of each item; an item of fewer words is one window, one without words none."""
    texts = [(t or "").encode() for _, t in items]
    offsets = np.cumsum([0, *map(len, texts)])
    data = FOLD[np.frombuffer(b"".join(texts), np.uint8)]
    hashes, _, _, first = word_hashes(data, offsets, LETTERS)
    terms, number = np.unique(hashes, return_inverse=True)
    rows, item = [], []
    for k in range(len(items)):
        own = number[first[k] : first[k + 1]].astype(np.int32)
        if len(own) == 0:
            continue
        if len(own) < window:
            got = np.full((1, window), -1, np.int32)
            got[0, : len(own)] = own
        else:
            got = np.lib.stride_tricks.sliding_window_view(own, window)
        rows.append(got)
        item += [k] * len(got)
    every = np.concatenate(rows) if rows else np.zeros((0, window), np.int32)
    windows, of = np.unique(every, axis=0, return_inverse=True)
    of = of.ravel()
    begin = np.searchsorted(np.sort(of), np.arange(len(windows) + 1))
    return TestTerms(terms, windows, (windows >= 0).sum(1), begin, np.array(item, np.int64)[np.argsort(of, kind="stable")], np.array([i for i, _ in items], object))


def build_index(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Shards of a positional inverted index of all words: shard, doc_ids, first, terms, counts, postings.

    Words of a shard are numbered through; ``first`` holds the number of each
    document's first word, and the end.  ``terms`` are the sorted hashes of
    the shard's distinct words, ``counts`` the lengths of their posting lists,
    and ``postings`` the lists, one after the other.  Null or empty text has
    no words.  The index is written to the shared folder.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text", SHARD_BYTES):
            hashes, _, _, first = word_hashes(FOLD[data], offsets, LETTERS)
            order = np.argsort(hashes, kind="stable")
            ordered = hashes[order]
            begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else order
            counts = np.diff(np.append(begin, len(order)))
            ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0))
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array([x.tobytes()], pa.binary()) for x in (first.astype(np.int32), ordered[begin], counts.astype(np.int32), order.astype(np.int32))]],
                names=["doc_ids", "first", "terms", "counts", "postings"]
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)),
        *[T.StructField(c, T.BinaryType()) for c in ("first", "terms", "counts", "postings")]
    ])
    return materialize(rows.mapInArrow(index, schema).withColumn("shard", F.monotonically_increasing_id()), "postings")


def _meet(shard_terms: bytes, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the test terms that a shard has, in the shard's list and in the test's."""
    own = np.frombuffer(shard_terms, np.uint64)
    if not len(own) or not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(own, terms)
    at[at == len(own)] = 0
    here = np.flatnonzero(own[at] == terms)
    return at[here], here


def term_counts(index: DataFrame, test: TestTerms) -> np.ndarray:
    """Postings of each test term over the whole index, summed on the executors."""
    terms = test.terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, here = _meet(own, terms)
                total[here] += np.frombuffer(counts, np.int32)[at]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["term", "n"])

    rows = index.select("terms", "counts").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(terms), np.int64)
    out[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def phrase_matches(index: DataFrame, test: TestTerms, counts: np.ndarray | None = None, *, slop: int = 0) -> DataFrame:
    """Occurrences of the windows: for each shard the window, start and length (words) of every match.

    ``names`` are the items of each window that the shard has, and ``window``
    the place in them; a window of many items is matched and told once.

    A window's posting lists are intersected from its rarest term on: the
    positions of that term, less its offset in the window, are the candidate
    starts; the next rarest terms' lists, offset-adjusted alike, thin them
    out.  With ``slop`` a term may stand up to so many words from its place
    (proximity).  No match crosses documents.
    """
    counts = term_counts(index, test) if counts is None else counts
    windows, length = test.windows, test.length
    order = np.argsort(np.where(windows >= 0, counts[np.maximum(windows, 0)], np.iinfo(np.int64).max), axis=1, kind="stable") if len(windows) else windows
    rarest = windows[np.arange(len(windows)), order[:, 0]] if len(windows) else np.zeros(0, np.int32)
    by_rarest = np.argsort(rarest, kind="stable")
    rarest_sorted = rarest[by_rarest]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, terms, n, postings in zip(*(c.to_pylist() for c in batch.columns)):
                found = [x for x in shard_matches(np.frombuffer(first, np.int32), terms, np.frombuffer(n, np.int32), np.frombuffer(postings, np.int32)) if len(x[0])]
                if found:
                    w, start, size = (np.concatenate(x) for x in zip(*found))
                    used, w = np.unique(w, return_inverse=True)
                    items = pa.array([[test.names(k) for k in used.tolist()]], pa.list_(pa.list_(pa.string())))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int64()), items, *[pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (w, start, size)]],
                        names=["shard", "names", "window", "start", "length"]
                    )

    def shard_matches(first: np.ndarray, terms: bytes, n: np.ndarray, postings: np.ndarray) -> Iterator[tuple]:
        at, own = _meet(terms, test.terms)
        if not len(own):
            return
        size, begin = n[at].astype(np.int64), (np.cumsum(n) - n)[at].astype(np.int64)
        # windows whose rarest term is here, and all their other terms
        lo, hi = np.searchsorted(rarest_sorted, own), np.searchsorted(rarest_sorted, own, side="right")
        has = np.flatnonzero(hi > lo)
        spread = (hi - lo)[has]
        w = by_rarest[np.repeat(lo[has] - np.cumsum(spread) + spread, spread) + np.arange(spread.sum())]
        t = np.repeat(has, spread)
        here = np.zeros(len(test.terms) + 1, bool)
        here[own] = True
        here[-1] = True  # -1: beyond a short window's end
        whole = here[windows[w]].all(1) if len(w) else np.zeros(0, bool)
        w, t = w[whole], t[whole]
        if not len(w):
            return
        # the lists of these windows' terms: keys of term and position, sorted as postings are
        used = np.unique(windows[w])
        used = np.searchsorted(own, used[used >= 0])
        span = int(first[-1])
        lists = [postings[begin[k] : begin[k] + size[k]].astype(np.int64) for k in used]
        key = np.concatenate([x + int(own[k]) * span for k, x in zip(used, lists)])
        places = dict(zip(used.tolist(), lists))
        ends = np.cumsum(size[t])
        for part in np.split(np.arange(len(w)), np.searchsorted(ends, np.arange(CANDIDATES, ends[-1], CANDIDATES))):
            if len(part):
                start = np.concatenate([places[int(k)] for k in t[part]])
                who = np.repeat(w[part], size[t[part]])
                if slop:
                    yield _near(key, span, first, who, start)
                else:
                    yield _exact(key, span, first, who, start - order[who, 0])

    def _exact(key: np.ndarray, span: int, first: np.ndarray, w: np.ndarray, start: np.ndarray) -> tuple:
        end = start + length[w]
        keep = (start >= 0) & (end <= span)
        w, start, end = w[keep], start[keep], end[keep]
        keep = np.searchsorted(first, start, side="right") == np.searchsorted(first, end - 1, side="right")
        w, start = w[keep], start[keep]
        for j in range(1, windows.shape[1]):
            off = order[w, j]
            wanted = windows[w, off].astype(np.int64)
            k = np.searchsorted(key, wanted * span + start + off)
            k[k == len(key)] = 0
            ok = (wanted < 0) | (key[k] == wanted * span + start + off)
            w, start = w[ok], start[ok]
        return w, start, length[w]

    def _near(key: np.ndarray, span: int, first: np.ndarray, w: np.ndarray, at: np.ndarray) -> tuple:
        got: list[tuple[int, int, int]] = []
        doc = np.searchsorted(first, at, side="right") - 1
        for x, p, own in zip(w.tolist(), at.tolist(), doc.tolist()):
            start, lowest, highest = p - int(order[x, 0]), 1 << 60, -1
            for off in range(int(length[x])):
                base = int(windows[x, off]) * span
                k = int(np.searchsorted(key, base + start + off))
                near = [int(v) - base for v in key[max(0, k - 1) : k + 1] if abs(int(v) - base - start - off) <= slop and first[own] <= int(v) - base < first[own + 1]]
                if not near:
                    break
                best = min(near, key=lambda v: (abs(v - start - off), v))
                lowest, highest = min(lowest, best), max(highest, best)
            else:
                got.append((x, lowest, highest - lowest + 1))
        return tuple(np.array(x, np.int64) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 3

    return index.select("shard", "first", "terms", "counts", "postings").mapInArrow(match, HITS_SCHEMA)


def summarize(index: DataFrame, hits: DataFrame) -> DataFrame:
    """A row a document: words, words inside matches, items matched by id, their digest, contaminated or not."""
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                first = np.frombuffer(batch.column(1)[k].as_py(), np.int32).astype(np.int64)
                ids = batch.column(0).slice(k, 1).flatten()
                delta, own = np.zeros(first[-1] + 1, np.int64), [set() for _ in ids]
                for h in batch.column(2)[k].as_py() or ():
                    s, z = np.frombuffer(h["start"], np.int32).astype(np.int64), np.frombuffer(h["length"], np.int32)
                    np.add.at(delta, s, 1)
                    np.add.at(delta, s + z, -1)
                    pairs = np.stack([np.searchsorted(first, s, side="right") - 1, np.frombuffer(h["window"], np.int32)], 1)
                    for d, w in np.unique(pairs, axis=0).tolist():
                        own[d].update(h["names"][w])
                covered = np.concatenate([[0], np.cumsum(np.cumsum(delta)[:-1] > 0)])
                n_hit = covered[first[1:]] - covered[first[:-1]]
                sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in own]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(first)), pa.array(n_hit), pa.array([len(x) for x in own], pa.int64()), pa.array(sha, pa.string()), pa.array(n_hit > 0)],
                    names=names
                )

    gathered = hits.groupBy("shard").agg(F.collect_list(F.struct("names", "window", "start", "length")).alias("hits"))
    rows = index.select("shard", "doc_ids", "first").join(gathered, "shard", "left").select("doc_ids", "first", "hits")
    types = (index.schema["doc_ids"].dataType.elementType, T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType())
    return rows.mapInArrow(sums, T.StructType([T.StructField(n, t) for n, t in zip(names, types)]))


def test_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", most: int = BLOCK_BYTES) -> Iterator[TestTerms]:
    """The test set in blocks of at most ``most`` characters (or one longer item), one at a time.

    Items without an id are called ``null``.
    """
    own, size = [], 0
    for i, t in benchmark.select(F.col(item_id), F.col(text)).toLocalIterator():
        if own and size + len(t or "") > most:
            yield read_test_set(own)
            own, size = [], 0
        own.append((i if i is not None else "null", t))
        size += len(t or "")
    yield read_test_set(own)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The summary of every document against every test item.

    Every row of ``docs`` has a row, whatever its id; ids are carried as they
    are.  Null or empty text has no words, and items without words have no
    windows.  Items of one id count once.  Empty tables give no rows or no
    hits.  All test sets are taken alike, block by block.
    """
    index = build_index(docs, text=text, doc_id=doc_id)
    hits = docs.sparkSession.createDataFrame([], HITS_SCHEMA)
    for block in test_blocks(benchmark):
        hits = hits.unionByName(materialize(phrase_matches(index, block), "hits"))
    return summarize(index, hits)

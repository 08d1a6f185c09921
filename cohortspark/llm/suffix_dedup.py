"""Removal of long strings that stand more than once in a corpus, by suffix arrays.

A suffix array of the whole corpus would be one unbounded sort, so the corpus
is sharded by content first.  Of each string of ``LENGTH`` bytes the smallest
hash of its ``GRAM``-byte grams picks an anchor; equal strings have equal
anchors.  The strings of one anchor stand side by side and form a segment.
Segments whose anchors are equal meet in one shard, equal segments as one,
and the shard's suffix array finds the strings that they share.  The segments
of a common anchor are sharded again by more of their content: by the
``LENGTH - WIDTH + 1`` bytes that ``WIDTH`` neighbouring strings share, and if
that is common too, string by string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import discard, fresh, materialize, pieces, release
from ._words import mix

LENGTH = 400
GRAM = 128
#: Bytes of segments for one suffix array.
SHARD_BYTES = 1 << 19
#: Different segments that a shard takes of one anchor; those of a commoner one are sharded more finely.
SHARD_SEGMENTS = 256
#: Neighbouring strings of one finer shard.
WIDTH = 17
#: Strings of one text that are looked at together.
BLOCK = 1 << 20


# Suffix arrays


def _larger_next(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (type S); the last symbol is the smallest."""
    n = len(t)
    up = np.zeros(n, np.int8)
    up[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    up[-1] = 1
    # equal neighbours are of the type of the next different one
    at = np.where(up != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return up[at] > 0


def _deal(j: np.ndarray, keys: np.ndarray, out: np.ndarray, place: np.ndarray) -> None:
    """Append j to the buckets of its keys, in order."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    count = np.diff(np.append(first, len(k)))
    out[np.repeat(place[k[first]] - first, count) + np.arange(len(k))] = j[order]
    place[k[first]] += count


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that the given order of the LMS suffixes induces.

    Larger suffixes are induced from the left, bucket by bucket, smaller ones
    from the right.  What a bucket induces in itself is taken in rounds, so
    that each step is on arrays and keeps the scan's order.
    """
    n = len(t)
    n_large, n_small = np.bincount(t[~small], minlength=size), np.bincount(t[small], minlength=size)
    large_at = np.concatenate([[0], np.cumsum(n_large)])
    small_at = np.concatenate([[0], np.cumsum(n_small)])
    large, place = np.empty(large_at[-1], np.int32), large_at[:-1].copy()
    lms_sorted = lms[np.argsort(t[lms], kind="stable")]
    lms_at = np.searchsorted(t[lms_sorted], np.arange(size + 1))
    used = np.flatnonzero(n_large + n_small)
    for c in used:
        done = large_at[c]
        while done < place[c]:
            chunk = large[done : place[c]]
            done = place[c]
            j = chunk[chunk > 0] - 1
            j = j[~small[j]]
            if len(j):
                _deal(j, t[j], large, place)
        own = lms_sorted[lms_at[c] : lms_at[c + 1]]
        j = own[own > 0] - 1
        if len(j):
            _deal(j, t[j], large, place)
    # the small ones of each bucket from its end: kept in reverse
    back, place = np.empty(small_at[-1], np.int32), small_at[:-1].copy()
    _deal(np.array([n - 1]), t[-1:], back, place)
    for c in used[::-1]:
        done = small_at[c]
        while done < place[c]:
            chunk = back[done : place[c]]
            done = place[c]
            j = chunk[chunk > 0] - 1
            j = j[small[j]]
            if len(j):
                _deal(j, t[j], back, place)
        own = large[large_at[c] : large_at[c + 1]][::-1]
        j = own[own > 0] - 1
        j = j[small[j]]
        if len(j):
            _deal(j, t[j], back, place)
    out = np.empty(n, np.int32)
    at = 0
    for c in used:
        a, b = large_at[c], large_at[c + 1]
        out[at : at + b - a] = large[a:b]
        at += b - a
        a, b = small_at[c], small_at[c + 1]
        out[at : at + b - a] = back[a:b][::-1]
        at += b - a
    return out


def _sais(s: list[int], size: int) -> list[int]:
    """The suffix array of a list over a large alphabet; its last symbol is the smallest and stands once.

    The same induction, one suffix at a time: most buckets hold one.
    """
    n = len(s)
    if n == 1:
        return [0]
    small = bytearray(n)
    small[-1] = 1
    for i in range(n - 2, -1, -1):
        small[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1])
    starts, ends, total = [0] * size, [0] * size, 0
    for c, k in enumerate(np.bincount(s, minlength=size).tolist()):
        starts[c], total = total, total + k
        ends[c] = total
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]

    def induce(order: list[int]) -> list[int]:
        sa, tail = [-1] * n, ends[:]
        for i in reversed(order):
            tail[s[i]] -= 1
            sa[tail[s[i]]] = i
        head = starts[:]
        for i in sa_scan(sa):
            if i > 0 and not small[i - 1]:
                c = s[i - 1]
                sa[head[c]] = i - 1
                head[c] += 1
        tail = ends[:]
        for k in range(n - 1, -1, -1):
            i = sa[k]
            if i > 0 and small[i - 1]:
                c = s[i - 1]
                tail[c] -= 1
                sa[tail[c]] = i - 1
        return sa

    def sa_scan(sa: list[int]) -> Iterator[int]:
        for k in range(n):
            yield sa[k]

    sa = induce(lms)
    follows = dict(zip(lms, [*lms[1:], n - 1]))
    names, name, last = {}, -1, None
    for i in sa:
        if i > 0 and small[i] and not small[i - 1]:
            piece = s[i : follows[i] + 1]
            if piece != last:
                name, last = name + 1, piece
            names[i] = name
    reduced = [names[i] for i in lms]
    if name + 1 < len(lms):
        order = [lms[k] for k in _sais(reduced, name + 1)]
    else:
        order = [0] * len(lms)
        for k, i in zip(reduced, lms):
            order[k] = i
    return induce(order)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of small non-negative integers whose last is the smallest and stands once, by induced sorting."""
    t = t.astype(np.int64)
    if len(t) == 1:
        return np.zeros(1, np.int64)
    size = int(t.max()) + 1
    small = _larger_next(t)
    lms = np.flatnonzero(small & np.concatenate([[False], ~small[:-1]]))
    # sort the LMS substrings, name them, and sort the string of their names
    rough = _induce(t, small, lms, size)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    end = np.full(len(t), len(t), np.int64)
    end[lms[:-1]] = lms[1:] + 1
    name = np.cumsum(np.concatenate([[False], ~_equal_spans(t, ordered, end[ordered])]))
    names = np.zeros(len(t), np.int64)
    names[ordered] = name
    if name[-1] + 1 < len(ordered):
        ordered = lms[np.array(_sais(names[lms].tolist(), int(name[-1]) + 1), np.int64)]
    return _induce(t, small, ordered, size)


def _equal_spans(t: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each span t[start:end] but the first equals the one before it."""
    size = ends - starts
    same = size[1:] == size[:-1]
    live = np.flatnonzero(same)
    step = 0
    while len(live):
        if step == 64:  # the few long ones at once
            raw, width = t.tobytes(), t.itemsize
            for k in live:
                a, b, n = int(starts[k]), int(starts[k + 1]), int(size[k])
                same[k] = raw[a * width : (a + n) * width] == raw[b * width : (b + n) * width]
            break
        equal = t[starts[live] + step] == t[starts[live + 1] + step]
        same[live[~equal]] = False
        step += 1
        live = live[equal & (size[live] > step)]
    return same


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, lcp): for each position the suffix before it in the array and their common prefix's length.

    Where the symbols before both suffixes are equal, the length is one less
    than at the position before; only the others are compared, and the sum of
    those is at most n log n.
    """
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[0]], before[sa[1:]] = -1, sa[:-1]
    prior = np.where(before > 0, t[before - 1], -1)
    same = np.zeros(n, bool)
    same[1:] = (prior[1:] == t[:-1]) & (before[1:] > 0) & (before[:-1] >= 0)
    start = np.flatnonzero(~same)
    padded = np.concatenate([t, np.zeros(4, t.dtype)]).astype(np.uint64)
    four = padded[:n] << np.uint64(48) | padded[1 : n + 1] << np.uint64(32) | padded[2 : n + 2] << np.uint64(16) | padded[3 : n + 3]
    length = np.zeros(n, np.int64)
    live = start[before[start] >= 0]
    step = np.zeros(len(live), np.int64)
    while len(live):
        a, b = live + step, before[live] + step
        inside = (a < n) & (b < n)
        diff = np.ones(len(live), np.uint64)
        diff[inside] = four[a[inside]] ^ four[b[inside]]
        # whole words that are equal, then the symbols of the first that is not
        equal = diff == 0
        done = ~equal
        d = diff[done]
        extra = (d < np.uint64(1 << 48)).astype(np.int64) + (d < np.uint64(1 << 32)) + (d < np.uint64(1 << 16))
        extra[~inside[done]] = 0
        length[live[done]] = step[done] + extra
        live, step = live[equal], step[equal] + 4
    source = np.where(~same, np.arange(n), 0)
    source = np.maximum.accumulate(source)
    return before, np.maximum(length[source] - (np.arange(n) - source), 0)


def repeated(segments: list[bytes]) -> list[np.ndarray]:
    """For each segment, which of its strings of ``LENGTH`` bytes start anywhere else in the segments."""
    size = [len(s) for s in segments]
    at = np.cumsum([0, *[k + 1 for k in size]])
    t = np.ones(at[-1] + 1, np.int64)
    t[-1] = 0
    for a, s in zip(at, segments):
        t[a : a + len(s)] = np.frombuffer(s, np.uint8).astype(np.int64) + 2
    before, lcp = permuted_lcp(t, suffix_array(t))
    long = lcp >= LENGTH
    twice = long.copy()
    twice[before[long]] = True
    return [twice[a : a + k - LENGTH + 1] for a, k in zip(at, size)]


# Segments


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hashes of all grams; they choose anchors and name shards, but make nothing equal."""
    n = len(data)
    with np.errstate(over="ignore"):
        powers, inverse = np.full(n, _P, np.uint64), np.full(n, _P_INV, np.uint64)
        powers[0] = inverse[0] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64)])
        return mix((sums[GRAM:] - sums[: n - GRAM + 1]) * np.cumprod(inverse, dtype=np.uint64)[: n - GRAM + 1])


def _anchor_keys(grams: np.ndarray) -> np.ndarray:
    """What the smallest is looked for of: 40 bits of the hash, then the position."""
    return (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)


def find_segments(data: np.ndarray, offsets: np.ndarray) -> tuple:
    """(row, start, own, anchor hash, name) of the segments of each row's strings.

    ``own`` is the number of strings of the segment, which start side by side
    from ``start`` in the row; the name is the 128-bit hash of its bytes.
    """
    count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    if not count.sum():
        return (*(np.zeros(0, d) for d in (np.int64, np.int64, np.int64, np.uint64)), [])
    width = LENGTH - GRAM + 1
    grams = gram_hashes(data)
    keys = _anchor_keys(grams)
    whole = -(-len(keys) // width) * width
    grid = np.full(whole, np.uint64(2**64 - 1))
    grid[: len(keys)] = keys
    grid = grid.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    row = np.repeat(np.arange(len(count)), count)
    starts = offsets[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    anchor = (np.minimum(right[starts], left[starts + width - 1]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    own = np.diff(np.append(first, len(row)))
    begin = starts[first]
    raw = data.tobytes()
    names = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begin.tolist(), (begin + own - 1 + LENGTH).tolist())]
    return row[first], begin - offsets[:-1][row[first]], own, grams[anchor[first]], names


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """:func:`find_segments` with one long row in blocks of its strings."""
    if len(offsets) > 2 or len(data) <= 2 * BLOCK:
        yield find_segments(data, offsets)
        return
    for lo in range(0, len(data) - LENGTH + 1, BLOCK):
        part = data[lo : lo + BLOCK + LENGTH - 1]
        row, start, *rest = find_segments(part, np.array([0, len(part)]))
        yield (row, start + lo, *rest)


ANCHORS = "t binary, ah bigint, sh binary, starts binary, own int"


def anchor_rows(texts: DataFrame) -> DataFrame:
    """(t, ah, sh, starts, own) of the segments of texts (t, text): each segment of a text (of a block, if it is long) once, with all its starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for rows, data, offsets in pieces(batches, "text", 1 << 19):
            names = rows.column(0).to_pylist()
            for row, start, own, ah, sh in _blocks(data, offsets):
                new = np.array([names[k] not in seen for k in range(len(names))])
                keep = np.flatnonzero(new[row]) if len(row) else row
                if not len(keep):
                    continue
                row, start, own, ah = (x[keep] for x in (row, start, own, ah))
                sh = np.array([sh[k] for k in keep.tolist()], object)
                halves = np.frombuffer(b"".join(sh), np.uint64).reshape(-1, 2)
                key = np.stack([row.astype(np.uint64), halves[:, 0], halves[:, 1]], 1)
                order = np.argsort(mix(key[:, 0] + mix(key[:, 1] ^ mix(key[:, 2]))), kind="stable")
                first = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]).any(1)]))
                ends = np.append(first[1:], len(order))
                packed = start[order].astype(np.int32)
                k = order[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[r] for r in row[k]], pa.binary()), pa.array(ah[k].view(np.int64)),
                        pa.array(sh[k].tolist(), pa.binary()), pa.array([packed[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                        pa.array(own[k].astype(np.int32))
                    ],
                    names=["t", "ah", "sh", "starts", "own"],
                )
            if len(seen) < 1 << 18:
                seen.update(names)

    return texts.mapInArrow(run, ANCHORS)


def _runs(flags: np.ndarray) -> bytes:
    """(from, to) pairs of the true runs, as int32."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).astype(np.int32).tobytes()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ah, sh, runs) from (ah, sh, bytes) sorted by ah: suffix arrays of whole groups, many to an array."""
    held: dict[tuple[int, bytes], bytes] = {}
    size, last = 0, None

    def solve() -> Iterator[pa.RecordBatch]:
        found = [(k, _runs(f)) for k, f in zip(held, repeated(list(held.values()))) if f.any()] if held else []
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in found], pa.int64()), pa.array([k[1] for k, _ in found], pa.binary()), pa.array([r for _, r in found], pa.binary())],
                names=["ah", "sh", "runs"]
            )

    for batch in batches:
        for ah, sh, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if ah != last and size > SHARD_BYTES:
                yield from solve()
                held, size = {}, 0
            last = ah
            if (ah, sh) not in held:
                held[ah, sh] = raw
                size += len(raw)
    yield from solve()


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ah, sh, at, finer, name, raw): the parts of a segment, each of at most ``WIDTH`` neighbouring strings.

    The parts are cut where the anchor stands a multiple of ``WIDTH`` bytes
    into a string, so that equal strings are in parts alike; ``finer`` is the
    hash of the bytes that all strings of such a part would share.
    """
    for batch in batches:
        out: list[tuple] = []
        for ah, sh, raw in zip(*(c.to_pylist() for c in batch.columns)):
            n = len(raw) - LENGTH + 1
            at = int(_anchor_keys(gram_hashes(np.frombuffer(raw[:LENGTH], np.uint8))).argmin())
            for c in range(max(0, at - n + 1) // WIDTH, at // WIDTH + 1):
                lo, hi = max(0, at - c * WIDTH - WIDTH + 1), min(n - 1, at - c * WIDTH)
                core = raw[at - c * WIDTH : at - c * WIDTH - WIDTH + 1 + LENGTH]
                part = raw[lo : hi + LENGTH]
                out.append((ah, sh, lo, xxhash.xxh3_64_intdigest(core, c) - (1 << 63), xxhash.xxh3_128_digest(part), part))
        if out:
            yield _columns(out, (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), ["ah", "sh", "at", "finer", "name", "raw"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ah, sh, at, name) of each string of parts (ah, sh, at, raw)."""
    for batch in batches:
        out = [
            (ah, sh, at + k, xxhash.xxh3_128_digest(raw[k : k + LENGTH])) for ah, sh, at,
            raw in zip(*(c.to_pylist() for c in batch.columns)) for k in range(len(raw) - LENGTH + 1)
        ]
        if out:
            yield _columns(out, (pa.int64(), pa.binary(), pa.int32(), pa.binary()), ["ah", "sh", "at", "name"])


def _columns(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _segment_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ah, sh, bytes, hot) of the wanted segments (ah, sh, start, own, hot) of each text."""
    for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
        out: list[tuple] = []
        held = 0
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
            raw = text.as_py().encode() if isinstance(text, pa.StringScalar) else text.as_py()
            for x in wanted:
                piece = raw[x["start"] : x["start"] + x["own"] - 1 + LENGTH]
                out.append((x["ah"], x["sh"], piece, x["hot"]))
                held += len(piece)
            if held > 4 << 20:
                yield _named(out)
                out, held = [], 0
        if out:
            yield _named(out)


def _named(rows: list[tuple]) -> pa.RecordBatch:
    return _columns(rows, (pa.int64(), pa.binary(), pa.binary(), pa.bool_()), ["ah", "sh", "raw", "hot"])


SHARDED = "ah bigint, sh binary, runs binary"


def _solve(pieces_: DataFrame) -> DataFrame:
    """(ah, sh, runs) of the repeated strings of (ah, sh, raw), each ah's rows in one shard."""
    return pieces_.select("ah", "sh", "raw").repartition("ah").sortWithinPartitions("ah").mapInArrow(_shards, SHARDED)


def _finely(raw: DataFrame) -> DataFrame:
    """:func:`_solve` for segments of common anchors: in finer shards, of which the common ones go string by string."""
    parts = materialize(raw.select("ah", "sh", "raw").mapInArrow(_finer, "ah bigint, sh binary, at int, finer bigint, name binary, raw binary"), "parts")
    names = materialize(parts.groupBy("finer", "name").agg(F.count(F.lit(1)).alias("n")), "part-names")
    shards = names.groupBy("finer").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    few, many = shards.where(F.col("k") <= SHARD_SEGMENTS).select("finer"), shards.where(F.col("k") > SHARD_SEGMENTS).select("finer")
    own = parts.join(few, "finer", "left_semi").select(F.col("finer").alias("ah"), F.col("name").alias("sh"), "raw").dropDuplicates(["ah", "sh"])
    solved = _solve(own).select(F.col("ah").alias("finer"), F.col("sh").alias("name"), "runs")
    several = names.where("n > 1").select("name").distinct()
    equal = parts.select("ah", "sh", "at", "name", (F.octet_length("raw") - LENGTH + 1).alias("own")).join(several, "name", "left_semi").select(
        "ah", "sh", "at", F.concat(_bytes32(F.lit(0)), _bytes32(F.col("own"))).alias("runs")
    )
    shared = parts.select("ah", "sh", "at", "finer", "name").join(solved, ["finer", "name"]).select("ah", "sh", "at", "runs").unionByName(equal)
    strings = parts.join(many, "finer", "left_semi").select("ah", "sh", "at", "raw").mapInArrow(_strings, "ah bigint, sh binary, at int, name binary")
    strings = materialize(strings, "strings")
    often = strings.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    single = strings.join(often, "name", "left_semi").groupBy("ah", "sh").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return shared.mapInArrow(_moved, SHARDED).unionByName(single.mapInArrow(_from_places, SHARDED))


def _from_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ah, sh, runs) from the sorted places of a segment's repeated strings."""
    for batch in batches:
        runs = []
        for at in batch.column(2).to_pylist():
            flags = np.zeros(at[-1] + 1, bool)
            flags[at] = True
            runs.append(_runs(flags))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.binary())], names=["ah", "sh", "runs"])


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ah, sh, runs) from (ah, sh, at, runs), whose runs are counted from at."""
    for batch in batches:
        runs = [(np.frombuffer(r, np.int32) + at).astype(np.int32).tobytes() for at, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.binary())], names=["ah", "sh", "runs"])


def repeats(docs: DataFrame, *, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(t, whole, marks) of each text with repeated strings, and the few t of very many copies; ``t`` is the MD5 of the text's bytes.

    ``whole``: the text stands more than once, and so does every string of
    it; it has no marks.  ``marks``: its segments' starts, each with the runs
    of its repeated strings.  Texts of over a thousandth of all rows are in the second table,
    which has a thousand rows at most.
    """
    named = docs.select(F.unhex(F.md5(text)).alias("t"), F.col(text).alias("text")).where(F.octet_length("text") >= LENGTH)
    anchors = materialize(anchor_rows(named), "anchors")
    counts = materialize(named.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    least = max(1000, docs.count() // 1000)
    crowds = materialize(counts.where(F.col("n") >= least).select("t"), "crowds")
    # a segment of one text that stands in several of its blocks has a row of each, with different first starts
    one = F.struct("t", F.substring("starts", 1, 4).alias("s"), F.octet_length("starts").alias("z"))
    segments = anchors.groupBy("ah", "sh").agg(F.min(one).alias("a"), F.max(one).alias("b"), F.first("own").alias("own"))
    segments = materialize(
        segments.select(
            "ah", "sh", "own", F.col("a.t").alias("t"), F.col("a.s").alias("s"),
            ((F.col("a.t") != F.col("b.t")) | (F.col("a.s") != F.col("b.s")) | (F.col("a.z") > 4)).alias("multi")
        ),
        "segments"
    )
    groups = segments.groupBy("ah").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    wanted = segments.join(groups, "ah").select("t", F.struct("ah", "sh", _int32("s").alias("start"), "own", (F.col("k") > SHARD_SEGMENTS).alias("hot")).alias("x"))
    by_text = materialize(wanted.groupBy("t").agg(F.collect_list("x").alias("x")), "wanted")
    # of copies one brings the bytes; very many copies are made one before they meet
    bearing = by_text.select("t").join(F.broadcast(crowds), "t", "left_semi")
    few = named.join(F.broadcast(bearing), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    rest = named.join(F.broadcast(crowds), "t", "left_anti")
    bearers = rest.join(by_text, "t").groupBy("t").agg(F.first("text").alias("text"), F.first("x").alias("x")).select("text", "x")
    bearers = bearers.unionByName(few.join(by_text, "t").select("text", "x"))
    raw = materialize(bearers.mapInArrow(_segment_bytes, "ah bigint, sh binary, raw binary, hot boolean"), "segment-bytes")
    discard(by_text)
    release(docs.sparkSession)

    full = segments.where("multi").select("ah", "sh", F.concat(_bytes32(F.lit(0)), _bytes32(F.col("own"))).alias("runs"))
    found = _solve(raw.where("not hot")).unionByName(_finely(raw.where("hot"))).unionByName(full)
    # a whole text needs no marks: each of its copies would get those of the anchors of all of them
    marks = anchors.join(found, ["ah", "sh"]).select("t", F.struct("starts", "runs").alias("m")).join(counts.select("t"), "t", "left_anti")
    by_text = marks.groupBy("t").agg(F.collect_list("m").alias("marks")).select("t", F.lit(False).alias("whole"), "marks")
    return by_text.unionByName(counts.select("t", F.lit(True).alias("whole"), F.array().cast(by_text.schema["marks"].dataType).alias("marks"))), crowds


def _int32(column: str):
    """An int from its four little-endian bytes."""
    return F.conv(F.concat(*[F.hex(F.substring(column, k, 1)) for k in (4, 3, 2, 1)]), 16, 10).cast("int")


def _bytes32(value):
    """The four little-endian bytes of an int."""
    h = F.lpad(F.hex(value.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))


def removed_spans(size: int, whole: bool, marks: list[dict]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that repeated strings cover."""
    if whole:
        return [(0, size)]
    begins, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in marks:
        starts, runs = np.frombuffer(m["starts"], np.int32).astype(np.int64)[:, None], np.frombuffer(m["runs"], np.int32).reshape(-1, 2)
        begins.append((starts + runs[:, 0]).ravel())
        ends.append((starts + (runs[:, 1] - 1 + LENGTH)).ravel())
    delta = np.bincount(np.concatenate(begins), minlength=size + 1) - np.bincount(np.concatenate(ends), minlength=size + 1)
    covered = np.concatenate([[0], (np.cumsum(delta)[:-1] > 0).astype(np.int8), [0]])
    edge = np.diff(covered)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def remove_repeats(docs: DataFrame, *, text: str = "text", spans: str = "removed_spans", kept: str = "kept") -> DataFrame:
    """``docs`` with the removed spans of each text's UTF-8 bytes and the remaining bytes.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts
    anywhere else in the corpus, at another place of the same text included.
    Null and empty texts, and those of fewer bytes, keep all (null as no
    bytes).  Repeated rows are texts of their own, so all of one that is long
    enough goes.  Columns of the output's names are replaced.
    """
    base = docs.drop(spans, kept)
    columns = base.columns
    where = columns.index(text)
    found, crowds = repeats(docs, text=text)
    key, crowd = fresh(base, "t"), fresh(base, "crowd")
    # very many copies are whole ones: dealt by number, they match nothing and need nothing
    told = base.withColumn(key, F.unhex(F.md5(text))).join(F.broadcast(crowds.select(F.col("t").alias(key), F.lit(True).alias(crowd))), key, "left")
    told = told.withColumn(key, F.when(F.col(crowd), F.encode(F.monotonically_increasing_id().cast("string"), "utf-8")).otherwise(F.col(key)))
    found = found.select(F.col("t").alias(key), F.col("whole").alias("_whole"), F.col("marks").alias("_marks"))
    joined = told.join(found, key, "left").select(*columns, F.coalesce(crowd, "_whole").alias("_whole"), "_marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(lo, 256)
                out_spans, out_kept = [], []
                for t, whole, marks in zip(batch.column(where).to_pylist(), batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist()):
                    raw = (t or "").encode()
                    gone = removed_spans(len(raw), bool(whole), marks) if whole is not None else []
                    ends = [0, *[e for _, e in gone]]
                    begins = [*[s for s, _ in gone], len(raw)]
                    out_spans.append([{"start": s, "end": e} for s, e in gone])
                    out_kept.append(b"".join(raw[a:b] for a, b in zip(ends, begins)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(out_spans, _SPANS), pa.array(out_kept, pa.binary())], names=[*columns, spans, kept])

    whole_schema = T.StructType([
        *base.schema.fields,
        T.StructField(spans, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField(kept, T.BinaryType())
    ])
    return joined.mapInArrow(cut, whole_schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

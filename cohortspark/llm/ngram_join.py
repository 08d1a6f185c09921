"""N-gram Jaccard self-join with PartEnum signatures, and the classes it links.

Two sets with Jaccard similarity of at least 0.8 differ in at most a ninth of
their sizes' sum.  Sets are put into size bands, so that this is a number k
for a band.  The feature domain is partitioned by a hash into more than k
parts, of which two sets that differ in k features differ in at most k, so
that they agree in the others.  Each set emits a signature for each subset of
parts of a fixed size (two parts for small k, one for larger), and sets that
share a signature are candidates, which are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import crowds, discard, left_join, materialize, pieces, release, scope
from ._words import FOLD, SPACED, mix, word_hashes

SHINGLE = 5
#: Similar: 100 * intersection >= 80 * union.
PERCENT = 80
#: Features are counted in so many buckets; those of a very full one are too common to be candidates' sole evidence.
BUCKET_BITS = 20
SLICE = 1 << 14
#: Signatures of one bucket of the signature shuffle, about.
BUCKET_SIGNATURES = 1 << 20
#: Signatures that a task holds before it hands them on.
HELD = 1 << 20
#: Sets and features of a block of a family; two blocks are compared at a time.
BLOCK_SETS = 512
BLOCK_FEATURES = 1 << 20
#: Members of a group in a row; a larger group has several rows.
ROW_MEMBERS = 1 << 16
#: Features of at most so many sets of two blocks are counted by pairs.
FEW = 16

#: Sets that differ in at most so many features have signatures of two parts, others of one.
PAIRED = 6

_ODD = np.uint64(0x9E3779B97F4A7C15)


def chained(words: list[np.ndarray]) -> np.ndarray:
    """One hash of words that follow each other, each a bijection of the next word's hash."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        out = mix((out ^ w) * _ODD)
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes.

    Words are what white space separates, A-Z lower-cased.  Fewer words than
    a shingle has are one shingle, of all of them; no words, none.
    """
    words, _, _, first = word_hashes(FOLD[data], offsets, SPACED)
    n = len(words) - SHINGLE + 1
    whole = chained([words[k : k + n] for k in range(SHINGLE)]) if n > 0 else words[:0]
    out = []
    for a, b in zip(first[:-1], first[1:]):
        size = b - a
        if size >= SHINGLE:
            s = np.sort(whole[a : b - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif size:
            out.append(chained([words[k : k + 1] for k in range(a, b)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_name(s: np.ndarray) -> bytes:
    """A set's 128-bit name: equal sets have the same one."""
    return xxhash.xxh3_128_digest(s.tobytes())


def bands(largest: int) -> list[tuple[int, int]]:
    """(smallest, largest) size of each band, such that similar sets are in one band or in adjacent ones."""
    out, lo = [], 1
    while lo <= largest:
        hi = lo * 100 // PERCENT
        out.append((lo, hi))
        lo = hi + 1
    return out


def band_of(size: int, known: list[tuple[int, int]]) -> int:
    while known[-1][1] < size:
        lo = known[-1][1] + 1
        known.append((lo, lo * 100 // PERCENT))
    return int(np.searchsorted([hi for _, hi in known], size))


def most_different(largest: int) -> int:
    """The most features in which similar sets of at most this size can differ.

    With intersection I and union U, I / U >= p means a symmetric difference
    of at most (1 - p) / (1 + p) times the sum of the sizes.
    """
    return 2 * largest * (100 - PERCENT) // (100 + PERCENT)


def signatures(features: np.ndarray, rare: np.ndarray, size: int, known: list[tuple[int, int]]) -> np.ndarray:
    """The signatures of a set of ``size`` features.

    A set takes part in its own band's enumeration and in the next larger
    band's, as similar sets are in one band or in adjacent ones.  ``rare``
    are the features outside full buckets.  Parts are of the rare features
    alone if that leaves more non-empty parts than two similar sets can differ
    in: two such sets still agree in a subset of parts, and no signature is of
    common features alone.  If there are not that many, the set also takes
    part in enumerations over twice and more as many parts, and at last over
    all its features.  Whoever of a pair needs fewer parts has enough of them
    at a stage in which the other takes part as well, so every similar pair
    shares a signature.
    """
    out = []
    home = band_of(size, known)
    for band in (home, home + 1):
        if band == len(known):
            band_of(known[-1][1] + 1, known)
        k = most_different(known[band][1])
        for stage, (own, parts, together) in enumerate(_stages(features, rare, k)):
            part = (own % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sorted_part = part[order]
            begin = np.flatnonzero(np.concatenate([[True], sorted_part[1:] != sorted_part[:-1]])) if len(own) else np.zeros(0, np.int64)
            if len(begin):
                body = np.add.reduceat(mix(own + np.uint64(1))[order], begin)
                label = np.uint64(band) << np.uint64(44) | np.uint64(stage) << np.uint64(36)
                one = mix(body + mix(sorted_part[begin].astype(np.uint64) + label))
                if together == 1:
                    out.append(one)
                else:  # an empty part is a part like the others, but no subset is of empty parts alone
                    every = mix(mix(np.arange(parts, dtype=np.uint64) + label))
                    every[sorted_part[begin]] = one
                    full = np.zeros(parts, bool)
                    full[sorted_part[begin]] = True
                    sets = np.array(list(combinations(range(parts), together)))
                    sets = sets[full[sets].any(1)]
                    out.append(chained([every[sets[:, c]] for c in range(together)]))
            # every subset of that size of the parts that agree must hold a part that isn't empty
            if len(begin) > k:
                break
    return np.concatenate(out)


def _stages(features: np.ndarray, rare: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(features, parts, parts in a signature) of each enumeration."""
    if 0 < k <= PAIRED:
        yield rare, k + 2, 2
    parts = 1 if k == 0 else (k + 1) * 5 // 4 + 2
    for own in (rare, features):
        for grow in (1, 2, 8, 64):
            yield own, parts * grow, 1
    grow = 1024
    while True:  # all features in parts of their own, in the end
        yield features, parts * grow, 1
        grow *= 64


def verify(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar."""
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def text_digest(text: str) -> Column:
    """The MD5 of a text's bytes; null text has null."""
    return F.unhex(F.md5(F.col(text).cast("string")))


def set_heads(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, s) of every document, and which buckets of features are full.

    With ``digest`` also t, the MD5 of the text's bytes.

    Features are counted over all documents (equal sets in one task once), in
    a fixed number of buckets, whose counts are summed by executors.  Full is
    a bucket with over a thousandth of all documents' features, 50 and five
    halves of the mean.  The counts come as slices, one sum each.
    """
    n_buckets = 1 << BUCKET_BITS
    schema = "doc_id bigint, n bigint, s binary, slice int, counts binary" + ", t binary" * digest
    names = [x.split()[0] for x in schema.split(", ")]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(n_buckets, np.int32), set()
        for rows, data, offsets in pieces(batches, "text"):
            sets = shingle_sets(data, offsets)
            numbers = [set_name(s) for s in sets]
            for s, number in zip(sets, numbers):
                if number not in seen:
                    if len(seen) < 1 << 18:
                        seen.add(number)
                    counts += np.bincount((s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=n_buckets).astype(np.int32) if len(s) > n_buckets // 64 else 0
                    if len(s) <= n_buckets // 64:
                        np.add.at(counts, (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(numbers, pa.binary()),
                    pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.binary()), *rows.columns[2:]
                ],
                names=names
            )
        at = [k for k in range(n_buckets // SLICE) if counts[k * SLICE : (k + 1) * SLICE].any()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32()),
                pa.array([counts[k * SLICE : (k + 1) * SLICE].tobytes() for k in at], pa.binary()),
                *[pa.nulls(len(at), pa.binary())] * digest
            ],
            names=names
        )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), *[text_digest(text).alias("t")] * digest)
    made = materialize(rows.mapInArrow(heads, schema), "sets")
    heads_ = made.where("slice < 0").select("doc_id", "n", "s", *["t"] * digest)
    total = heads_.agg(F.count(F.lit(1)), F.sum("n")).first()
    least = max(50.0, total[0] / 1000, 2.5 * (total[1] or 0) / n_buckets)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.frombuffer(c, np.int32).astype(np.int64)
                sums[k] = sums[k] + got if k in sums else got
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([np.packbits(v > least).tobytes() for v in sums.values()], pa.binary())],
            names=["slice", "full"]
        )

    bits = made.where("slice >= 0").select("slice", "counts").repartition("slice").mapInArrow(full, "slice int, full binary").collect()
    out = np.zeros(n_buckets, bool)
    for r in bits:
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.unpackbits(np.frombuffer(r["full"], np.uint8))[:SLICE]
    return heads_, out


def candidate_groups(docs: DataFrame, full: np.ndarray, n_signatures: int, *, text: str = "text") -> DataFrame:
    """(g, z, members) of each signature that several sets share: the sets' names, sorted, one after the other.

    g is a hash of all members and z their number; a row has ``ROW_MEMBERS``
    of them at most, so that no row grows with a group.  Signatures travel packed: for each task and bucket of signatures the
    distinct sets' names, how many signatures each has there, and those.
    Equal sets of a task are one, so that copies are not repeated.
    """
    n_buckets = max(16, -(-n_signatures // BUCKET_SIGNATURES))
    packed = np.packbits(full).tobytes()

    def emit(held: list[tuple[bytes, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        names = np.array([n for n, _ in held], dtype="V16")
        who = np.repeat(np.arange(len(held)), [len(s) for _, s in held])
        sigs = np.concatenate([s for _, s in held])
        bucket = (sigs % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for k in range(n_buckets):
            part = order[at[k] : at[k + 1]]
            if len(part):
                own = who[part]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                count = np.diff(np.append(first, len(own))).astype(np.int32)
                short = (sigs[part] // np.uint64(n_buckets)).view(np.uint8).reshape(-1, 8)[:, :6]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k], pa.int32()), pa.array([names[own[first]].tobytes()], pa.binary()),
                        pa.array([count.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(short).tobytes()], pa.binary())
                    ],
                    names=["bucket", "sets", "counts", "sigs"]
                )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        known, held, size, seen = bands(1 << 12), [], 0, set()
        for _, data, offsets in pieces(batches, "text"):
            for s in shingle_sets(data, offsets):
                number = set_name(s)
                if not len(s) or number in seen:
                    continue
                if len(seen) < 1 << 18:
                    seen.add(number)
                rare = s[~bits[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]]
                held.append((number, signatures(s, rare, len(s), known)))
                size += len(held[-1][1])
                if size > HELD:
                    yield from emit(held)
                    held, size = [], 0
        yield from emit(held)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for k, sets, counts, sigs in zip(*(c.to_pylist() for c in b.columns)):
                raw = np.zeros((len(sigs) // 6, 8), np.uint8)
                raw[:, :6] = np.frombuffer(sigs, np.uint8).reshape(-1, 6)
                by_bucket.setdefault(k, []).append((sets, np.frombuffer(counts, np.int32), raw.view(np.uint64).ravel()))
        for blocks in by_bucket.values():
            own, counts, sigs = zip(*blocks)
            blocks.clear()
            names, number = numbered(b"".join(own))
            who, sigs = np.repeat(number, np.concatenate(counts)), np.concatenate(sigs)
            order = np.argsort(sigs, kind="stable")
            same = np.concatenate([[False], sigs[order][1:] == sigs[order][:-1]])
            keep = same | np.append(same[1:], False)
            order, same = order[keep], same[keep]
            begin = np.append(np.flatnonzero(~same), len(order))
            found: set[bytes] = set()
            for a, b in zip(begin[:-1], begin[1:]):
                members = np.unique(who[order[a:b]])
                if len(members) > 1:
                    found.add(names[members].tobytes())
            names = None
            held, size = [], 0
            for own in found:
                g, step = set_key(own), 16 * ROW_MEMBERS
                for lo in range(0, len(own), step):
                    held.append((g, len(own) // 16, own[lo : lo + step]))
                    size += len(held[-1][2])
                    if size > 16 * ROW_MEMBERS:
                        yield _grouped(held)
                        held, size = [], 0
            yield _grouped(held)

    rows = docs.select(F.col(text).cast("string").alias("text"))
    shipped = rows.mapInArrow(sign, "bucket int, sets binary, counts binary, sigs binary")
    return shipped.repartition(n_buckets, "bucket").mapInArrow(group, "g binary, z bigint, members binary")


def set_key(members: bytes) -> bytes:
    """A group's 128-bit name."""
    return xxhash.xxh3_128_digest(members)


def _grouped(held: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
    g, z, members = zip(*held) if held else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(g, pa.binary()), pa.array(z, pa.int64()), pa.array(members, pa.binary())], names=["g", "z", "members"])


def numbered(names: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 16-byte names in order, and the number of each name among them."""
    halves = np.frombuffer(names, ">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    ordered = halves[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)]) if len(order) else np.zeros(0, bool)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return np.frombuffer(names, "V16")[order[new]], out


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            own = part.column(2).to_pylist()
            size = np.array([len(x) // 16 for x in own])
            names = pa.Array.from_buffers(pa.binary(16), int(size.sum()), [None, pa.py_buffer(b"".join(own))])
            at = pa.array(np.repeat(np.arange(len(own)), size))
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), names.cast(pa.binary()), part.column(1).take(at)], names=["g", "v", "z"])


def group_members(groups: DataFrame) -> DataFrame:
    """(g, v, z): the members v of each group and its size."""
    return groups.select("g", "z", "members").mapInArrow(_exploded, "g binary, v binary, z bigint")


def crowded_groups(members: DataFrame) -> DataFrame:
    """(g) of the groups with the most members (see :func:`crowds`)."""
    return crowds(members.groupBy("g").agg(F.count(F.lit(1)).alias("k")), "g", "k", members.count())


def families(members: DataFrame, crowd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hub, v) twice: each set with its most popular hub only, and with every hub.

    A set is as popular as all its groups together are large, and the hub of a
    group is its most popular member.  Variants of a text share many signatures
    in many overlapping groups; their hub is the one that is nearest to the
    others.  The second table's families hold every pair that the groups hold.
    The groups of ``crowd`` are in no task of their own.
    """
    fame = members.groupBy("v").agg(F.sum("z").alias("fame"))
    hubs = members.join(fame, "v").groupBy("g").agg(F.max(F.struct("fame", "v")).alias("h"))
    hubs = materialize(hubs, "group-hubs")
    known = left_join(members, hubs, "g", crowd, _salt()).select("v", "h")
    best = known.groupBy("v").agg(F.max("h").alias("h")).select(F.col("h.v").alias("hub"), "v")
    return best, known.select(F.col("h.v").alias("hub"), "v").distinct()


def common(sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of the sets' intersection sizes.

    Features of one set only are left out; those of a few are counted pair by
    pair of their sets, those of many by matrix products.
    """
    m = len(sets)
    who = np.repeat(np.arange(m), [len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    who, flat = who[order], flat[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    df = np.diff(np.append(begin, len(flat)))
    pairs = [np.zeros(0, np.int64)]
    for d in np.unique(df):
        if d < 2 or d > FEW:
            continue
        lists = who[begin[df == d][:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i + 1, d):
                pairs.append(lists[:, i] * m + lists[:, j])
    whole = np.bincount(np.concatenate(pairs), minlength=m * m).reshape(m, m)
    whole = whole + whole.T
    many = np.flatnonzero(df > FEW)
    for lo in range(0, len(many), 1024):
        part = many[lo : lo + 1024]
        a = np.zeros((m, len(part)), np.float32)
        for k, f in enumerate(part):
            a[who[begin[f] : begin[f] + df[f]], k] = 1
        whole = whole + (a @ a.T).astype(np.int64)
    return whole


def linked_within(names: list[bytes], sets: list[np.ndarray], hub: bytes = b"") -> list[tuple[bytes, bytes]]:
    """Links that join the similar ones of some sets: (member, the hub if it reaches that, otherwise the smallest it reaches)."""
    least_of = lambda own: hub if hub in own else min(own)
    if len(sets) == 2:
        return [(n, least_of(names)) for n in names if n != least_of(names)] if verify(*sets) else []
    size = np.array([len(x) for x in sets])
    both = common(sets)
    np.fill_diagonal(both, 0)
    a, b = np.nonzero(np.triu(100 * both >= PERCENT * (size[:, None] + size[None, :] - both), 1))
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    classes: dict[int, list[bytes]] = {}
    for k, n in enumerate(names):
        classes.setdefault(root(k), []).append(n)
    return [(n, least_of(own)) for own in classes.values() for n in own if n != least_of(own)]


def family_links(docs: DataFrame, heads: DataFrame, family: DataFrame, doc_id: str, text: str, *, whole: bool) -> DataFrame:
    """(a, b) links that join similar sets of each family (hub, v).

    A family is cut into blocks of bounded numbers of sets and features.  If
    ``whole``, each pair of blocks is a task's work, and all similar sets of
    the family are joined; otherwise each block is compared within itself and
    with the hub, so that each set is sent once.  No pairs are emitted but
    links.  A set travels as the text of one document that has it, which is
    smaller than its features; they are made again in the block.
    """
    wanted = family.select(F.col("v").alias("s")).union(family.select(F.col("hub").alias("s"))).distinct()
    # copies of a set are one row before they meet it, so that no set is a task
    first = heads.where("doc_id is not null").groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    bearers = materialize(first.join(wanted, "s", "left_semi"), "bearers")
    known = materialize(family.join(bearers.select(F.col("s").alias("v"), "n"), "v"), "families")
    sizes = known.groupBy("hub").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_FEATURES)).cast("int").alias("blocks"))
    sizes = materialize(sizes.withColumn("k", F.col("blocks").cast("bigint") * BLOCK_SETS), "hub-sizes")
    crowd = crowds(sizes, "hub", "k", known.count())
    sizes = sizes.drop("k")
    own = left_join(known, sizes, "hub", crowd, _salt()).withColumn("b", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    if whole:
        spread = own.select("v", "hub", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x")).select(
            "v", F.struct("hub", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j")).alias("block")
        )
    else:
        hubs = sizes.select(F.col("hub").alias("v"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
        spread = own.where("v <> hub").select("v", "hub", "b").union(hubs).select("v", F.struct("hub", F.col("b").alias("i"), F.col("b").alias("j")).alias("block"))
    listed = spread.groupBy("v").agg(F.collect_list("block").alias("blocks")).join(bearers.select(F.col("s").alias("v"), "doc_id"), "v")
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).join(listed, "doc_id").select("v", "text", F.explode("blocks").alias("b"))
    dealt = rows.select("b.hub", "b.i", "b.j", "v", "text").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, own = None, [], []
        out: list[tuple[bytes, bytes]] = []
        for batch, data, offsets in pieces(batches, "text"):
            for hub, i, j, v, x in zip(*(c.to_pylist() for c in batch.columns[:4]), shingle_sets(data, offsets)):
                if set_name(x) != v:  # another text of the same id
                    continue
                if (hub, i, j) != key:
                    if len(names) > 1:
                        out += linked_within(names, own, hub=key[0])
                    key, names, own = (hub, i, j), [], []
                if not names or names[-1] != v:  # repeated rows bring a set twice
                    names.append(v), own.append(x)
            yield _pairs(out)
            out = []
        if len(names) > 1:
            out += linked_within(names, own, hub=key[0])
        yield _pairs(out)

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def _pairs(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for _, a in out], pa.binary()), pa.array([b for b, _ in out], pa.binary())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of each vertex of the edges (a, b): the smallest vertex reachable.

    Each round links every vertex's neighbours to its smallest one (larger
    neighbours, then all of them by turns), which halves paths; rounds are
    written to the shared folder and end when nothing changes.  Stars of a
    vertex are built by aggregation and joins, so no neighbourhood is
    gathered.
    """
    pairs = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, pairs = pairs, materialize(small, "small-star")
        discard(old, large)
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first())
        if now == before:
            break
        before = now
    stars = pairs.groupBy("u").agg(F.min("v").alias("label"))
    roots = stars.select(F.col("label").alias("v"), "label").distinct()
    return stars.select(F.col("u").alias("v"), "label").union(roots)


def link_sets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(heads, labels): doc_id, n and set name s of each document; set name and class label of each linked set.

    Sets that share a signature are candidates.  First each is compared with
    the hub of its largest family and with a bounded block of that family;
    this joins most near copies.  The groups that still hold sets of several
    classes then form families in which all pairs of blocks are compared, so
    that no link between different classes is lost.
    """
    heads, full = set_heads(docs, doc_id=doc_id, text=text, digest=digest)
    total = heads.agg(F.sum("n")).first()[0] or 0
    spark = docs.sparkSession
    with scope() as keep:
        groups = materialize(candidate_groups(docs, full, total * 2 // 3 + 1, text=text).distinct(), "groups")
        members = materialize(group_members(groups), "members")
        discard(groups)
        release(spark)
        crowd = crowded_groups(members)
        near = materialize(family_links(docs, heads, families(members, crowd)[0], doc_id, text, whole=False), "near-links")
        # a set has one link here, to its hub or to another of its block, and a hub to a more popular one
        release(spark)
        label = near.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("label"))
        for _ in range(2):
            label = materialize(label, "near-labels")
            label = label.join(label.select(F.col("v").alias("label"), F.col("label").alias("next")), "label", "left").select("v", F.coalesce("next", "label").alias("label"))
        told = members.join(label, "v", "left").withColumn("label", F.coalesce("label", "v"))
        open_ = told.groupBy("g").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("g")
        open_ = materialize(open_.withColumn("open", F.lit(True)), "open-groups")
        left = materialize(left_join(members, open_, "g", crowd, _salt()).where("open").drop("open"), "open-members")
        links = materialize(family_links(docs, heads, families(left, crowd)[1], doc_id, text, whole=True), "links")
        discard(members, left)
        release(spark)
        labels = keep(materialize(components(links.unionByName(near)), "labels"))
    return heads, labels


def _salt() -> Column:
    """A value of each row that is no set's name."""
    return F.encode(F.monotonically_increasing_id().cast("string"), "utf-8")


def _labelled(heads: DataFrame, labels: DataFrame) -> DataFrame:
    """The heads of documents with words and an id, each with its class's label."""
    own = heads.where("n > 0 and doc_id is not null")
    crowd = crowds(own.groupBy("s").agg(F.count(F.lit(1)).alias("k")), "s", "k", own.count())
    return left_join(own, labels.withColumnRenamed("v", "s"), "s", crowd, _salt()).withColumn("label", F.coalesce("label", "s"))


def similar_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    ``component_id`` is the smallest doc_id reachable by links, itself
    included.  Documents without words, null text included, have no shingles
    and no links; those with a null id have no links and a null component.
    Repeated rows are equal sets.  A very long text is one set of all its
    shingles, in one task.  Other columns are not read.  An empty table gives
    none.
    """
    heads, labels = link_sets(docs, doc_id=doc_id, text=text)
    told = materialize(_labelled(heads, labels), "told")
    least = materialize(told.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "classes")
    classed = left_join(told, least.drop("n"), "label", crowds(least, "label", "n", told.count()), _salt()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = heads.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return classed.union(alone)


def first_of_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, t) of one document of each class of similar ones: the smallest id, then the smallest MD5 t of the text.

    Ids may repeat: rows of one id with different texts are documents of
    their own.  Documents without words or with a null id are in no class.
    """
    heads, labels = link_sets(docs, doc_id=doc_id, text=text, digest=True)
    told = _labelled(heads, labels)
    return told.groupBy("label").agg(F.min(F.struct("doc_id", "t")).alias("m")).select("m.doc_id", "m.t")

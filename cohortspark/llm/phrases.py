"""Phrase collocations: merged count-min sketches choose n-grams, a second pass counts those exactly.

The sketch of all n-grams is as wide as the corpus is long, so no task and no
broadcast holds it: it is cut into shards of ``CELLS`` counters.  Each chunk of
text sends a shard its partial sketch, the shard adds them up and answers each
chunk with a bit for every cell it sent: whether the cell is heavy.  A chunk
then counts exactly the n-grams all of whose parts lie in heavy cells only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import discard, materialize
from ._words import mix

#: Phrases have up to so many words, and occur so often.
LONGEST, LEAST = 4, 30
#: Characters that end a piece; they and spaces and tabs are in no word.
ENDS = ".,;:!?\n\v\f\r"
#: Of a longer phrase's count to a shorter one's, from which the shorter is a part of it only, in hundredths.
SUBSUMED = 80
#: A language's report.
TOP = 2000

#: Bytes of text that are counted together.
CHUNK = 4 << 20
#: Rows of the sketch that n-grams of 1, 2, ... words are counted in: longer ones pass only if all their parts do.
DEPTHS = (2, 2, 1, 1)
#: Counters of a shard of the sketch, and n-grams a counter of a row.
CELLS, LOAD = 1 << 20, LEAST // 4

_FOLD = bytes(46 if chr(b) in ENDS else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def chunks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(chunk, lang, size, body): the texts of a language, folded, in chunks that end between pieces; a full stop is every piece's end.

    A chunk is of ``CHUNK`` bytes, or of one longer piece; it travels packed.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.col(text).cast("string")).where(F.octet_length(text) > 0)

    def cut(own: str, texts: list[bytes]) -> pa.RecordBatch:
        body, lo, parts = b".".join(texts), 0, []
        while len(body) - lo > 2 * CHUNK and (hi := body.find(b".", lo + CHUNK)) >= 0:
            parts.append(body[lo:hi])
            lo = hi + 1
        parts.append(body[lo:])
        packed = [zstandard.compress(x) for x in parts]
        return pa.RecordBatch.from_arrays([pa.array([own] * len(parts)), pa.array([len(x) for x in parts], pa.int64()), pa.array(packed, pa.binary())], names=["lang", "size", "body"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        held = 0
        for batch in batches:
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                folded = t.as_py().encode().translate(_FOLD)
                texts.setdefault(own, []).append(folded)
                sizes[own] = sizes.get(own, 0) + len(folded) + 1
                held += len(folded) + 1
                full = [own] if sizes[own] >= CHUNK else list(texts) if held >= 4 * CHUNK else []
                for x in full:
                    held -= sizes.pop(x)
                    yield cut(x, texts.pop(x))
        for x in texts:
            yield cut(x, texts[x])

    made = rows.mapInArrow(gather, "lang string, size bigint, body binary")
    return made.select(F.monotonically_increasing_id().alias("chunk"), "*")


class Grams:
    """The words of a packed chunk as numbers, and the hashes of its n-grams."""

    def __init__(self, lang: str, body: bytes) -> None:
        numbers: dict[bytes, int] = {b".": 0}
        tokens = zstandard.decompress(body).replace(b".", b" . ").split(b" ")
        self.ids = np.array([numbers.setdefault(w, len(numbers)) for w in tokens if w], np.int64)
        self.words = list(numbers)
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], np.uint64)

    def starts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each number of words (places, hashes) of the n-grams that lie in one piece."""
        out, h, inside = [], np.zeros(len(self.ids), np.uint64), np.ones(len(self.ids), bool)
        own, word = self.hashes[self.ids], self.ids > 0
        for n in range(1, LONGEST + 1):
            last = len(self.ids) - n + 1
            if last <= 0:
                out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
                continue
            inside = inside[:last] & word[n - 1 :]
            h = mix((h[:last] ^ own[n - 1 :]) * _ODD)
            places = np.flatnonzero(inside)
            out.append((places, h[places]))
        return out


def cells(h: np.ndarray, shards: int, depth: int) -> Iterator[np.ndarray]:
    """The cells in the first rows of the sketch; the row and shard are what stands above the counters of a shard."""
    bits = np.uint64(CELLS.bit_length() - 1)
    for row in range(depth):
        shard = ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        yield (shard + np.uint64(row * shards)) << bits | h & np.uint64(CELLS - 1)
        h = mix(h ^ _ODD)


def _distinct(hashes: list[np.ndarray], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of all n-grams in order, and how many n-grams are in each."""
    rows: list[list[np.ndarray]] = [[] for _ in range(max(DEPTHS))]
    for h, depth in zip(hashes, DEPTHS):
        for row, x in enumerate(cells(h, shards, depth)):
            rows[row].append(x)
    own, counts = [], []
    for parts in rows:  # rows lie one after the other
        x = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
        own.append(x[first])
        counts.append(np.diff(np.concatenate([first, [len(x)]])))
    return np.concatenate(own), np.concatenate(counts)


def _by_shard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shards, borders) of sorted cells."""
    shard = x // np.uint64(CELLS)
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    return shard[first].astype(np.int64), np.concatenate([first, [len(x)]])


def _packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted places as differences of 16 bits (65535 goes on), low bytes first, then the counts, of 8 bits where they are small."""
    gaps = np.diff(places.astype(np.int64), prepend=0)
    steps = gaps // 65535
    out = np.full(len(gaps) + int(steps.sum()), 65535, np.uint16)
    out[np.cumsum(steps + 1) - 1] = gaps % 65535
    small = np.minimum(counts, 255).astype(np.uint8)
    head = np.array([len(out), len(gaps)], "<u4")
    # planes of bytes: the high ones and the counts are nearly all equal
    low, high = (out & 255).astype(np.uint8), (out >> 8).astype(np.uint8)
    return zstandard.compress(head.tobytes() + low.tobytes() + high.tobytes() + small.tobytes() + counts[small == 255].astype("<u4").tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(raw)
    size, n = np.frombuffer(raw, "<u4", 2).tolist()
    plane = np.frombuffer(raw, np.uint8, 2 * size + n, offset=8)
    gaps = plane[:size] + plane[size : 2 * size].astype(np.int64) * 256
    counts = plane[2 * size :].astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u4", offset=8 + 2 * size + n)
    return np.cumsum(gaps)[gaps != 65535], counts


def _partial(shards: int):
    """Chunks to (shard, chunk, part): each chunk's partial sketch, a part for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, lang, body = (batch.column(c)[k].as_py() for c in ("chunk", "lang", "body"))
                own, counts = _distinct([h for _, h in Grams(lang, body).starts()], shards)
                if not len(own):
                    continue
                to, border = _by_shard(own)
                own = own & np.uint64(CELLS - 1)
                parts = [_packed(own[a:b], counts[a:b]) for a, b in zip(border, border[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([chunk] * len(to), pa.int64()), pa.array(parts, pa.binary())], names=["shard", "chunk", "part"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, chunk, part) in order of shards to (chunk, shard, heavy): a bit for each cell that the chunk sent.

    The parts of one shard are kept until all have been added; the number of
    shards grows with the corpus, so a shard's parts do not.
    """
    now, held = None, []

    def answers() -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for _, part in held:
            places, counts = _unpacked(part)
            total[places] += counts  # distinct places
        heavy = total >= LEAST
        bits = [np.packbits(heavy[_unpacked(part)[0]]).tobytes() for _, part in held]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.int64()), pa.array([now] * len(held), pa.int64()), pa.array(bits, pa.binary())], names=["chunk", "shard", "heavy"])

    for batch in batches:
        for shard, chunk, part in zip(*(batch.column(c).to_pylist() for c in ("shard", "chunk", "part"))):
            if shard != now and held:
                yield from answers()
                held = []
            now = shard
            held.append((chunk, part))
    if held:
        yield from answers()


def _listed(counted: list[tuple[bytes, int]]) -> bytes:
    """Phrases and their counts, packed; in order, so that equal beginnings are neighbours."""
    counted.sort()
    head = np.array([n for _, n in counted], "<u4")
    return zstandard.compress(len(head).to_bytes(4, "little") + head.tobytes() + b"\n".join([w for w, _ in counted]))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, counts) in order of language and bucket to (lang, phrase, n_words, n) of frequent phrases; a null phrase has the number of all words.

    The phrases of one bucket are held at a time; the number of buckets grows
    with the corpus, so a bucket's phrases do not.
    """
    now, total = None, {}

    def told() -> pa.RecordBatch:
        kept = [(w, n) for w, n in total.items() if n >= LEAST or not w]
        phrases = [w.decode() if w else None for w, _ in kept]
        sizes = [w.count(b" ") + 1 if w else 0 for w, _ in kept]
        return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(kept), pa.string()), pa.array(phrases, pa.string()), pa.array(sizes, pa.int32()), pa.array([n for _, n in kept], pa.int64())], names=["lang", "phrase", "n_words", "n"])

    for batch in batches:
        for lang, bucket, packed in zip(*(batch.column(c) for c in ("lang", "bucket", "counts"))):
            key = lang.as_py(), bucket.as_py()
            if key != now and total:
                yield told()
                total = {}
            now = key
            raw = zstandard.decompress(packed.as_py())
            size = int.from_bytes(raw[:4], "little")
            for w, n in zip(raw[4 + 4 * size :].split(b"\n"), np.frombuffer(raw, "<u4", size, offset=4).tolist()):
                total[w] = total.get(w, 0) + n
    if total:
        yield told()


def _exact(shards: int, buckets: int):
    """(lang, body, answers) to (lang, bucket, counts): a chunk's exact counts of its survivors, packed for each bucket of phrases; an empty phrase has the number of all words."""
    slots = 1 << 22

    def survivors(grams: Grams, answers: list[dict]) -> list[np.ndarray]:
        """For each number of words the places whose n-gram and all its parts lie in heavy cells."""
        starts = grams.starts()
        own, _ = _distinct([h for _, h in starts], shards)
        to, border = _by_shard(own)
        bits = {a["shard"]: a["heavy"] for a in answers}
        heavy = np.concatenate([np.unpackbits(np.frombuffer(bits[s], np.uint8), count=b - a) for s, a, b in zip(to.tolist(), border, border[1:])])
        # a table of the heavy cells' low bits; another cell of the same bits passes too, and is counted exactly
        table = np.zeros(slots, bool)
        spread = lambda x: (mix(x) & np.uint64(slots - 1)).astype(np.int64)
        table[spread(own[heavy.astype(bool)])] = True
        out: list[np.ndarray] = []
        for depth, (places, h) in zip(DEPTHS, starts):
            if out:  # both parts of one word less
                whole = good[places] & good[places + 1]
                places, h = places[whole], h[whole]
            passed = np.ones(len(h), bool)
            for row in cells(h, shards, depth):
                passed &= table[spread(row)]
            out.append(places[passed])
            good = np.zeros(len(grams.ids) + 1, bool)
            good[out[-1]] = True
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lang, body, answers = (batch.column(c)[k].as_py() for c in ("lang", "body", "answers"))
                grams = Grams(lang, body)
                words, counts = [b""], [int((grams.ids > 0).sum())]
                if answers:
                    number = np.zeros(len(grams.ids), np.int64)  # of the n-gram of one word less that starts at a place
                    for n, places in enumerate(survivors(grams, answers), 1):
                        key = number[places] * len(grams.words) + grams.ids[places + n - 1]
                        _, first, of, m = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                        number = np.zeros(len(grams.ids), np.int64)
                        number[places] = of
                        words += [b" ".join([grams.words[w] for w in grams.ids[p : p + n].tolist()]) for p in places[first].tolist()]
                        counts += m.tolist()
                dealt: dict[int, list[int]] = {}
                for k, w in enumerate(words):
                    dealt.setdefault(xxhash.xxh3_64_intdigest(w) % buckets, []).append(k)
                blobs = [_listed([(words[k], counts[k]) for k in own]) for own in dealt.values()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(dealt)), pa.array(list(dealt), pa.int64()), pa.array(blobs, pa.binary())], names=["lang", "bucket", "counts"])

    return run


def frequent_ngrams(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, n_words, n): exact counts of all n-grams of 1 to ``LONGEST`` words that occur ``LEAST`` times or more; a null phrase of 0 words has the number of all words.

    A sketch never counts too little, so nothing frequent is lost.
    """
    spark = docs.sparkSession
    body = materialize(chunks(docs, text, lang), "phrase-chunks")
    size = body.agg(F.sum("size")).first()[0] or 0
    # of some six bytes a word; whatever the number of shards, results are the same
    shards = max(1, -(-(size // 6 * LONGEST) // (CELLS * LOAD)))
    parts = max(max(DEPTHS) * shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = body.mapInArrow(_partial(shards), "shard bigint, chunk bigint, part binary")
    answers = sent.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_merge, "chunk bigint, shard bigint, heavy binary")
    answered = answers.groupBy(F.col("chunk").alias("to")).agg(F.collect_list(F.struct("shard", "heavy")).alias("answers"))
    told = body.join(answered, body["chunk"] == answered["to"], "left").select("lang", "body", "answers").mapInArrow(_exact(shards, shards), "lang string, bucket bigint, counts binary")
    # packed, a phrase of many chunks costs some bytes in each, not a row
    summed = told.repartition(parts, "lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(_summed, "lang string, phrase string, n_words int, n bigint")
    out = materialize(summed, "phrase-counts")
    discard(body)
    return out


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(25,0)")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", top: int | None = TOP) -> DataFrame:
    """Each language's phrases of 2 to 4 words by score: lang, rank, phrase, a, l, r, n, score.

    A phrase is of the words of one piece of a text; a, l, r are the counts of
    it and of the two parts of its worst cut, n that of the language's words.
    The score of a cut is floor(2000000 a / (l + r)), exactly; of equal cuts
    the first counts.  A phrase that stands in a longer one of 80 hundredths
    of its count or more is left out.  Ranks go by score, then a, both from
    the largest, then phrase in byte order, so ties do not arise; ``top`` None
    ranks all.

    Null and empty texts have no words; a null language is ``und``.  Repeated
    rows and null ids count as rows.  A text without separators is one piece
    and one task's.  Other columns are not read.  An empty table gives none.
    """
    counts = frequent_ngrams(docs, text=text, lang=lang)
    known = counts.where("n_words between 1 and 3").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    phrases = counts.where("n_words > 1").select("lang", "phrase", "n_words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda lo, size: F.array_join(F.slice("w", lo, size), " ")
    cut = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    # both parts tell the phrase, which therefore does not travel
    sides = cut.select("lang", "a", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"))
    left = sides.join(known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    both = left.join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.call_function("div", _wide("a") * F.lit(2_000_000).cast("decimal(8,0)"), _wide("l") + _wide("r"))
    own = both.select("lang", "a", F.concat_ws(" ", "first", "rest").alias("phrase"), F.struct(score.alias("score"), F.size(F.split("first", " ")).alias("k"), "l", "r").alias("z"))
    worst = own.groupBy("lang", "phrase", "a").agg(F.min("z").alias("z"))
    spans = F.expr("flatten(transform(sequence(2, n_words - 1), s -> transform(sequence(1, n_words - s + 1), p -> array_join(slice(w, p, s), ' '))))")
    within = phrases.where("n_words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left_over = worst.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * SUBSUMED))
    total = counts.where(F.col("phrase").isNull()).select("lang", F.col("n").alias("all"))
    order = [F.col("z.score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:  # a language's first are among its parts' first
        by_part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order)
        left_over = left_over.withColumn("rank", F.row_number().over(by_part)).where(F.col("rank") <= top).drop("rank")
    ranked = left_over.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("z.l").alias("l"), F.col("z.r").alias("r"), F.col("all").alias("n"), F.col("z.score").cast("bigint").alias("score"))

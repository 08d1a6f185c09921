"""SentencePiece encoding and decoding as a max-plus scan.

A BPE encoding is the one segmentation in which any two neighbouring pieces
could not have merged otherwise, and whether they could depends on these two
alone.  So it is a best path over states (place, last piece) with moves of a
score for pieces that may follow each other and minus infinity for others,
and in the (max, +) semiring a product of transfer matrices.  A chunk of a
giant text leads from the states at its start, a last piece and how many
characters before the start it ends, to those at its end.  Giant texts are cut
into chunks, their matrices are made independently and combined associatively
in a tree, the states between chunks are read off the tree, and each chunk's
pieces are then found independently between its two states.

The encoding is that of the SentencePiece library with the same model file.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import crowds, fresh, materialize

SPACE = "▁"
#: Characters of a chunk; longer texts are cut.
CHUNK = 1 << 15
#: Copies of one giant text that a task is given, about.
COPIES = 1000
#: A chunk ends before a space among its last characters, if there is one.
LOOK_BACK = 1 << 10
#: Matrices that a task combines.
FAN = 64
#: Segments whose pieces a task remembers.
REMEMBERED = 400_000
#: Segments of more characters are encoded as a path, and not remembered.
LONG = 128

NEVER = -(1 << 60)
NEVER_MERGED = 1 << 60
#: The last piece where nothing stands before.
START = -1


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and their numbers, how each piece is merged, the numbers of the 256 bytes, and each number's bytes.

    ``rank`` is the order of the merges, 0 for a single character; ``left``
    and ``right`` are the two pieces of a piece's last merge.  Pieces that no
    merges lead to are left out.  A character that is no piece is encoded as
    its UTF-8 bytes.
    """

    pieces: dict[str, int]
    rank: dict[int, int]
    left: dict[int, int]
    right: dict[int, int]
    bytes_at: tuple[int, ...]
    raw: tuple[bytes, ...]
    longest: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a BPE model file with byte pieces that leaves texts as they are but for a space before them; others are refused.

        What is encoded here is what the library encodes for such a model.
        Of other kinds (unigram, words, characters), of other normalisers,
        and of pieces that the user has set, it would not be.
        """
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        made, form = model.trainer_spec, model.normalizer_spec
        wrong = {
            "no BPE model": made.model_type != made.BPE,
            "no pieces for bytes": not made.byte_fallback,
            "space as a suffix": made.treat_whitespace_as_suffix,
            "a normaliser that changes characters": bool(form.precompiled_charsmap or form.normalization_rule_tsv),
            "a normaliser that removes spaces": form.remove_extra_whitespaces,
            "no space before a text": not form.add_dummy_prefix,
            "spaces that are not escaped": not form.escape_whitespaces,
            "pieces set by the user": any(x.type in (x.USER_DEFINED, x.UNUSED) for x in model.pieces),
        }
        if any(wrong.values()):
            raise ValueError(f"{path}: " + ", ".join(k for k, v in wrong.items() if v))
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found, at, raw = {}, [0] * 256, []
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                at[int(piece[1:-1], 16)] = k
                raw.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(k) or sp.is_unknown(k):
                raw.append(b"")
            else:
                found[piece] = sp.get_score(k)
                raw.append(piece.replace(SPACE, " ").encode())
        order = {x: n + 1 for n, x in enumerate(sorted({x for p, x in found.items() if len(p) > 1}, reverse=True))}
        merged = {p: order[x] for p, x in found.items() if len(p) > 1}
        number = {p: sp.piece_to_id(p) for p in found}
        pieces, rank, left, right = {}, {}, {}, {}
        for p, k in number.items():
            halves = _last_merge(p, merged)
            if len(p) == 1:
                pieces[p], rank[k] = k, 0
            elif halves and all(h in number for h in halves):
                pieces[p], rank[k] = k, merged[p]
                left[k], right[k] = (number[h] for h in halves)
        return cls(pieces, rank, left, right, tuple(at), tuple(raw), max(map(len, pieces)))


def _last_merge(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The two parts that the merges of a piece's characters end with, if they end with the piece."""
    parts = list(piece)
    while len(parts) > 2:
        best = min(((rank.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            return None
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 and piece in rank else None


class Segmenter:
    """Encodings of texts in which spaces are ``SPACE``.

    No piece holds a space after another character or a character of no
    piece, so texts fall into segments that are encoded one by one, and
    ``known`` remembers those of short segments.  A character that is no
    piece is the piece ``outside`` plus its code point here.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.outside = len(vocabulary.raw)
        self.order = {p: vocabulary.rank[k] for p, k in vocabulary.pieces.items() if len(p) > 1}
        self.text = {k: p for p, k in vocabulary.pieces.items()}
        inside = "".join(sorted({c for p in vocabulary.pieces for c in p} - {SPACE}))
        own = re.escape(inside)
        self.pattern = re.compile(f"{SPACE}+[{own}]*|[{own}]+|[^{own}{SPACE}]")
        self.newline = "\n" not in inside

    def may_follow(self, a: int, b: int) -> bool:
        """Whether pieces a and b can stand side by side: at no time have the parts that meet there merged."""
        got = self.follows.get((a, b))
        if got is None:
            got = self.follows[a, b] = a < 0 or a >= self.outside or b >= self.outside or self._meet(a, b)
        return got

    def _meet(self, a: int, b: int) -> bool:
        # the merges are undone from the last on, equal ones from the right
        v, text, before = self.v, self.text, 1 << 60
        while True:
            whole = v.pieces.get(text[a] + text[b])
            if whole is not None and v.rank[whole] < before:
                return False
            if v.rank[a] > v.rank[b]:
                before, a = v.rank[a], v.right[a]
            elif v.rank[b]:
                before, b = v.rank[b] + 1, v.left[b]
            else:
                return True

    def ends(self, text: str, end: int) -> Iterator[tuple[int, int]]:
        """(start, piece) of the pieces that could end at a place, the longest first."""
        get = self.v.pieces.get
        for s in range(max(0, end - self.v.longest), end):
            piece = get(text[s:end])
            if piece is not None:
                yield s, piece
            elif s == end - 1:
                yield s, self.outside + ord(text[s])

    def merges(self, segment: str) -> bytes:
        """:meth:`path` of a short segment: its characters merged pair by pair, the first of the smallest rank."""
        rank, parts = self.order.get, list(segment)
        ranks = [rank(a + b, NEVER_MERGED) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NEVER_MERGED:
                break
            k = ranks.index(low)
            parts[k] += parts.pop(k + 1)
            del ranks[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], NEVER_MERGED)
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], NEVER_MERGED)
        number = self.v.pieces.get
        found = [number(p, -1) for p in parts]
        return self.path(segment) if -1 in found else array("i", found).tobytes()

    def path(self, text: str, start: int = 0, last: int = START, least: int = 0, goal: int | None = None) -> bytes:
        """Numbers (int32 bytes) of the pieces from a place after a piece to the end of the text.

        The first piece ends beyond ``least``, the last one is ``goal`` if that is given.
        """
        if not start and last == START and goal is None and (whole := self.v.pieces.get(text)) is not None:
            return np.int32(whole).tobytes()
        at: list[dict[int, int]] = [{} for _ in range(len(text) + 1)]  # piece that ends there: where it starts
        before: list[dict[int, int]] = [{} for _ in range(len(text) + 1)]  # and the piece before it
        at[start][last] = -1
        for e in range(max(start, least) + 1, len(text) + 1):
            for s, piece in self.ends(text, e):
                for p in at[s] if s >= start else ():
                    if (s == start or s > least) and self.may_follow(p, piece):
                        at[e][piece], before[e][piece] = s, p
                        break
        e, piece, out = len(text), goal, []
        if piece is None:
            piece = next(iter(at[e]))
        while e > start:
            out.append(piece)
            e, piece = at[e][piece], before[e][piece]
        return self.numbers(out[::-1])

    def numbers(self, pieces: list[int]) -> bytes:
        out: list[int] = []
        for k in pieces:
            if k >= self.outside:
                out += [self.v.bytes_at[b] for b in chr(k - self.outside).encode("utf-8", "surrogatepass")]
            else:
                out.append(k)
        return np.array(out, np.int32).tobytes()

    def segments(self, text: str) -> list[str]:
        """The text's segments; some may be empty."""
        if "\x00" in text or SPACE * 2 in text or not self.newline:
            return self.pattern.findall(text)
        return text.replace(SPACE, "\x00" + SPACE).replace("\n", "\x00\n\x00").split("\x00")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        parts = [self.segments(t) for t in texts]
        wanted = set().union(*parts)
        new = [x for x in wanted if x not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(wanted)
        self.known.update((x, self.merges(x) if len(x) <= LONG else self.path(x)) for x in new)
        out = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        for x in new:
            if len(x) > LONG:
                del self.known[x]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def states(self, context: str) -> list[tuple[int, int]]:
        """(characters before the end of the context, piece that ends there) of the states there; a text's start is one."""
        out = []
        for back in range(min(self.v.longest, len(context) + 1)):
            end = len(context) - back
            out += [(back, piece) for _, piece in self.ends(context, end)] if end else [(back, START)]
        return out

    def transfer(self, context: str, chunk: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray, int, bytes, int]:
        """(states before, states after, matrix, from, numbers, to) of a chunk.

        An entry is the number of pieces on the path between two states, or
        ``NEVER``.  ``context`` are the up to ``2 * longest`` characters before
        the chunk, all if it is shorter.  Where a word begins every path has a
        boundary, and what follows does not depend on what stands before, so
        between the first and the last such place (from, to: counted from the
        context's start) there is one path for all: its numbers are found
        here.  Without such a place both are -1.
        """
        text, start = context + chunk, len(context)
        into = self.states(context)
        begin: dict[int, dict[int, np.ndarray]] = {}
        for k, (back, piece) in enumerate(into):
            unit = np.full(len(into), NEVER, np.int64)
            unit[k] = 0
            begin.setdefault(start - back, {})[piece] = unit
        first = self._cut(text, start + 1, 1)
        last = self._cut(text, len(text) - self.v.longest, -1)
        if first < 0 or last < first:
            rows = self._rows(text, begin, start)
            first, middle, last = -1, b"", -1
        else:
            head = np.max([*self._rows(text[:first], begin, start)[first].values()], axis=0)
            middle = self.encode(text[first:last])
            rows = {last + p: own for p, own in self._rows(text[last:], {0: {START: head + len(middle) // 4}}, 0).items()}
        out = [(len(text) - p, piece) for p in sorted(rows, reverse=True) if len(text) - p < self.v.longest for piece in rows[p]]
        matrix = np.stack([np.maximum(rows[len(text) - back][piece], NEVER) for back, piece in out], 1)
        return into, out, np.where(matrix < 0, NEVER, matrix), first, middle, last

    def _cut(self, text: str, at: int, way: int) -> int:
        """The first place from ``at`` on (or back from it) where a word begins, or -1."""
        while True:
            at = text.find(SPACE, at) if way > 0 else text.rfind(SPACE, 0, max(at + 1, 0))
            if at <= 0:
                return -1
            if text[at - 1] != SPACE:
                return at
            at += way

    def _rows(self, text: str, begin: dict[int, dict[int, np.ndarray]], start: int) -> dict[int, dict[int, np.ndarray]]:
        """For each place and piece that ends there the best scores from the states up to ``start``."""
        rows = dict(begin)
        for e in range(start + 1, len(text) + 1):
            own: dict[int, np.ndarray] = {}
            for s, piece in self.ends(text, e):
                for p, row in rows.get(s, {}).items():
                    if self.may_follow(p, piece):
                        own[piece] = np.maximum(own[piece], row + 1) if piece in own else row + 1
            rows[e] = own
            rows.pop(e - 2 * self.v.longest, None)
        return rows


def normalized(text: str) -> list[str]:
    """The text's parts between literal SPACE characters, with spaces as SPACE and one put before all."""
    return [p.replace(" ", SPACE) for p in (" " + text).split(SPACE)]


def encode_texts(texts: list[str | None], seg: Segmenter) -> list[bytes | None]:
    """Whole texts' numbers; an empty text has none, a literal SPACE character is encoded as its bytes."""
    literal = np.array([seg.v.bytes_at[b] for b in SPACE.encode()], np.int32).tobytes()
    parts = [normalized(t) if t else [] for t in texts]
    done = iter(seg.encode_all([p for own in parts for p in own]))
    return [literal.join([next(done) for _ in own]) if t is not None else None for t, own in zip(texts, parts)]


def encode_text(text: str, seg: Segmenter) -> bytes:
    return encode_texts([text], seg)[0]


def decode_ids(ids: np.ndarray, raw_at: np.ndarray) -> str:
    """The text of the numbers (an index array into ``raw_at``); without the space that encoding puts first."""
    raw = b"".join(raw_at[ids].tolist())
    return raw[raw[:1] == b" " :].decode("utf-8", "replace")


def raw_table(vocabulary: Vocabulary) -> np.ndarray:
    out = np.empty(len(vocabulary.raw), object)
    out[:] = vocabulary.raw
    return out


def cut(text: str, chunk: int = CHUNK, look_back: int = LOOK_BACK) -> list[int]:
    """Chunk bounds of a normalised text: before a word's space near the limit, or else at the limit."""
    out = [0]
    while len(text) - out[-1] > chunk:
        end = out[-1] + chunk
        at = text.rfind(SPACE, max(out[-1] + 1, end - look_back), end)
        while at > out[-1] + 1 and text[at - 1] == SPACE:
            at -= 1
        out.append(at if at > max(out[-1], end - look_back) else end)
    return [*out, len(text)]


#: A matrix with the states that its rows and columns are of, packed.
Matrix = tuple[bytes, bytes, bytes]


def _label(states: list[tuple[int, int]]) -> bytes:
    return np.array([back << 32 | piece + 1 for back, piece in states], np.int64).tobytes()


def _unlabel(label: int) -> tuple[int, int]:
    return label >> 32, (label & (1 << 32) - 1) - 1


def _open(m: Matrix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    before, after = np.frombuffer(m[0], np.int64), np.frombuffer(m[1], np.int64)
    return before, after, np.frombuffer(m[2], np.int64).reshape(len(before), len(after))


def _placed(labels: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns of ``values`` (for ``labels``) in the order of ``wanted``; states that were not reached have NEVER."""
    out = np.full((len(values), len(wanted)), NEVER, np.int64)
    at = {x: k for k, x in enumerate(labels.tolist())}
    for k, x in enumerate(wanted.tolist()):
        if x in at:
            out[:, k] = values[:, at[x]]
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    """The two chunks as one, in (max, +)."""
    into, mid, left = _open(a)
    own, out, right = _open(b)
    left = _placed(mid, own, left)
    best = np.full((len(into), len(out)), NEVER, np.int64)
    for k in range(len(own)):
        np.maximum(best, np.where((left[:, k, None] < 0) | (right[None, k] < 0), NEVER, left[:, k, None] + right[None, k]), out=best)
    return a[0], b[1], best.tobytes()


def between(matrices: list[Matrix], before: int, after: int) -> list[tuple[int, int]]:
    """(state before, state after) of each of some chunks, from the states at both ends of them all."""
    prefix, labels = [], []
    vector, own = np.zeros((1, 1), np.int64), np.array([before])
    for m in matrices:
        into, out, values = _open(m)
        vector = _placed(own, into, vector)
        prefix.append(vector[0]), labels.append(into)
        vector = np.where((vector[0][:, None] < 0) | (values < 0), NEVER, vector[0][:, None] + values).max(0)[None]
        own = out
    result = []
    for m, vector, into in zip(matrices[::-1], prefix[::-1], labels[::-1]):
        _, out, values = _open(m)
        column = values[:, int(np.flatnonzero(out == after)[0])]
        best = int(into[int(np.where((vector < 0) | (column < 0), NEVER, vector + column).argmax())])
        result.append((best, after))
        after = best
    return result[::-1]


def _level(rows: DataFrame) -> DataFrame:
    """Matrices of ``FAN`` chunks (key, part, n, before, after, m) each combined."""

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n")
        whole = None
        for m in zip(group["before"], group["after"], group["m"]):
            whole = m if whole is None else product(whole, m)
        return pd.DataFrame({
            "key": group["key"].iloc[:1], "part": group["part"].iloc[0], "n": group["n"].iloc[0] // FAN, "before": [whole[0]],
            "after": [whole[1]], "m": [whole[2]]
        })

    return rows.groupBy("key", "part", F.expr(f"n div {FAN}").alias("g")).applyInPandas(combine, "key string, part int, n int, before binary, after binary, m binary")


def boundary_states(rows: DataFrame) -> DataFrame:
    """(key, part, n, enter, leave): the states at both ends of each chunk (key, part, n, before, after, m).

    Matrices are combined up a tree until ``FAN`` are left of a text; then
    each node's two states give those of its children, down the tree.  No
    task has more than ``FAN`` matrices of a text.
    """
    levels = [rows]
    most = rows.agg(F.max("n")).first()[0] or 0
    while most >= FAN:
        levels.append(materialize(_level(levels[-1]), "matrices"))
        most //= FAN
    told = None
    for own in reversed(levels):
        if told is None:
            joined = own.select("*", F.lit(0).alias("g"), *[F.lit(None).cast("bigint").alias(c) for c in ("from", "to")])
        else:
            joined = own.withColumn("g", F.expr(f"cast(n div {FAN} as int)")).join(
                told.select("key", "part", F.col("n").alias("g"), F.col("enter").alias("from"), F.col("leave").alias("to")),
                ["key", "part", "g"]
            )

        def split(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("n")
            own = list(zip(group["before"], group["after"], group["m"]))
            if group["from"].isna().iloc[0]:
                # the whole text: from its start to its end
                out = _open(own[-1])[1]
                whole = np.zeros((1, 1), np.int64), np.array([0])
                for m in own:
                    into, after, values = _open(m)
                    vector = _placed(whole[1], into, whole[0])[0]
                    whole = np.where((vector[:, None] < 0) | (values < 0), NEVER, vector[:, None] + values).max(0)[None], after
                done = [(v, x) for v, x in zip(whole[0][0].tolist(), out.tolist()) if x >> 32 == 0]
                start, end = 0, max(done)[1]
            else:
                start, end = int(group["from"].iloc[0]), int(group["to"].iloc[0])
            ends = between(own, start, end)
            return pd.DataFrame({"key": group["key"], "part": group["part"], "n": group["n"], "enter": [a for a, _ in ends], "leave": [b for _, b in ends]})

        told = joined.groupBy("key", "part", "g").applyInPandas(split, "key string, part int, n int, enter bigint, leave bigint")
        if own is not levels[0]:
            told = materialize(told, "boundaries")
    return told


def _ids_array(column: list[bytes | None]) -> pa.Array:
    """A list<int> array from int32 bytes."""
    size = np.array([len(x) // 4 if x is not None else 0 for x in column])
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    flat = pa.array(np.frombuffer(b"".join(x for x in column if x is not None), np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([x is None for x in column]))


def encode(docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text", ids: str = "ids", chunk: int = CHUNK, decoded: str | None = None) -> DataFrame:
    """``docs`` with the numbers of each whole text's pieces (array of int).

    Null text has null, an empty text an empty array; an existing column of
    that name is replaced.  Texts of more than ``chunk`` characters are
    encoded by the scan; equal texts among them once.  Literal SPACE
    characters are encoded as their bytes, so that decoding gives them back;
    otherwise the numbers are those of the library.  Of neighbouring pairs of
    equal rank the first is merged, as there.  Repeated rows are encoded alike,
    each in its row, and an empty table gives none.

    With ``decoded``, a column of that name has what :func:`decode` makes of
    the numbers.  It is made in the task that made these, so that each task
    keeps one Python worker busy and not two.
    """
    asked = [decoded] if decoded else []
    base = docs.drop(ids, *asked)
    names = [*base.columns, ids, *asked]
    schema = T.StructType([*base.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *[T.StructField(c, T.StringType()) for c in asked]])
    giant = F.coalesce(F.char_length(text) > chunk, F.lit(False))
    where = base.columns.index(text)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, table = Segmenter(vocabulary), raw_table(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = encode_texts(part.column(where).to_pylist(), seg)
                back = [pa.array([decode_ids(np.frombuffer(x, np.int32), table) if x is not None else None for x in got], pa.string()) for _ in asked]
                yield pa.RecordBatch.from_arrays([*part.columns, _ids_array(got), *back], names=names)

    key = fresh(base, "key")
    giants = base.where(giant).withColumn(key, F.sha2(F.col(text), 256))
    texts = giants.select(F.col(key).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    found = _encode_giants(texts, vocabulary, chunk).withColumnsRenamed({"key": key, "ids": ids})
    # copies of a text that very many rows have are dealt over several tasks, each with its numbers once
    copies, deal = fresh(base, "copies", key), fresh(base, "deal", key)
    counts = materialize(giants.groupBy(key).agg(F.count(F.lit(1)).alias(copies)), "giant-copies")
    most = crowds(counts, key, copies, counts.agg(F.sum(copies)).first()[0] or 0)
    dealt = F.broadcast(counts.join(F.broadcast(most), key, "left_semi").select(key, F.ceil(F.col(copies) / COPIES).cast("int").alias(copies)))
    deals = F.coalesce(F.col(copies), F.lit(1))
    own = giants.join(dealt, key, "left").withColumn(deal, F.pmod(F.monotonically_increasing_id(), deals).cast("int")).drop(copies)
    numbers = found.join(dealt, key, "left").withColumn(deal, F.explode(F.sequence(F.lit(0), deals - 1))).drop(copies)
    long = own.join(numbers, [key, deal]).select(*base.columns, ids)
    return base.where(~giant).mapInArrow(small, schema).unionByName(decode(long, vocabulary, ids=ids, text=decoded) if decoded else long)


def _encode_giants(texts: DataFrame, vocabulary: Vocabulary, chunk: int) -> DataFrame:
    """(key, ids) of giant texts, chunk by chunk.

    ``part`` counts the parts of a text between literal SPACE characters,
    which are texts of their own; ``n`` counts a part's chunks, -1 is the
    literal SPACE before a part.
    """
    reach = 2 * vocabulary.longest

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for p, part in enumerate(normalized(text)):
                    rows = [(key, p, -1, SPACE, "")] if p else []
                    bounds = cut(part, chunk)
                    rows += [(key, p, n, part[a:b], part[max(0, a - reach) : a]) for n, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
                    for r in rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([v], t) for v, t in zip(r, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))],
                            names=["key", "part", "n", "chunk", "context"]
                        )

    cut_up = materialize(texts.mapInArrow(chunks, "key string, part int, n int, chunk string, context string"), "chunks")
    spread = cut_up.repartition("key", "part", "n")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(vocabulary)
        types = (pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.binary(), pa.int32())
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, context = batch.column(3)[k].as_py(), batch.column(4)[k].as_py()
                if batch.column(2)[k].as_py() < 0:
                    row = (None, None, None, SPACE, -1, np.array([vocabulary.bytes_at[b] for b in SPACE.encode()], np.int32).tobytes(), -1)
                else:
                    before, after, m, first, middle, last = seg.transfer(context, chunk)
                    row = (_label(before), _label(after), m.tobytes(), context + chunk, first, middle, last)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(k, 1) for c in range(3)] + [pa.array([len(context)], pa.int32())] + [pa.array([x], t) for x, t in zip(row, types)],
                    names=["key", "part", "n", "start", "before", "after", "m", "whole", "first", "middle", "last"]
                )

    made = materialize(
        spread.mapInArrow(matrices, "key string, part int, n int, start int, before binary, after binary, m binary, whole string, first int, middle binary, last int"),
        "transfer"
    )
    fixed = boundary_states(made.where("n >= 0").select("key", "part", "n", "before", "after", "m"))
    joined = made.select("key", "part", "n", "start", "whole", "first", "middle", "last").join(fixed, ["key", "part", "n"], "left")

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(vocabulary)
        for batch in batches:
            got = []
            for _, _, _, start, whole, first, middle, last, enter, leave in zip(*(x.to_pylist() for x in batch.columns)):
                if enter is None:
                    got.append(middle)
                    continue
                (back, piece), (short, goal) = _unlabel(enter), _unlabel(leave)
                end = len(whole) - short
                if end <= start - back:  # one piece from before the chunk to beyond it
                    got.append(b"")
                elif first < 0:
                    got.append(seg.path(whole[:end], start - back, piece, start if back else start - back, goal))
                else:
                    head = seg.path(whole[:first], start - back, piece, start if back else start - back)
                    tail = seg.path(whole[last:end], goal=goal) if end > last else b""
                    got.append(head + middle + tail)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _ids_array(got)], names=["key", "part", "n", "ids"])

    parts = joined.select("key", "part", "n", "start", "whole", "first", "middle", "last", "enter", "leave").mapInArrow(backtrace, "key string, part int, n int, ids array<int>")
    return parts.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "n", "ids"))), lambda x: x["ids"])).alias("ids"))


def decode(df: DataFrame, vocabulary: Vocabulary, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its numbers; null for null.  Decoding what :func:`encode` made gives its text back."""
    base = df.drop(text)
    names = [*base.columns, text]
    schema = T.StructType([*base.schema.fields, T.StructField(text, T.StringType())])
    where = base.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = raw_table(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(where)
                got = [decode_ids(np.asarray(x.values), table) if x.is_valid else None for x in lists]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], names=names)

    return base.mapInArrow(run, schema)

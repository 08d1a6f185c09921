"""Periodic runs of words, by Kolpakov and Kucherov's algorithm.

A text is factorised by its suffix automaton (each factor is the longest
stretch that began before, or a new word).  Runs that touch a border of
factors are found by Main's longest extensions around that border; all others
lie inside a factor and are copied from where it stood before.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import fresh, text_buffer

#: A run has at least so many words, and so many whole periods.
MIN_LENGTH, MIN_EXPONENT = 6, 4

Run = tuple[int, int, int]


class Automaton:
    """The suffix automaton of a sequence of numbers, with the first end of each state's strings.

    Most states have one way out, which is kept in arrays; the others are in
    a dictionary.  That is some 50 bytes a state, of at most two a word.
    """

    def __init__(self, s: Sequence[int]) -> None:
        self.symbol, self.target, self.end = array("q", [-1]), array("q", [0]), array("q", [-1])
        self.more: dict[int, dict[int, int]] = {}
        size, link, last = array("q", [0]), array("q", [-1]), 0
        symbol, target, end, more = self.symbol, self.target, self.end, self.more
        for i, c in enumerate(s):
            new, p, q = len(size), last, -1
            size.append(size[last] + 1), link.append(0), symbol.append(-1), target.append(0), end.append(i)
            while p >= 0:
                if symbol[p] < 0:
                    symbol[p], target[p] = c, new
                elif symbol[p] == c:
                    q = target[p]
                    break
                else:
                    ways = more.setdefault(p, {})
                    if c in ways:
                        q = ways[c]
                        break
                    ways[c] = new
                p = link[p]
            last = new
            if p < 0:
                continue
            if size[p] + 1 == size[q]:
                link[new] = q
                continue
            twin = len(size)
            size.append(size[p] + 1), link.append(link[q]), symbol.append(symbol[q]), target.append(target[q]), end.append(end[q])
            if q in more:
                more[twin] = dict(more[q])
            while p >= 0:
                if symbol[p] == c:
                    if target[p] != q:
                        break
                    target[p] = twin
                elif p in more and more[p].get(c) == q:
                    more[p][c] = twin
                else:
                    break
                p = link[p]
            link[q] = link[new] = twin

    def step(self, state: int, c: int) -> int:
        return self.target[state] if self.symbol[state] == c else self.more[state][c]


def factors(s: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start) of each factor; a word that is new has the earlier start -1."""
    auto, out, i = Automaton(s), [], 0
    while i < len(s):
        state, j, before = 0, i, -1
        while j < len(s):
            to = auto.step(state, s[j])
            start = auto.end[to] - (j - i)
            if start >= i:
                break
            state, before, j = to, start, j + 1
        out.append((i, max(j - i, 1), before))
        i = max(j, i + 1)
    return out


def matches(s: Sequence[int], upto: int) -> list[int]:
    """How long the start of ``s`` stands again at each of its places 1 .. ``upto - 1`` (at 0: its length)."""
    n = len(s)
    out, lo, hi = [n] + [0] * (upto - 1), 0, 0
    for i in range(1, upto):
        k = min(hi - i, out[i - lo]) if i < hi else 0
        if i + k >= hi:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            lo, hi = i, i + k
        out[i] = k
    return out


def _around(t: list[int], u: list[int], exponent: int, least: int) -> Iterator[Run]:
    """(start, end, period) of the stretches of ``t + u`` that touch the border and are long enough; starts are from ``t``'s beginning."""
    a, b = len(t), len(u)
    back, both = t[::-1], (t + u)[::-1]
    # the period's first copy after the border: it matches on to the right by ahead, to the left by behind
    ahead = matches(u, b)
    behind = matches([*back, -1, *both], a + 1 + b)[a + 1 :]
    for q in range(1, b + 1):
        right, left = ahead[q] if q < b else 0, behind[b - q]
        if q + left + right >= max(least, exponent * q):
            yield a - left, a + q + right, q
    # the same for its last copy before the border
    behind = matches(back, a)
    ahead = matches([*u, -1, *t, *u], b + 1 + a)[b + 1 :]
    for q in range(1, a + 1):
        left, right = behind[q] if q < a else 0, ahead[a - q]
        if q + left + right >= max(least, exponent * q):
            yield a - q - left, a + right, q


def runs(s: Sequence[int], exponent: int = MIN_EXPONENT, least: int = MIN_LENGTH) -> list[Run]:
    """(start, end, smallest period) of all maximal runs of the length, in order."""
    n = len(s)
    s = [*s, -2]  # a last factor of its own, so that every other run touches a border or lies inside a factor
    found: dict[tuple[int, int], int] = {}
    starts: dict[int, list[tuple[int, int]]] = {}

    def keep(lo: int, hi: int, q: int) -> None:
        known = found.get((lo, hi))
        if known is None or q < known:
            found[lo, hi] = q
            if known is None:
                starts.setdefault(lo, []).append((lo, hi))

    size_before = 0
    for at, size, before in factors(s):
        # no run that ends in this factor, or before its end, starts further to the left
        lo = max(0, at - 2 * size_before - size)
        if at + size - lo >= least:
            for x, y, q in _around(s[lo:at], s[at : at + size], exponent, least):
                x, y = x + lo, y + lo
                if (x == 0 or s[x - 1] != s[x - 1 + q]) and (y > n or s[y] != s[y - q]):
                    keep(x, y, q)
        if before >= 0 and starts and size > least:
            for x in range(before + 1, before + size - least):
                for _, y in starts.get(x, ()):
                    if y < before + size:
                        keep(x + at - before, y + at - before, found[x, y])
        size_before = size
    return sorted((x, y, q) for (x, y), q in found.items())


def text_runs(ids: np.ndarray, exponent: int = MIN_EXPONENT, least: int = MIN_LENGTH) -> list[Run]:
    """:func:`runs` of a text of numbered words, stretch by stretch.

    A run of so many periods holds each of its words as often, and each of
    its pairs of neighbours once less; the text is cut where it does not, as
    no run goes over such a place.
    """
    if len(ids) < least:
        return []
    often = np.bincount(ids) >= exponent
    pair = ids[:-1].astype(np.int64) * len(often) + ids[1:]
    _, place, counts = np.unique(pair, return_inverse=True, return_counts=True)
    joined = (counts >= exponent - 1)[place] & often[ids[:-1]] & often[ids[1:]]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]])))
    out: list[Run] = []
    for lo, hi in zip(edges[::2].tolist(), (edges[1::2] + 1).tolist()):
        if hi - lo >= least:
            out += [(lo + x, lo + y, q) for x, y, q in runs(ids[lo:hi].tolist(), exponent, least)]
    return out


def periodic_runs(docs: DataFrame, *, text: str = "text", exponent: int = MIN_EXPONENT, least: int = MIN_LENGTH, runs_name: str = "runs", collapsed: str = "collapsed", n_words: str = "n_words") -> DataFrame:
    """``docs`` with each text's number of words, runs (start, length, period) and what is left without their repeats.

    Words stand between ASCII white space, and are equal if their bytes are.
    A run is a stretch with a smallest period q, of at least ``least`` words
    and ``exponent`` periods (2 or more), that no neighbour extends; runs are
    in order of start, then period.  Every word in a run after its first q
    goes; the others are joined by one space.

    Null and empty text has no words, no runs and "" left.  Repeated rows and
    null ids have a row each; ties do not arise, as all runs are told.  Very
    long texts are one task's, with about 100 bytes a word of what repeats.
    An empty table gives an empty one.  Columns of the three new names are
    replaced; name others by the arguments.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    keep = [c for c in docs.columns if c.lower() not in {runs_name.lower(), collapsed.lower(), n_words.lower()}]
    own = fresh(docs, "text", runs_name.lower(), collapsed.lower(), n_words.lower())
    rows = docs.select(*keep, F.col(text).cast("string").alias(own))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffer(batch.column(batch.num_columns - 1))
            raw, counts, kinds, left = data.tobytes(), [], [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                words = raw[lo:hi].split()  # of bytes: at ASCII white space only
                numbers: dict[bytes, int] = {}
                ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                found = text_runs(ids, exponent, least)
                if found:
                    stays = np.ones(len(words), bool)
                    for x, y, q in found:
                        stays[x + q : y] = False
                    words = [words[k] for k in np.flatnonzero(stays).tolist()]
                counts.append(len(ids))
                kinds.append([{"start": x, "length": y - x, "period": q} for x, y, q in found])
                left.append(b" ".join(words).decode())
            columns = [pa.array(counts, pa.int64()), pa.array(kinds, _RUNS), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], n_words, runs_name, collapsed])

    schema = rows.select(*keep, F.lit(0).cast("bigint").alias(n_words), F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias(runs_name), F.lit("").cast("string").alias(collapsed)).schema
    return rows.mapInArrow(split, schema)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

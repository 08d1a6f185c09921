"""Words of UTF-8 text as arrays: positions, rows and 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Spans of more bytes are hashed one by one.
LONG = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Lower-cases A-Z and nothing else.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def byte_class(separators: str) -> np.ndarray:
    """True for the bytes of words; ``separators`` are the ASCII characters between words."""
    out = np.ones(256, bool)
    out[list(separators.encode("ascii"))] = False
    return out


#: Words are what stands between white space.
SPACED = byte_class(" \t\n\v\f\r")
#: Words are letters and digits, and all beyond ASCII (of lower-cased text).
LETTERS = byte_class("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends], the same wherever the same bytes stand.

    Eight bytes at a time go through :func:`mix`, which no structure of the
    text cancels; long spans go through XXH3.
    """
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    out = mix(size.astype(np.uint64) * _ODD)
    live, at, left = np.arange(len(size)), starts, size
    if len(size) and size.max() > LONG:
        raw = data.tobytes()
        big = np.flatnonzero(size > LONG)
        out[big] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[big].tolist(), ends[big].tolist())]
        live = np.flatnonzero(size <= LONG)
        at, left = starts[live], size[live]
    while True:
        more = left > 0
        if not more.all():
            live, at, left = live[more], at[more], left[more]
        if not len(live):
            return out
        part = eight[at]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[live] = mix((out[live] ^ part) * _ODD)
        at, left = at + 8, left - 8


def find_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words' positions, and for each row (and the end) its first word's number."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = word[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = np.zeros(n + 1, bool)
    closes[1:] = inside
    closes[1:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    opens[edges] = inside[edges]
    closes[edges] = inside[edges - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes), np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first) of the words of ``data``, which is folded already."""
    starts, ends, first = find_words(data, offsets, word)
    return span_hash(data, starts, ends), starts, ends, first

"""Language identification with a byte convolutional network, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import pieces

#: Labelled rows that the network learns from at most (the first by a hash of the id).
TRAIN_ROWS = 6000
#: Bytes of a window; a text is cut into windows end to end, the last one padded.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EPOCHS = 12
#: Windows of one training text that are learnt from at most.  With ``TRAIN_ROWS`` this bounds what the driver holds.
TRAIN_WINDOWS = 4

PAD = 0
UNKNOWN = "und"


def _alphabet() -> tuple[np.ndarray, int]:
    """Bytes as fewer symbols: case is folded, control bytes, digits and signs are one symbol each."""
    kind = np.zeros(256, np.int64)
    kind[:48] = kind[58:65] = kind[91:97] = kind[123:128] = 1
    kind[48:58] = 2
    kind[65:91] = kind[97:123] = 3 + np.arange(26)
    kind[128:192] = 29 + np.arange(64)
    kind[192:256] = 93 + np.arange(64) // 2
    return kind, 125


SYMBOL, N_SYMBOLS = _alphabet()


@dataclass(frozen=True)
class ByteCNN:
    """Filters of several widths over symbols, max pooling over the window, softmax over languages.

    ``filters[w]`` is (w, symbols, FILTERS): the first layer on one-hot symbols.
    """

    filters: tuple[np.ndarray, ...]
    bias: np.ndarray
    dense: np.ndarray
    out_bias: np.ndarray
    languages: tuple[str, ...]
    pairs: list = field(default_factory=list, compare=False)

    def _pair_tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """Each filter as sums over tables of one symbol or of two symbols that follow each other."""
        if not self.pairs:
            for f in self.filters:
                own, o = [], 0
                while o < len(f):
                    if o + 1 < len(f):
                        own.append((o, (f[o][:, None, :] + f[o + 1][None, :, :]).reshape(-1, f.shape[2]).astype(np.float32)))
                    else:
                        own.append((o, f[o].astype(np.float32)))
                    o += 2
                self.pairs.append(own)
        return self.pairs

    def pooled(self, windows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Max-pooled filter responses of (n, WINDOW) symbols, and where each maximum stands."""
        two = windows[:, :-1].astype(np.int32) * N_SYMBOLS + windows[:, 1:]
        best, at = [], []
        for f, tables in zip(self.filters, self._pair_tables()):
            n = windows.shape[1] - len(f) + 1
            total = None
            for o, t in tables:
                got = np.take(t, two[:, o : o + n] if len(t) > N_SYMBOLS else windows[:, o : o + n], axis=0)
                total = got if total is None else np.add(total, got, out=total)
            if where:
                at.append(total.argmax(1))
            best.append(total.max(1))
        return np.concatenate(best, 1) + self.bias, np.concatenate(at, 1) if where else None

    def logits(self, windows: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(windows)[0], 0) @ self.dense + self.out_bias


def cut_windows(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, row): the texts' symbols in fixed-length windows, padded, and each window's row."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    start = offsets[:-1][row] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    left = np.minimum(offsets[1:][row] - start, WINDOW)
    padded = np.concatenate([symbols, np.full(WINDOW, PAD, symbols.dtype)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start].copy()
    out[np.arange(WINDOW) >= left[:, None]] = PAD
    return out, row


def train(texts: list[bytes], languages: list[str], *, epochs: int = EPOCHS, seed: int = 7, most: int = TRAIN_WINDOWS) -> ByteCNN:
    """A network from labelled texts (softmax cross-entropy, Adagrad); a pure function of its arguments.

    Gradients reach a filter only through the position of its maximum, so
    that each step touches few entries of the first layer.
    """
    names = tuple(sorted(set(languages)))
    number = {v: k for k, v in enumerate(names)}
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for t, v in zip(texts, languages):
        s = SYMBOL[np.frombuffer(t, np.uint8)].astype(np.int32)
        w, _ = cut_windows(s, np.array([0, len(s)]))
        pick = np.arange(len(w)) if len(w) <= most else np.sort(rng.choice(len(w), most, replace=False))
        rows.append(w[pick]), labels.extend([number[v]] * len(pick))
    x = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.int32)
    y = np.array(labels, np.int64)
    weight = len(y) / np.maximum(np.bincount(y, minlength=len(names)), 1) / max(len(names), 1)
    filters = [rng.normal(0, 0.2, (w, N_SYMBOLS, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, PAD] = -0.5
    width = FILTERS * len(WIDTHS)
    bias, dense, out_bias = np.zeros(width), rng.normal(0, 0.3, (width, len(names))), np.zeros(len(names))
    seen = [np.full(v.shape, 1e-2) for v in (*filters, bias, dense, out_bias)]

    def move(value: np.ndarray, grad: np.ndarray, past: np.ndarray, rate: float = 0.05) -> None:
        past += grad * grad
        value -= rate * grad / np.sqrt(past)

    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for k in range(0, len(order), 128):
            own = order[k : k + 128]
            net = ByteCNN(tuple(filters), bias, dense, out_bias, names)
            pooled, at = net.pooled(x[own], where=True)
            hidden = np.maximum(pooled, 0)
            z = hidden @ dense + out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            g = p * weight[y[own]][:, None] / len(own)
            back = (g @ dense.T) * (pooled > 0)
            move(dense, hidden.T @ g, seen[-2])
            move(out_bias, g.sum(0), seen[-1])
            move(bias, back.sum(0), seen[-3])
            for n, f in enumerate(filters):
                part = slice(n * FILTERS, (n + 1) * FILTERS)
                for o in range(len(f)):
                    grad = np.zeros(f.shape[1:])
                    sym = np.take_along_axis(x[own], at[:, part] + o, axis=1)
                    np.add.at(grad, (sym, np.arange(FILTERS)[None, :]), back[:, part])
                    move(f[o], grad, seen[n][o])
    return ByteCNN(tuple(f.astype(np.float32) for f in filters), bias, dense, out_bias, names)


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS, windows: int = TRAIN_WINDOWS) -> ByteCNN:
    """Train on at most ``rows`` labelled rows, the first in the order of a hash of their id and text.

    Rows without text or label teach nothing.  Texts come to the driver as
    at most ``windows`` windows each, taken evenly from the whole text; both
    bounds together are the size of the sample.
    """
    c = F.col(text).cast("binary")
    span = F.octet_length(text)
    step = F.greatest(F.floor((span - WINDOW) / max(windows - 1, 1)), F.lit(0)).cast("int")
    cut = F.array_distinct(F.array(*[F.substring(c, step * k + 1, F.lit(WINDOW)) for k in range(windows)]))
    sample = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (span > 0)).select(F.col(doc_id).alias("i"), F.col(lang).alias("l"), cut.alias("w"))
    # half as many again by the hash alone come to the driver, whatever the number of tasks
    order = F.xxhash64("i", "w")
    share = min(1.0, 1.5 * rows / max(sample.count(), 1))
    if share < 1:
        sample = sample.where(order < F.lit(int((share * 2 - 1) * (1 << 63))))
    got = sample.orderBy(order, F.col("i"), F.col("l")).limit(rows).collect()
    return train([bytes(w) for r in got for w in r["w"]], [r["l"] for r in got for _ in r["w"]])


def predict(docs: DataFrame, net: ByteCNN, *, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with each whole text's language and score.

    The score is the language's mean probability over all windows of the
    text, from 0 to 1; ties go to the first language by name.  Null text, and
    text without a letter, is ``und`` with score 0, as is all text when the
    network has learnt no language.  Equal texts, repeated rows among them,
    have equal results; a very long text is read window by window to its end,
    and an empty table gives none.  Columns named as ``lang`` and ``score``
    say are replaced.
    """
    base = docs.drop(lang, score)
    fields = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, text, 1 << 19):
            symbols = SYMBOL[data].astype(np.int32)
            windows, row = cut_windows(symbols, offsets)
            total = np.zeros((rows.num_rows, max(len(net.languages), 1)))
            if net.languages:
                for k in range(0, len(windows), 128):
                    z = net.logits(windows[k : k + 128])
                    p = np.exp(z - z.max(1, keepdims=True))
                    np.add.at(total, row[k : k + 128], p / p.sum(1, keepdims=True))
            total /= np.maximum(-(-np.diff(offsets) // WINDOW), 1)[:, None]
            letters = np.concatenate([[0], np.cumsum(symbols >= 3)])
            maybe = letters[offsets[1:]] > letters[offsets[:-1]]
            best = total.argmax(1)
            texts = rows.column(rows.schema.get_field_index(text))
            names, scores = [], []
            ascii_letters = np.concatenate([[0], np.cumsum((symbols >= 3) & (symbols < 29))])
            sure = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
            for k in range(rows.num_rows):
                known = bool(net.languages) and bool(sure[k] or maybe[k] and any(map(str.isalpha, texts[k].as_py())))
                names.append(net.languages[best[k]] if known else UNKNOWN)
                scores.append(float(min(max(total[k, best[k]], 0.0), 1.0)) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*fields, lang, score])

    out = T.StructType([*base.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return base.mapInArrow(run, out)

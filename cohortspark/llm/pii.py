"""Personal data: exact patterns, and a character BiLSTM-CRF that adds spans to theirs.

The network learns from labelled spans: made-up personal data in many written
forms, put into pieces of the corpus's own text.  It adds what the patterns
can't see: numbers in national or spaced forms, spaced addresses, and secrets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the patterns find.
BASE = ("email", "ip", "card", "phone")
#: What the network finds; ``secret`` is a key or token.
KINDS = (*BASE, "secret")

Span = tuple[str, int, int]

_EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The patterns' matches by kind, in linear time whatever the text.

    They are the leftmost non-overlapping matches of each kind's pattern.
    Each search starts from what a match must hold (an at sign, a run of
    dotted numbers), so that long runs are not scanned from every start.
    """
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _EMAIL_LOCAL.match(text, start - 1):
            start -= 1
        m = _EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        pos = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", pos, pos + size))
            pos += size + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# The network: symbols, labels, training data.

_SIGNS = "@.-_%+(): /,\n=\"#"
#: Outside, and the beginning and inside of a span of each kind.
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, STRIDE = 64, 32
HIDDEN = 16


def _symbols() -> np.ndarray:
    table = np.full(128, 1, np.int64)
    for c in range(26):
        table[65 + c] = table[97 + c] = 4 + c
    table[48:58] = 3
    for k, c in enumerate(_SIGNS):
        table[ord(c)] = 30 + k
    return table


SYMBOLS = _symbols()
N_SYMBOLS = 30 + len(_SIGNS)


def to_symbols(text: str) -> np.ndarray:
    """A number for each code point: letters without case, digits as one, signs; 2 is all beyond ASCII, 0 padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, SYMBOLS[np.minimum(points, 127)], 2)


#: Pieces of the corpus that training text is made of, at most, and their characters.
CARRIERS, CARRIER_SIZE = 400, 120


def _invented(rng: np.random.Generator) -> str:
    parts = ("an", "the", "ra", "lo", "mi", "est", "ing", "o", "er", "su", "ti", "bel")
    return "".join(parts[k] for k in rng.integers(0, len(parts), int(rng.integers(1, 4))))


def training_spans(n: int, seed: int, carriers: tuple[str, ...] = ()) -> list[tuple[str, list[Span]]]:
    """Labelled text: words of the carriers (or invented ones) around personal data, and around numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: _invented(rng)
    real = [own for c in carriers if (own := [w for w in c.split() if not _TRIGGER.search(w)])]

    def around() -> str:
        if not real or rng.random() < 0.3:
            return " ".join(word() for _ in range(int(rng.integers(1, 4))))
        own = pick(real)
        k = int(rng.integers(len(own)))
        text = " ".join(own[k : k + int(rng.integers(1, 4))])
        return text.upper() if rng.random() < 0.1 else text

    def email() -> str:
        name = pick([f"{word()}.{word()}", f"{word()}{num(2)}", word(), f"{word()}_{word()}.{num(2)}"])
        host = word() + pick([".com", ".org", f".{word()}.net", f"{num(1)}.test"])
        return name + pick(["@", "@", "@", " @ ", " @"]) + host

    def card() -> str:
        body = num(15)
        check = next(c for c in "0123456789" if luhn(body + c))
        d = body + check
        return pick(["", "-", " ", ".", "  "]).join(d[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        return pick([
            f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(4)}", f"({num(3)}) {num(3)}-{num(4)}",
            f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)}.{num(3)}.{num(6)}", f"{num(3)}.{num(3)}.{num(4)}"
        ])

    def secret() -> str:
        signs = pick(["0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
        return pick(["", "", "", "sk-", "key_"]) + "".join(pick(signs) for _ in range(int(rng.integers(24, 44))))

    make = {"email": email, "ip": lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)), "card": card, "phone": phone, "secret": secret}
    other = [
        lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(1)}.{num(1)}", lambda: f"{num(2)}:{num(2)}",
        lambda: num(int(rng.integers(1, 8))), lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(1)}.{num(1)}.{num(2)}",
        lambda: f"{word()}{num(3)}{word()}{num(2)}", lambda: f"@{word()}", lambda: f"{num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
        lambda: "".join(word() for _ in range(7))
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW:
            text += around() + pick([" ", " ", ", ", ": ", ". ", "\n"])
            kind = pick([*KINDS, None, None])
            piece = make[kind]() if kind else pick(other)()
            quote = pick(['"', "", ""]) if kind == "secret" else ""
            text += pick(["key = ", "token: ", ""]) + quote if kind == "secret" else ""
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + quote + pick([" ", " ", ".", ", ", "\n", "### "])
        out.append((text, spans))
    return out


def label_numbers(size: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for kind, s, e in spans:
        out[s] = LABELS.index(f"B-{kind}")
        out[s + 1 : e] = LABELS.index(f"I-{kind}")
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass(frozen=True)
class Tagger:
    """A bidirectional LSTM over symbols with CRF transitions.

    ``inputs``, ``hidden`` and ``bias`` are of the two directions (2, symbols
    or HIDDEN, 4 * HIDDEN); the gates stand in the order in, forget, out, new.
    """

    inputs: np.ndarray
    hidden: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def states(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """(n, time, 2 * HIDDEN) states of symbols (n, time), and what training needs."""
        n, time = x.shape
        out, past = np.zeros((n, time, 2 * HIDDEN)), []
        for d in range(2):
            h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            table = self.inputs[d] + self.bias[d]
            for t in range(time) if d == 0 else range(time - 1, -1, -1):
                z = table[x[:, t]] + h @ self.hidden[d]
                gates = _sigmoid(z[:, : 3 * HIDDEN])
                i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
                c_new = f * c + i * g
                tc = np.tanh(c_new)
                if keep:
                    past.append((d, t, h, c, i, f, o, g, tc))
                h, c = o * tc, c_new
                out[:, t, d * HIDDEN : (d + 1) * HIDDEN] = h
        return out, past

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best label sequence of each window (Viterbi)."""
        scores = self.states(x)[0] @ self.dense + self.dense_bias
        n, time, _ = scores.shape
        best, back = scores[:, 0] + self.first, np.zeros((n, time, len(LABELS)), np.int64)
        for t in range(1, time):
            via = best[:, :, None] + self.moves[None]
            back[:, t] = via.argmax(1)
            best = via.max(1) + scores[:, t]
        out = np.zeros((n, time), np.int64)
        out[:, -1] = best.argmax(1)
        for t in range(time - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def _crf_gradients(scores: np.ndarray, y: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the negative log-likelihood: expected less observed counts of labels, moves and first labels."""
    n, time, k = scores.shape
    a, b = np.zeros_like(scores), np.zeros_like(scores)
    a[:, 0] = scores[:, 0] + first
    for t in range(1, time):
        a[:, t] = _log_sum(a[:, t - 1, :, None] + moves[None], 1) + scores[:, t]
    for t in range(time - 2, -1, -1):
        b[:, t] = _log_sum(moves[None] + (scores[:, t + 1] + b[:, t + 1])[:, None, :], 2)
    z = _log_sum(a[:, -1], 1)
    g = np.exp(a + b - z[:, None, None])
    pair = np.exp(a[:, :-1, :, None] + moves + (scores + b)[:, 1:, None, :] - z[:, None, None, None]).sum((0, 1))
    g_first = g[:, 0].sum(0)
    g[np.arange(n)[:, None], np.arange(time)[None], y] -= 1
    np.subtract.at(pair, (y[:, :-1], y[:, 1:]), 1)
    np.subtract.at(g_first, y[:, 0], 1)
    return g, pair, g_first


@lru_cache(maxsize=2)
def train(n: int = 3000, steps: int = 480, seed: int = 5, carriers: tuple[str, ...] = ()) -> Tagger:
    """A tagger from labelled spans, by Adam on the CRF's likelihood; a pure function of its arguments."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for k, (text, spans) in enumerate(training_spans(n, seed, carriers)):
        shift = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        x[k] = to_symbols(text)[shift : shift + WINDOW]
        y[k] = label_numbers(len(text), spans)[shift : shift + WINDOW]
    p = [
        rng.normal(0, 0.3, (2, N_SYMBOLS, 4 * HIDDEN)), rng.normal(0, 0.25, (2, HIDDEN, 4 * HIDDEN)), np.zeros((2, 4 * HIDDEN)),
        rng.normal(0, 0.3, (2 * HIDDEN, len(LABELS))), np.zeros(len(LABELS)), np.zeros((len(LABELS), len(LABELS))), np.zeros(len(LABELS))
    ]
    p[2][:, HIDDEN : 2 * HIDDEN] = 1
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, steps + 1):
        own = rng.integers(0, n, 64)
        hot = np.eye(N_SYMBOLS)[x[own]]
        net = Tagger(*p)
        h, past = net.states(x[own], keep=True)
        g, g_moves, g_first = _crf_gradients(h @ p[3] + p[4], y[own], p[5], p[6])
        grads = [np.zeros_like(q) for q in p]
        grads[3], grads[4], grads[5], grads[6] = np.einsum("nth,ntk->hk", h, g), g.sum((0, 1)), g_moves, g_first
        g_h = g @ p[3].T
        dh, dc, last = None, None, None
        for d, t, h0, c0, i, f, o, new, tc in reversed(past):
            if d != last:
                dh, dc, last = np.zeros_like(h0), np.zeros_like(c0), d
            dh = dh + g_h[:, t, d * HIDDEN : (d + 1) * HIDDEN]
            dc = dc + dh * o * (1 - tc * tc)
            z = np.concatenate([dc * new * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)], 1)
            grads[0][d] += hot[:, t].T @ z
            grads[1][d] += h0.T @ z
            grads[2][d] += z.sum(0)
            dh, dc = z @ p[1][d].T, dc * f
        norm = np.sqrt(sum((q * q).sum() for q in grads))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for q, gr, mm, vv in zip(p, grads, m, v):
            gr *= min(1.0, 50.0 / norm)
            mm += 0.1 * (gr - mm)
            vv += 0.01 * (gr * gr - vv)
            q -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return Tagger(*p)


def window_starts(text: str) -> list[int]:
    """Starts of the overlapping windows that can hold a part of a span.

    No kind is without a digit or an at sign, and no span is longer than a
    window, so these are the windows with one and their neighbours.
    """
    last, starts = len(text) // STRIDE, set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // STRIDE
        starts.update(range(max(0, k - 2), min(last, k + 1) + 1))
    return [k * STRIDE for k in sorted(starts)]


def reconcile(labels: dict[int, np.ndarray], size: int) -> list[Span]:
    """Spans of a text from its windows' labels.

    Each character takes its label from the window in whose middle it lies
    deepest; a span is a run of one kind, whether or not it begins with B.
    """
    depth_in = np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW)).astype(np.int16)
    deepest, label = np.full(size, -1, np.int16), np.zeros(size, np.int8)
    for start, own in labels.items():
        # the ends of the text are as deep as its windows are long
        depth = depth_in + (WINDOW if start == 0 else 0) * (np.arange(WINDOW) < STRIDE)
        n = min(WINDOW, size - start)
        better = depth[:n] > deepest[start : start + n]
        deepest[start : start + n][better] = depth[:n][better]
        label[start : start + n][better] = own[:n][better]
    spans: list[Span] = []
    for pos in np.flatnonzero(label).tolist():
        kind, begins = KINDS[(int(label[pos]) - 1) // 2], label[pos] % 2 == 1
        if spans and spans[-1][2] == pos and spans[-1][0] == kind and not begins:
            spans[-1] = (kind, spans[-1][1], pos + 1)
        else:
            spans.append((kind, pos, pos + 1))
    return spans


def plausible(text: str, span: Span) -> bool:
    """Whether an added span could be of its kind: what a kind can't be without is there."""
    kind, s, e = span
    piece = text[s:e]
    digits = sum("0" <= c <= "9" for c in piece)
    if any(c.isalnum() for c in text[max(0, s - 1) : s] + text[e : e + 1]):
        return False
    if kind == "phone":
        return 9 <= digits <= 15 and not any(c.isalpha() for c in piece) and len(re.split(r"[^0-9]+", piece.strip("()+ "))) >= 3 and not re.match(r"[0-9]{4}-[0-9]{2}-", piece)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+ ?@ ?[^\s@]+\.[^\s@.]+", piece))
    if kind == "card":
        return 13 <= digits <= 19 and luhn(_digits(piece)) and not any(c.isalpha() for c in piece)
    if kind == "secret":
        return e - s >= 20 and 4 <= digits < e - s and bool(re.fullmatch(r"[A-Za-z0-9_+/=-]+", piece))
    parts = piece.split(".")
    return len(parts) == 4 and all(x.isdecimal() and len(x) <= 3 and int(x) <= 255 for x in parts)


def find(texts: list[str | None], net: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind and start.

    The base spans stay as they are; a span of the network is added if it is
    plausible and overlaps none of them.
    """
    base = [base_spans(t) if t else [] for t in texts]
    jobs = [(k, s) for k, t in enumerate(texts) if t for s in window_starts(t)]
    found: dict[int, dict[int, np.ndarray]] = {}
    for lo in range(0, len(jobs), 512):
        part = jobs[lo : lo + 512]
        x = np.zeros((len(part), WINDOW), np.int64)
        for n, (k, s) in enumerate(part):
            own = to_symbols(texts[k][s : s + WINDOW])
            x[n, : len(own)] = own
        for (k, s), y in zip(part, net.decode(x)):
            found.setdefault(k, {})[s] = y
    out = []
    for k, t in enumerate(texts):
        spans = list(base[k])
        if k in found:
            spans += [z for z in reconcile(found[k], len(t)) if plausible(t, z) and all(z[2] <= s or e <= z[1] for _, s, e in base[k])]
        order = lambda z: (KINDS.index(z[0]), z[1])
        out.append((sorted(base[k], key=order), sorted(spans, key=order)))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def carriers(docs: DataFrame, *, text: str = "text") -> tuple[str, ...]:
    """At most ``CARRIERS`` pieces of ``CARRIER_SIZE`` characters, from anywhere in the texts, the first by a hash."""
    h = F.xxhash64(text)
    start = F.pmod(h, F.greatest(F.char_length(text) - CARRIER_SIZE, F.lit(1)).cast("bigint")) + 1
    rows = docs.where(F.char_length(text) > 0).select(h.alias("h"), F.substring(F.col(text), start.cast("int"), F.lit(CARRIER_SIZE)).alias("c"))
    return tuple(r["c"] for r in rows.orderBy("h", "c").limit(CARRIERS).collect())


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", net: Tagger | None = None) -> DataFrame:
    """A row a document: counts of the base spans by kind, their digest, all spans and their number.

    Positions are code points, ends are exclusive.  Null and empty text has
    no spans.  Repeated rows have a row each, and an empty table gives none.
    A very long text is decoded window by window to its end; where windows
    overlap a character's label is that of the window in which it lies deepest,
    of equally deep ones the earlier.  The network's spans that are longer than
    a window are put together of its labels in neighbouring windows, if these
    have a digit or an at sign near; base spans have any length.  Columns
    besides the id and the text are not read.  Without a network one is trained
    on spans in pieces of the documents.
    """
    net = net or train(carriers=carriers(docs, text=text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = find(part.column(1).to_pylist(), net)
                counts = [pa.array([sum(z[0] == kind for z in b) for b, _ in got], pa.int64()) for kind in BASE]
                sha = [hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array(sha, pa.string()), pa.array([_joined(a) for _, a in got], pa.string()), pa.array([len(a) for _, a in got], pa.int64())],
                    names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"]
                )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint")

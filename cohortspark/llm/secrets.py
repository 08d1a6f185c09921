"""Secrets: exact patterns, and an assignment-aware lexer that adds literals to their matches.

The lexer reads lines of source and configuration as name-literal pairs
(``name = "literal"``, ``"name": literal``, ``NAME=literal``, ``--name
literal``, ``<name>literal</name>``), follows constants through names,
concatenations and templates, and scores each literal by the names that it
reaches.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import fresh

#: What the patterns find, in the order of their results; ``literal`` is what the lexer adds.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "literal")

Span = tuple[str, int, int]

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
# a match of fewer characters fails, and so does every other one that starts in it
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")


def base_spans(text: str) -> list[Span]:
    """The patterns' leftmost non-overlapping matches, by start, then kind."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(z: Span) -> tuple[int, int]:
    return z[1], KINDS.index(z[0])


# Names. These lists are fixed values.

#: How much a name of these words says that its value is secret.
NAME_SCORES = {
    ("password",): 1.0, ("passwd",): 1.0, ("passphrase",): 1.0, ("passcode",): 1.0, ("pwd",): 1.0, ("pass",): 0.8, ("secret",): 1.0,
    ("token",): 1.0, ("apikey",): 1.0, ("api", "key"): 1.0, ("access", "key"): 1.0, ("secret", "key"): 1.0, ("private", "key"): 1.0,
    ("signing", "key"): 1.0, ("encryption", "key"): 1.0, ("auth", "key"): 1.0, ("account", "key"): 1.0, ("master", "key"): 1.0,
    ("shared", "key"): 0.9, ("credential",): 0.9, ("credentials",): 0.9, ("authorization",): 0.9, ("bearer",): 0.9, ("auth",): 0.6,
    ("connection", "string"): 0.6, ("dsn",): 0.6, ("salt",): 0.6
}
#: A name that ends in one of these speaks about a secret and holds none.
ABOUT = frozenset("length len size count type name id url uri path file dir expiry expires ttl field label hint policy regex pattern min max limit format header prompt message error placeholder version enabled required".split())
#: Names with one of these hold what everybody may see.
OPEN = frozenset(("public", "pub", "example", "test", "dummy", "fake", "sample"))
#: Values that stand for a secret.
STAND_INS = frozenset("none null nil undefined true false yes no changeme change_me password passwd secret token example sample placeholder redacted todo tbd default string required optional empty hidden your_password your_token yourpassword".split())

_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """0 to 1: how much the name says that its value is secret; its words are those of camelCase, snake_case, kebab-case and dots."""
    words = [w.lower() for w in _PART.findall(name)]
    if not words or words[-1] in ABOUT or OPEN & set(words):
        return 0.0
    best = 0.0
    for k in range(len(words)):
        for size in (1, 2):
            best = max(best, NAME_SCORES.get(tuple(words[k : k + size]), 0.0))
    return best


def literal_score(value: str) -> float:
    """0 to 1: how much a literal looks like a secret: its bits (of its own characters' entropy), halved for mere words."""
    if len(value) < 6 or value.lower() in STAND_INS or re.fullmatch(r"[<\[{$%].*[>\]}%]|[*xX.#_-]+|\$\w+", value):
        return 0.0
    if re.match(r"[a-z]{2,10}://[^@]*$|[./~]", value) or re.search(r"\s.*\s", value):
        return 0.0
    counts = Counter(value)
    bits = -sum(n * math.log2(n / len(value)) for n in counts.values())
    mixed = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, bits / 30) * (1.0 if mixed > 1 else 0.5)


#: Literals whose name's score times their own reach this are told.
THRESHOLD = 0.5

# Lexing. Only lines with an assignment, a flag or an element can hold a pair.

_SIGN = re.compile(r"[=:]|--[A-Za-z]|</")
_TOKEN = re.compile(
    r"""(?P<text>(?:(?<![\w\\])|(?<=(?<!\w)[bfruBFRU]))(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`))"""
    r"|(?P<element><[A-Za-z][\w.:-]*+[^<>\n]*+>[^<>\n]++</[A-Za-z][\w.:-]*+\s*>)"
    r"|(?P<flag>--[A-Za-z][\w-]*)"
    r"|(?P<compare>[=!<>]==?|<=|>=|::)"
    r"|(?P<assign>:=|=>|\+=|[:=])"
    r"|(?P<name>[A-Za-z_$@][\w$.-]*)"
    r"|(?P<number>[0-9][\w.+/-]*)"
    r"|(?P<join>\+|\.\.|\|\||\?\?)"
    r"|(?P<open>[(\[{])"
    r"|(?P<close>[)\]}])"
    r"|(?P<end>[\n;,])"
    r"|(?P<other>\S)",
    re.DOTALL,
)
_ELEMENT = re.compile(r"<([\w.:-]+)[^<>\n]*>([^<>\n]+)</([\w.:-]+)")
#: An unquoted value goes on to white space, a quote or a bracket; a separator at its end is none of it.
_BARE = re.compile(r"[^\S\n]*([^\s\"'`(){}\[\]<>;,]+)")
_WHOLE_LINE = re.compile(r"[^\S\n]*(?:#[^\n]*)?(?:\n|$)")
_TEMPLATE = re.compile(r"\$?\{\s*([A-Za-z_][\w.]*)\s*\}|\$([A-Za-z_]\w*)|%\(([A-Za-z_]\w*)\)s")
_IDENTIFIER = re.compile(r"[A-Za-z_$@][\w$.]*")


@dataclass
class Pair:
    """A name and what it is given: literals, and names whose values it takes; ``bare`` is a name that may be a literal itself."""

    name: str
    literals: list[tuple[int, int]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    bare: tuple[int, int] | None = None


def _regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of lines in which a pair can stand, with all lines of a literal that goes over several."""
    done = 0
    while m := _SIGN.search(text, done):
        lo, hi = max(text.rfind("\n", 0, m.start()) + 1, done), m.end()
        for quote in ("\n", '"""', "'''", "`"):
            if quote == "\n" or text.count(quote, lo, hi) % 2:
                close = text.find(quote, hi)
                if close >= 0 and quote != "\n":
                    close = text.find("\n", close)
                    hi = close if close >= 0 else len(text)
                elif quote == "\n":
                    hi = close if close >= 0 else len(text)
        yield lo, hi
        done = hi


def _content(text: str, lo: int, hi: int) -> tuple[int, int]:
    k = 3 if text[lo : lo + 3] in ('"""', "'''") and hi - lo >= 6 else 1
    return lo + k, hi - k


class _Reader:
    """Reads the pairs of one stretch of lines."""

    def __init__(self, text: str, lo: int, hi: int) -> None:
        self.text, self.hi = text, hi
        self.tokens = [(m.lastgroup, *m.span()) for m in _TOKEN.finditer(text, lo, hi)]
        self.tokens += [("end", hi, hi)] * 4

    def pairs(self) -> Iterator[Pair]:
        text, tokens, k = self.text, self.tokens, 0
        while k < len(tokens) - 4:
            kind, lo, hi = tokens[k]
            if kind == "element":
                m = _ELEMENT.match(text, lo)
                if m and m[1] == m[3]:
                    yield Pair(m[1], [m.span(2)])
            elif kind in ("name", "text", "flag"):
                at = k + 1
                if tokens[at][0] == "close" and text[tokens[at][1]] == "]":  # table["name"] = ...
                    at += 1
                if tokens[at][0] == "assign" or (kind == "flag" and text[hi : hi + 1] == " "):
                    name = text[lo:hi] if kind != "text" else text[slice(*_content(text, lo, hi))]
                    pair = Pair(name)
                    k = self.value(pair, self.annotated(at + 1) if tokens[at][0] == "assign" else at, kind == "flag")
                    yield pair
                    continue
            k += 1

    def annotated(self, k: int) -> int:
        """Past a type that stands between a colon and the equals sign."""
        text, tokens = self.text, self.tokens
        if text[tokens[k - 1][1] : tokens[k - 1][2]] == ":":
            for j in range(k, min(k + 6, len(tokens) - 1)):
                kind, lo, hi = tokens[j]
                if kind == "assign" and text[lo:hi] == "=" and j > k:
                    return j + 1
                if kind not in ("name", "open", "close", "other") or text[lo:hi] in "{}":
                    break
        return k

    def value(self, pair: Pair, k: int, flag: bool) -> int:
        """Reads what is assigned, from the token ``k`` on; returns the first token that is none of it."""
        text, tokens = self.text, self.tokens
        while tokens[k][0] == "open" and text[tokens[k][1]] == "(":
            k += 1
        if tokens[k][0] not in ("text", "element"):
            m = _BARE.match(text, tokens[k - 1][2], self.hi)
            if m and (_IDENTIFIER.fullmatch(m[1]) is None or flag) and tokens[k][0] != "join":
                if not re.match(r"[\w.-]+=", m[1]) or m[1].endswith("="):
                    pair.literals.append((m.start(1), m.end(1)))
                    while tokens[k][1] < m.end(1) and k < len(tokens) - 4:
                        k += 1
                    return k
        first = k
        while True:
            kind, lo, hi = tokens[k]
            if kind == "name" and tokens[k + 1][:2] == ("text", hi):  # a literal's prefix, as in f"..."
                k += 1
                kind, lo, hi = tokens[k]
            if kind == "text":
                own = _content(text, lo, hi)
                pair.literals.append(own)
                pair.names += [a or b or c for a, b, c in _TEMPLATE.findall(text[slice(*own)])]
            elif kind == "name" and tokens[k + 1][0] not in ("open", "assign"):
                if k == first and _WHOLE_LINE.match(text, hi):
                    pair.bare = (lo, hi)
                pair.names.append(text[lo:hi])
            elif kind == "number":
                pair.literals.append((lo, hi))
            else:
                return k
            k += 1
            if tokens[k][0] == "join" or text[tokens[k][1] : tokens[k][2]] == "or":
                k += 1
            elif not (kind == "text" and tokens[k][0] == "text"):
                return k


def pairs(text: str) -> list[Pair]:
    """The name-value pairs of a text, in order."""
    return [p for lo, hi in _regions(text) for p in _Reader(text, lo, hi).pairs() if p.literals or p.names]


def secret_literals(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, float, str]]:
    """(start, end, score, name) of the literals that reach a sensitive name, in order; of several names the best, then the first.

    A name takes the value that it was given last before, else first after.
    One that is given none in the text is a literal where it is all of a
    line's value.
    """
    found = pairs(text)
    given: dict[str, list[int]] = {}
    for k, p in enumerate(found):
        given.setdefault(p.name, []).append(k)
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for k, p in enumerate(found):
        score = name_score(p.name)
        if score < threshold:
            continue
        seen, left, literals = {k}, [k], []
        while left:
            at = left.pop()
            own = found[at]
            literals += own.literals
            for name in own.names:
                places = given.get(name.lstrip("$@"))
                if places:
                    to = places[max(bisect_left(places, at) - 1, 0)]
                    if to not in seen:
                        seen.add(to)
                        left.append(to)
                elif own.bare:
                    literals.append(own.bare)
        literals = sorted(set(literals))
        whole = literal_score("".join(text[slice(*z)] for z in literals)) if len(literals) > 1 else 0.0  # parts make one secret
        for span in literals:
            reached = score * max(whole, literal_score(text[slice(*span)]))
            if span[0] < span[1] and reached >= threshold and reached > best.get(span, (0.0, ""))[0]:
                best[span] = (reached, p.name)
    return [(s, e, score, name) for (s, e), (score, name) in sorted(best.items())]


def find(text: str | None) -> tuple[list[Span], list[tuple[str, int, int, float | None, str | None]]]:
    """(base spans, all spans with the added ones' scores and names), each by start, then kind; an added span overlaps no base span."""
    if not text:
        return [], []
    base = base_spans(text)
    out: list[tuple[str, int, int, float | None, str | None]] = [(*z, None, None) for z in base]
    starts, k, reach = [s for _, s, _ in base], 0, -1
    for s, e, score, name in secret_literals(text):
        while k < len(base) and starts[k] < e:
            reach, k = max(reach, base[k][2]), k + 1
        if reach <= s:
            out.append(("literal", s, e, score, name))
    return base, sorted(out, key=_order)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SCORED = pa.struct([*_SPAN, ("score", pa.float64()), ("name", pa.string())])


def find_secrets(docs: DataFrame, *, text: str = "text", base: str = "base_spans", spans: str = "secret_spans") -> DataFrame:
    """``docs`` with the patterns' spans (kind, start, end), and all spans with the added literals' scores and names.

    Positions are code points, ends are exclusive; spans are in order of
    start, then kind.  Added are literals of any quoting that reach a
    sensitive name in the same text and overlap no base span.

    Null and empty text has no spans.  Repeated rows and null ids have a row
    each.  Of two names with equal scores the first is told.  Very long texts
    are read whole by one task, in time linear in them.  An empty table gives
    an empty one.  Columns of the two new names are replaced; name others by
    the arguments.
    """
    keep = [c for c in docs.columns if c.lower() not in {base.lower(), spans.lower()}]
    own = fresh(docs, "text", base.lower(), spans.lower())
    rows = docs.select(*keep, F.col(text).cast("string").alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [find(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            told = pa.array([[dict(zip(("kind", "start", "end"), z)) for z in b] for b, _ in got], pa.list_(_SPAN))
            every = pa.array([[dict(zip(("kind", "start", "end", "score", "name"), z)) for z in a] for _, a in got], pa.list_(_SCORED))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], told, every], names=[*batch.schema.names[:-1], base, spans])

    span = "struct<kind:string,start:bigint,end:bigint"
    schema = rows.select(*keep, F.lit(None).cast(f"array<{span}>>").alias(base), F.lit(None).cast(f"array<{span},score:double,name:string>>").alias(spans)).schema
    return rows.mapInArrow(run, schema)

"""A small corpus with the awkward cases: nulls, empty and long texts, copies, near copies, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, kept string, slot string, n_lines int"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["an", "the", "ra", "lo", "mi", "est", "ing", "bel"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = [words(rng, n) for n in (3, 5, 30, 60, 120, 200, 400, 400)]
    near = base[5].split()
    near[7] = "changed"
    texts = [*base, base[4], base[4], " ".join(near), base[6] + " tail of its own", None, "", " ", "\n\n", "Orre " * 700, words(rng, 9000), base[3] + "\n" + base[7], base[2].upper(), "é" * 450 + "x" + "é" * 450, "12 34, 5.", "\x00ab\x00 " + base[0]]
    rows = [(k, t, ["en", "fr"][k % 2], f"s{k % 3}" if k % 7 else None, len(t) if t else None, 1, "k", "s", 5) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base[5], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


def frame(spark, rows: list[tuple] | None = None, parts: int = 3):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(parts)

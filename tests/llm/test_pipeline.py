"""The pipeline's stages take effect, and the rest of the repository does without them."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pandas as pd
import pytest

from cohortspark.llm import langid
from cohortspark.llm._base import materialize

from .cases import words
from .test_operators import hits_by_force, library, lines_by_force, low
from .test_queries import made, write


def by_language(spark, rows):
    """Rows with a letter whose score, if they are long enough to be judged, is not too low."""
    import corpus_pipeline as cp

    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, doc_id bigint, text string, lang string, source string, n_chars bigint")
    score = {r["n"]: r["score"] for r in langid.predict(df, langid.fit(df)).collect()}
    return [r for n, r in enumerate(rows) if any(c.isalpha() for c in r[1] or "") and (len(r[1].encode()) < cp.JUDGED or score[n] >= cp.LEAST_SCORE)]


def by_lines(rows):
    out = []
    for (i, source, text, n, dropped), m in lines_by_force(rows, 0.1).items():
        assert dropped == 0 or n > dropped or not (text or "").strip()
        out += [(i, text, source)] * (m if dropped == 0 or (text or "").strip() else 0)
    return Counter(out)


def by_classes(rows):
    """Of (doc_id, text) rows one of each class: the least id, then the least MD5; those without words or id stay."""
    sets = [(lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(re.findall(r"[^\x20\x09-\x0D]+", low(t))) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    first = {}
    for k, (i, t) in enumerate(rows):
        if sets[k] and i is not None:
            first[root(k)] = min(first.get(root(k), (i, hashlib.md5(t.encode()).digest(), t)), (i, hashlib.md5(t.encode()).digest(), t))
    return Counter((i, t) for i, _, t in first.values()) + Counter(r for r, x in zip(rows, sets) if not x or r[0] is None)


def test_every_stage_by_force(spark, tmp_path):
    """Null and repeated ids, repeated rows, null and empty texts through all stages; each is judged on its own input."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as cp

    rows = made()
    rows["documents"] += [(400 + k, f"Site menu\n{words(random.Random(k), 40)}", "en", "s9", None) for k in range(4)] + [(7, words(random.Random(90), 30), "en", None, None)]
    folder = write(tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    now = rows["documents"]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
            out = materialize(out, "stage")
        got = [tuple(r) for r in out.collect()]
        pairs = Counter((r[0], r[1]) for r in got)
        if name == "language ID":
            assert Counter(got) == Counter(by_language(spark, now))
        elif name == "line dedup":
            assert Counter((r[0], r[1], r[3]) for r in got) == by_lines(now)
            assert not any("Site menu" in r[1] for r in got)
        elif name == "n-gram Jaccard join":
            assert pairs == by_classes([(r[0], r[1]) for r in now]) and sum(pairs.values()) < len(now)
        elif name == "benchmark decontamination":
            hit = {r[1] for r in now if any(x[5] for x in hits_by_force([r], rows["benchmark"]))}
            assert pairs == Counter((r[0], r[1]) for r in now if r[1] not in hit) and hit
        else:
            sp, own = library(), []
            for r in now:
                ids = sp.encode(r[1]) if r[1] else []
                own.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), True))
            assert Counter(got) == Counter(own)
        docs, now = out, got
    assert Counter(map(tuple, cp.run(spark, folder).collect())) == Counter(now)


def test_rows_are_judged_by_themselves(spark, tmp_path):
    """Null and repeated ids: a row goes for what is in its own text."""
    import corpus_pipeline as cp

    rng = random.Random(12)
    a, b, c, d, passage = (words(rng, n) for n in (80, 80, 60, 30, 12))
    near = a.split()
    near[3] = "changed"
    near = " ".join(near)
    schema = "doc_id bigint, text string, lang string, source string"
    made = lambda pairs: spark.createDataFrame([(i, t, "en", "s") for i, t in pairs], schema).repartition(3)
    rows = [(5, a), (5, b), (3, near), (None, a), (None, a), (None, c), (7, d), (7, d), (8, None), (8, " "), (9, c), (9, c + " \n")]
    got = Counter((r[0], r[1]) for r in cp.ngram_join(spark, made(rows), str(tmp_path)).collect())
    # of the two rows of 9, which are of one class, either text
    assert got[9, c] + got[9, c + " \n"] == 1
    assert Counter({k: n for k, n in got.items() if k[0] != 9}) == Counter([(5, b), (3, near), (None, a), (None, a), (None, c), (7, d), (8, None), (8, " ")])

    pd.DataFrame([(1, passage)], columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    dirty = f"{d} {passage}"
    rows = [(None, a), (None, dirty), (None, None), (5, b), (5, dirty), (6, c), (6, c)]
    got = Counter((r[0], r[1]) for r in cp.decontamination(spark, made(rows), str(tmp_path)).collect())
    assert got == Counter(x for x in rows if x[1] != dirty)

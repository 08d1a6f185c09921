"""Every registered query over small tables against a brute-force version of its contract, and over empty tables."""

from __future__ import annotations

import base64
import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortspark.llm import langid, queries, suffix_dedup

from .cases import corpus, words
from .test_operators import UTF8, base_by_force, classes_by_force, hits_by_force, library, lines_by_force, phrases_by_force, runs_by_force, secrets_by_force

TABLES = {
    "documents": pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]),
    "benchmark": pa.schema([("item_id", pa.int64()), ("text", pa.string())]),
    "pages": pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]),
    "embeddings": pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())]),
}


def made() -> dict[str, list[tuple]]:
    rng, vectors = random.Random(21), np.random.default_rng(21)
    docs = [r[:5] for r in corpus()]
    passage = words(rng, 100)
    docs += [(300 + k, f"Menu\nbar {words(rng, 30)} {passage} mail{k}@x.org, +49 30 1234567{k}\nfooter", "fr" if k % 2 else "de", "host", None) for k in range(12)]
    docs += [(400 + k, f"{words(rng, 40)} token = '24be64439e3e49cf46b2d7c9{k:02}' AKIAIOSFODNN7EXAMPL{k}, over and over again", "de", "host", None) for k in range(40)]
    benchmark = [(1, " ".join(passage.split()[10:40])), (2, "one two"), (3, None), (None, words(rng, 20))]
    pages = [(k, f"http://h/{k}", f"<p>{k % 4}</p>" * (k % 3)) for k in range(20)] + [(5, "http://again/", "<p>1</p>"), (21, None, None), (None, "u", "x")]
    embeddings = [(k, v.tolist(), 0) for k, v in enumerate(vectors.normal(size=(300, 16)).astype(np.float32))] + [(400, None, 1), (420, [0.0] * 16, 1), (None, [1.0] * 16, 1)]
    return {"documents": docs, "benchmark": benchmark, "pages": pages, "embeddings": embeddings}


def write(folder, rows: dict[str, list[tuple]]):
    for name, schema in TABLES.items():
        columns = list(zip(*rows[name])) or [[] for _ in schema]
        pq.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rows = made()
    return rows, write(tmp_path_factory.mktemp("tables"), rows)


def got(spark, tables, name, schema):
    df = queries.QUERIES[name](spark, tables[1])
    wanted = [x.split() for x in schema.split(", ")]
    assert df.dtypes[: len(wanted)] == [tuple(x) for x in wanted]
    return Counter(tuple(r)[: len(wanted)] for r in df.collect())


def test_op1(spark, tables):
    docs, n, out = tables[0]["documents"], suffix_dedup.LENGTH, []
    raw = [UTF8(r[1]) for r in docs]
    count = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    for r, b in zip(docs, raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((r[0], len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    assert got(spark, tables, "op1_suffix_dedup", "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string") == Counter(out)


def test_op2(spark, tables):
    pytest.importorskip("public_tokenizers")
    sp, out = library(), []
    for r in tables[0]["documents"]:
        ids = sp.encode(r[1]) if r[1] else []
        out.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), True))
    assert got(spark, tables, "op2_sentencepiece", "doc_id bigint, n_tokens bigint, ids_sha256 string, round_trip boolean") == Counter(out)


def test_op3(spark, tables):
    def shard(key, n):
        def score(s):
            h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
            return np.log(((xxhash.xxh64_intdigest(struct.pack("<i", s), h) >> 11) + 0.5) / (1 << 53)), s

        return max(map(score, range(n)))[1]

    rows = queries.QUERIES["op3_sharding"](spark, tables[1]).collect()
    own = Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in rows)
    assert own == Counter((r[0], len(UTF8(r[1])) + 1, zlib.crc32(UTF8(r[1])), "key", shard(r[0], 8), shard(r[0], 9)) for r in tables[0]["documents"])
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_op4(spark, tables):
    assert got(spark, tables, "op4_ngram_jaccard_join", "doc_id bigint, n_shingles bigint, component_id bigint") == classes_by_force(tables[0]["documents"])


def test_op5(spark, tables):
    best: dict[str, int] = {}
    pages = tables[0]["pages"]
    for i, _, html in pages:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    out, seen = [], set()
    for i, _, html in pages:
        first = best[html or ""]
        own = (-1 if i is None else i) == first and html not in seen
        seen |= {html} if own else set()
        body = UTF8(html)
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else first))
    assert got(spark, tables, "op5_warc", "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint") == Counter(out)


def test_op6(spark, tables):
    assert got(spark, tables, "op6_decontamination", "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean") == hits_by_force(tables[0]["documents"], tables[0]["benchmark"])


def test_op7(spark, tables):
    """The network's answers are those of convolution, pooling and softmax worked out naively."""
    docs = spark.read.parquet(f"{tables[1]}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    net = langid.fit(docs.where(F.coalesce(~held, F.lit(False))))
    out = {}
    for i, text, *_ in tables[0]["documents"]:
        raw, means = UTF8(text), []
        for lo in range(0, len(raw), langid.WINDOW):
            x = [int(langid.SYMBOL[b]) for b in raw[lo : lo + langid.WINDOW]]
            x += [langid.PAD] * (langid.WINDOW - len(x))
            pooled = [max(sum(f[o, x[p + o], c] for o in range(len(f))) for p in range(langid.WINDOW - len(f) + 1)) for f in net.filters for c in range(f.shape[2])]
            z = np.maximum(np.array(pooled) + net.bias, 0) @ net.dense + net.out_bias
            means.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
            if len(means) == 3:
                break
        lettered = any(c.isalpha() for c in text or "")
        if len(raw) <= 3 * langid.WINDOW:
            p = np.mean(means, 0) if lettered else None
            out[i, text] = (net.languages[int(p.argmax())], float(p.max())) if lettered else ("und", 0.0)
    rows = queries.QUERIES["op7_language_id"](spark, tables[1])
    assert rows.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    by_id = Counter(r["doc_id"] for r in rows.collect())
    assert by_id == Counter(r[0] for r in tables[0]["documents"])
    for r in rows.collect():
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        mine = [v for (i, _), v in out.items() if i == r["doc_id"]]
        if len(mine) == 1 and by_id[r["doc_id"]] == 1:
            assert r["lang_pred"] == mine[0][0] and r["score"] == pytest.approx(mine[0][1], abs=1e-5)


def test_op8(spark, tables):
    x = np.array([v for i, v, _ in tables[0]["embeddings"][:300]], np.float64)
    rows = queries.QUERIES["op8_nearest_neighbours"](spark, tables[1])
    assert rows.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    found = Counter(tuple(r) for r in rows.collect())
    right = total = 0
    for q in range(0, 300, 20):
        score = (x * x[q]).sum(1)
        best = {i for i in np.lexsort((np.arange(300), -score)) if i != q}
        own = [r for r in found if r[0] == q]
        order = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:20]
        assert sorted(r[1] for r in own) == list(range(1, 21)) and all(r[3] == score[r[2]] and r[2] in best for r in own)
        right, total = right + len({r[2] for r in own} & set(order)), total + 20
    assert right >= 0.95 * total and {r[0] for r in found} == set(range(0, 300, 20))


def test_op9(spark, tables):
    order, out = ("email", "ip", "card", "phone"), []
    for r in tables[0]["documents"]:
        spans = sorted(base_by_force(r[1] or ""), key=lambda z: (order.index(z[0]), z[1]))
        out.append((r[0], *(sum(z[0] == k for z in spans) for k in order), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()))
    assert got(spark, tables, "op9_personal_data", "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string") == Counter(out)


def test_op10(spark, tables):
    docs = tables[0]["documents"]
    wanted = Counter((i, s, n, k, hashlib.md5(UTF8(t)).hexdigest()) for (i, s, t, n, k), m in lines_by_force([(r[0], r[1], r[2], r[3]) for r in docs], 0.1).items() for _ in range(m))
    assert got(spark, tables, "op10_line_dedup", "doc_id bigint, source string, n_lines bigint, n_dropped bigint, kept_md5 string") == wanted


def test_op11(spark, tables):
    out = []
    for i, text, *_ in tables[0]["documents"]:
        w = UTF8(text).split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        found = runs_by_force(w, 4, 6)
        gone = {k for s, e, q in found for k in range(s + q, e)}
        best = min(((s - e, s, q) for s, e, q in found), default=None)
        told = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
        out.append((i, len(found), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    schema = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    assert got(spark, tables, "op11_periodic_runs", schema) == Counter(out) and any(r[1] for r in out)


def test_op12(spark, tables):
    order, out = ("assign", "access", "hex"), []
    for i, text, *_ in tables[0]["documents"]:
        spans = secrets_by_force(text)
        out.append((i, *(sum(z[0] == k for z in spans) for k in order), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()))
    assert got(spark, tables, "op12_secret_scan", "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string") == Counter(out)


def test_op13(spark, tables):
    schema = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
    assert got(spark, tables, "op13_phrase_collocations", schema) == phrases_by_force([(r[1], r[2]) for r in tables[0]["documents"]])


def test_empty_tables(spark, tmp_path):
    folder = write(tmp_path, {name: [] for name in TABLES})
    for name, query in queries.QUERIES.items():
        assert query(spark, folder).count() == 0, name


def test_stages_of_empty_tables(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as cp

    folder = write(tmp_path, {name: [] for name in TABLES})
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, folder).count() == 0

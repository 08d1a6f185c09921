"""The ``opN_*`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .decontam import decontaminate
from .langid import fit, predict
from .line_dedup import BOILERPLATE_RATIO, MIN_PAGES, drop_boilerplate
from .ngram_join import similar_documents
from .periodic import periodic_runs
from .phrases import collocations
from .pii import find_pii
from .secrets import BASE as SECRET_KINDS
from .secrets import find_secrets
from .sentencepieces import Vocabulary, encode
from .sharding import assign_shards
from .suffix_dedup import remove_repeats
from .warc import arc_to_warc, pages_to_arc, read_warc_pages, scratch

SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents without the strings that stand more than once; cases as in :func:`remove_repeats`."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return out.select(
        "doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"),
        F.size("removed_spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def tokenizer_path() -> str:
    """The model file: CORPUS_TOKENIZER in the driver's environment, or the installed public one."""
    if os.environ.get("CORPUS_TOKENIZER"):
        return os.environ["CORPUS_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the comma-joined numbers), round_trip (decoding gives the text back).

    Null text has 0 tokens, as an empty one has, and counts as a round trip.
    """
    vocabulary = Vocabulary.load(tokenizer_path())
    made = encode(docs.select("doc_id", "text"), vocabulary, decoded="decoded")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    return made.select(
        "doc_id", F.size(ids).cast("bigint").alias("n_tokens"), F.sha2(F.array_join(ids, ","), 256).alias("ids_sha256"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip")
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded; cases as in :func:`encode`."""
    return token_summary(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``key``: doc_id and the number of shards decide; nulls and ties as in :func:`assign_shards`.

    A null text has size 1 and CRC 0, as an empty one has.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    out = assign_shards(docs, "doc_id", [1.0] * SHARDS, tie_break=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents by links of Jaccard similarity 0.8 on 5-word shingles; cases as in :func:`similar_documents`."""
    return similar_documents(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as ARC archives, converted to WARC archives and read back; cases as in :func:`arc_to_warc`."""
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    pages_to_arc(table(spark, sf_dir, "pages"), arc)
    arc_to_warc(spark, arc, warc)
    return read_warc_pages(spark, warc)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item; cases as in :func:`decontaminate`."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's language, learnt from the documents that are not held out; cases as in :func:`predict`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    net = fit(docs.where(F.coalesce(~held_out, F.lit(False))))
    out = predict(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), net)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20; cases as in :func:`nearest`."""
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document; cases as in :func:`find_pii`."""
    return find_pii(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their boilerplate lines dropped; ``source`` is the host.  Cases as in :func:`drop_boilerplate`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = drop_boilerplate(docs, "source", "text")
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.md5(F.coalesce(F.col("kept_text"), F.lit(""))).alias("kept_md5"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; of every tenth id's text the words from one place on go over into a period of its own.

    A null id has no digits and plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    picked = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).alias("w"))
    n = F.size("w")
    placed = picked.withColumn("a", F.when(n > 0, F.pmod(F.col("g"), n)).cast("int"))
    period = placed.withColumn("p", (F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))
    made = F.concat(F.slice("w", 1, F.col("a")), F.slice(tail, 1, n - F.col("a")))
    return period.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every whole document, of which every tenth has one planted; cases as in :func:`periodic_runs`."""
    out = periodic_runs(planted_runs(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    # the longest first; of equal lengths the smallest start, then period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    told = out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = F.col("b.s"), -F.col("b.l"), F.col("b.p")
    return told.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document; cases as in :func:`find_secrets`."""
    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda z: F.concat_ws(":", z["kind"], z["start"].cast("string"), z["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda z: z["kind"] == kind)).cast("bigint")
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in SECRET_KINDS], F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("secret_spans").alias("spans"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first phrases by score; cases as in :func:`collocations`."""
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_sharding": op3_sharding,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_warc": op5_warc,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_personal_data": op9_personal_data,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_secret_scan": op12_secret_scan,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op10_line_dedup": f"""
with parts as (
  select doc_id, source, text, string_split(text, chr(10)) as parts from documents),
trimmed as (
  select source, unnest(list_distinct(list_transform(parts, lambda x: trim(x, ' ' || chr(9) || chr(13))))) as line
  from parts where source is not null and text is not null),
counts as (select source, line, count(*) as n from trimmed where line <> '' group by source, line),
totals as (select source, count(*) as pages from documents where source is not null group by source),
plates as (
  select c.source, list(line) as lines from counts c join totals t on c.source = t.source
  where n >= {MIN_PAGES} and n::double / pages > {BOILERPLATE_RATIO} group by c.source),
kept as (
  select d.doc_id, d.source, d.parts,
         case when p.lines is null then d.parts
              else list_filter(d.parts, lambda x: not list_contains(p.lines, trim(x, ' ' || chr(9) || chr(13)))) end as k
  from parts d left join plates p on d.source = p.source)
select doc_id, source, coalesce(len(parts), 0)::bigint as n_lines, coalesce(len(parts) - len(k), 0)::bigint as n_dropped,
       md5(coalesce(array_to_string(k, chr(10)), '')) as kept_md5
from kept
""",
    "op5_warc": """
with own as (select *, row_number() over (partition by coalesce(html, '') order by page_id desc nulls last) as place, max(page_id) over (partition by coalesce(html, '')) as first, sha1(coalesce(html, '')) as hex from pages)
select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, ((k // 4) * 5 + 1)::int, 5))::bigint >> (15 - 5 * (k % 4))::int) & 31) + 1)::bigint, 1)), '') as payload_digest,
  case when place = 1 then 'response' else 'revisit' end as record_type, case when place > 1 then first end as refers_to
from own
""",
    "op6_decontamination": r"""
with split_docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
split_items as (
  select coalesce(item_id::varchar, 'null') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
starts as (select item, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from split_items where len(w) > 0),
windows as (select distinct item, n, array_to_string(w[k : k + n - 1], ' ') as t from starts),
sizes as (select distinct n from windows),
places as (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from split_docs cross join sizes where len(w) >= n),
found as (select r, item, k, p.n from places p join windows v on v.n = p.n and v.t = array_to_string(p.w[k : k + p.n - 1], ' ')),
hits as (select r, count(distinct h) as n_hit from (select r, unnest(range(k, k + n)) as h from found) x group by r),
items as (select r, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as ids from found group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from split_docs d left join hits h on h.r = d.r left join items i on i.r = d.r
""",
    "op13_phrase_collocations": """
with split as (
  select row_number() over () as r, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select r, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as piece from split),
worded as (select row_number() over () as r, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
words as materialized (select r, lang, unnest(w) as w1, unnest(range(len(w))) as k from worded),
next as (
  select lang, w1, lead(w1, 1) over p as w2, lead(w1, 2) over p as w3, lead(w1, 3) over p as w4 from words window p as (partition by r order by k)),
counts as materialized (
  select lang, 1 as m, w1 as phrase, count(*) as f from next group by lang, w1
  union all select lang, 2, w1 || ' ' || w2, count(*) from next where w2 is not null group by 1, 3 having count(*) >= 30
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from next where w3 is not null group by 1, 3 having count(*) >= 30
  union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) from next where w4 is not null group by 1, 3 having count(*) >= 30),
totals as (select lang, sum(f)::bigint as n from counts where m = 1 group by lang),
candidates as materialized (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from counts where m > 1),
cuts as (select *, unnest(range(1, m)) as k from candidates),
scored as (
  select c.lang, c.m, c.phrase, c.a, c.k, x.f as l, y.f as r, ((2000000::hugeint * c.a) // (x.f + y.f))::bigint as score
  from cuts c join counts x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : c.k], ' ') and x.m = c.k
  join counts y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1 :], ' ') and y.m = c.m - c.k),
worst as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_parts as (
  select c.lang, array_to_string(c.w[p : p + s - 1], ' ') as phrase, max(c.a) as longer
  from (select lang, w, a, s, unnest(range(1, m - s + 2)) as p from candidates cross join (values (2), (3)) as sizes(s) where s < m) c group by 1, 2),
kept as (
  select o.* from worst o left join inner_parts i on i.lang = o.lang and i.phrase = o.phrase
  where i.longer is null or 100::hugeint * i.longer < 80::hugeint * o.a)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, k.phrase) as rank, k.phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score
from kept k join totals t on t.lang = k.lang
qualify row_number() over (partition by k.lang order by score desc, a desc, k.phrase) <= 2000
""",
}

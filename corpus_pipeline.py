"""A training-data pipeline over ``documents``; part of the subpackage ``cohortspark.llm``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns a DataFrame that is written as Parquet and read again.  All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import queries as q
from cohortspark.llm._base import discard, fresh, materialize, scope
from cohortspark.llm.decontam import decontaminate
from cohortspark.llm.langid import UNKNOWN, fit, predict
from cohortspark.llm.line_dedup import drop_boilerplate
from cohortspark.llm.ngram_join import first_of_classes, text_digest


#: A text whose best language has a lower mean probability is in none of the languages that were learnt.  Of four
#: languages chance is 0.25; of held-out labelled texts (sf0.01) of ``JUDGED`` bytes or more the lowest score is 0.64.
LEAST_SCORE = 0.45
#: Texts of fewer bytes are too short for their score to reject them.
JUDGED = 64


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network has learnt.

    Those without text or letters go, and those whose score is below
    ``LEAST_SCORE``.  Without any labelled text nothing is learnt, and the
    score rejects nothing.
    """
    net = fit(docs)
    lang, score = fresh(docs, "lang"), fresh(docs, "score")
    told = predict(docs, net, lang=lang, score=score)
    if not net.languages:
        return docs.where(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    return told.where((F.col(lang) != UNKNOWN) & ((F.col(score) >= LEAST_SCORE) | (F.octet_length("text") < JUDGED))).drop(lang, score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their site's boilerplate lines; those of nothing else go.

    Documents without a site or text stay as they are; ids are not read, and
    repeated rows are pages of their own.  An empty table gives none.
    """
    kept, lines, dropped = (fresh(docs, x) for x in ("kept", "lines", "dropped"))
    out = drop_boilerplate(docs, "source", "text", kept=kept, n_lines=lines, n_dropped=dropped)
    left = out.where((F.col(dropped) == 0) | F.coalesce(F.length(F.trim(F.regexp_replace(kept, r"\s+", " "))) > 0, F.lit(False)))
    changed = F.col(dropped) > 0
    columns = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.char_length(kept).cast("bigint")).otherwise(F.col("n_chars"))
    return left.withColumns(columns).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones, that with the smallest id, then the smallest MD5; of equal ids and texts one row.

    Rows that share an id are documents of their own, each in its text's
    class.  Documents without words or with a null id are in no class and stay.
    """
    t = fresh(docs, "t")
    first = materialize(first_of_classes(docs), "first").withColumnRenamed("t", t)
    classed = F.col("doc_id").isNotNull() & F.coalesce(F.octet_length(F.ltrim("text", F.lit(" \t\n\v\f\r"))) > 0, F.lit(False))
    one = docs.where(classed).withColumn(t, text_digest("text")).join(first, ["doc_id", t], "left_semi").dropDuplicates(["doc_id", t])
    return one.select(*docs.columns).unionByName(docs.where(~classed))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; each row is judged by its own text, which its MD5 names.

    Null and empty texts hold none and stay, whatever their ids; repeated rows
    stay or go together.  An empty table gives none.
    """
    h = fresh(docs, "h")
    own = docs.select(text_digest("text").alias("doc_id"), "text")
    # written first, so that its size is known: small, it is broadcast and the texts stay where they are
    hit = materialize(decontaminate(own, q.table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias(h)).distinct(), "hit")
    return docs.withColumn(h, text_digest("text")).join(hit, h, "left_anti").select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: counted, digested, and decoded again.

    A row a row, repeated ones and null ids too; null text has 0 tokens.  An
    empty table gives none.
    """
    return q.token_summary(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("benchmark decontamination", decontamination),
    ("SentencePiece", sentencepiece),
]

#: A trained classifier and similarity classes have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next stage's input.

    A stage's tables, and the stage's before it, go when its result is written.
    """
    docs, before = q.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scope() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower()))
        discard(*before)
        before = [docs]
    return docs

"""Line dedup by site-relative frequency, in DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import crowds, fresh, left_join, materialize

#: A line on more than this share of a host's pages is boilerplate,
BOILERPLATE_RATIO = 0.1
#: if it is on more than one: a line that stands on a single page does not repeat on its site.
MIN_PAGES = 2


def line_mark(line: Column) -> Column:
    """The MD5 of a line without the spaces and tabs around it: equal lines have the same one."""
    return F.unhex(F.md5(F.trim(line, F.lit(" \t\r"))))


def boilerplate(pages: DataFrame, host: str, text: str, *, ratio: float = BOILERPLATE_RATIO, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """(host, marks) of each host with boilerplate, with its boilerplate lines' marks, and (host, pages) of each host.

    A page has a line if any of its lines equals it after trimming spaces and
    tabs; repeats on one page count once and blank lines not at all.  Since
    the shares of a host's lines add up to its mean number of lines a page, a
    host has at most that mean divided by ``ratio`` boilerplate lines, which
    bounds the array.  Counting is by (host, mark) with partial sums before
    the shuffle, so a host with a third of all pages is spread over all tasks
    and no line's text travels.  Pages without a host belong to no site and
    are left out.
    """
    own = pages.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = materialize(own.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "totals")
    blank = F.unhex(F.md5(F.lit("")))
    lines = own.select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), line_mark))).alias("mark")).where(F.col("mark") != blank)
    counts = lines.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    over = counts.join(totals, "host").where(F.col("n").cast("double") / F.col("pages") > F.lit(float(ratio)))
    return over.groupBy("host").agg(F.collect_list("mark").alias("marks")), totals


def drop_boilerplate(
    pages: DataFrame, host: str, text: str, *, kept: str = "kept_text", n_lines: str = "n_lines", n_dropped: str = "n_dropped",
    ratio: float = BOILERPLATE_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``pages`` with its text less its host's boilerplate lines, and counts of both.

    Lines end at ``\\n``; the remaining lines stay as they are, blank ones
    included.  Null text stays null with 0 lines, an empty text is one blank
    line; without a host nothing is dropped.  Repeated rows are pages of their
    own, a very long text is one row like any other, and an empty table gives
    none.  Columns named ``kept``, ``n_lines`` and ``n_dropped`` are replaced;
    a result that may not do so is given other names.
    """
    h, b = (fresh(pages, x, kept, n_lines, n_dropped) for x in ("host", "plates"))
    found, totals = boilerplate(pages, host, text, ratio=ratio, min_pages=min_pages)
    # written first, so that its size is known: small, it is broadcast and the texts stay where they are
    plates = materialize(found, "plates").select(F.concat(F.lit("h"), F.col("host").cast("string")).alias(h), F.col("marks").alias(b))
    # if it is not small, hosts with many pages still get theirs from a broadcast of bounded arrays
    rows = totals.agg(F.sum("pages")).first()[0] or 0
    crowd = crowds(totals.select(F.concat(F.lit("h"), F.col("host").cast("string")).alias(h), "pages"), h, "pages", rows)
    salt = F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string"))
    joined = left_join(pages.withColumn(h, F.concat(F.lit("h"), F.col(host).cast("string"))), plates, h, crowd, salt).drop(h)
    parts = F.split(F.col(text), "\n")
    left = F.when(F.col(b).isNull(), parts).otherwise(F.filter(parts, lambda x: ~F.array_contains(F.col(b), line_mark(x))))
    k = fresh(pages, "left", kept, n_lines, n_dropped)
    out = joined.withColumn(k, left)
    return out.withColumns({
        kept: F.array_join(k, "\n"), n_lines: F.coalesce(F.size(parts), F.lit(0)).cast("bigint"),
        n_dropped: F.coalesce(F.size(parts) - F.size(k), F.lit(0)).cast("bigint")
    }).drop(b, k)

"""Paragraphs of paged text: running heads, hyphens at line ends, paragraphs over page breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def page_lines(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """``(doc, page, pos, line, edge)``: lines that aren't blank; the first and the last of a page are its edges."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    p = pages.select(doc, page, F.size(lines).alias("_n"), F.posexplode(lines).alias("pos", "line"))
    return p.select(doc, page, F.col("pos").cast("long").alias("pos"), "line", ((F.col("pos") == 0) | (F.col("pos") == F.col("_n") - 1)).alias("edge"))


def furniture(lines: DataFrame, pages: DataFrame, doc: str, least: int = 3, share: float = 0.5) -> DataFrame:
    """``(doc, masked, n)``: edge lines, digits masked, on ``least`` pages and ``share`` of the document's pages at least."""
    total = pages.groupBy(doc).agg(F.count("*").alias("_pages"))
    masked = F.regexp_replace("line", r"[0-9]+", "#").alias("masked")
    n = lines.where("edge").groupBy(doc, masked).agg(F.count("*").alias("n"))
    return n.join(total, doc).where(F.col("n") >= F.greatest(F.lit(float(least)), F.lit(share) * F.col("_pages"))).select(doc, "masked", "n")


def paragraphs(lines: DataFrame, heads: DataFrame, doc: str, page: str) -> DataFrame:
    """``(doc, paragraph, first_page, last_page, text)``: lines without running heads, joined up to a sentence end.

    A hyphen at a line's end before a small letter is closed. A document's lines are the bound of a task.
    """
    body = lines.withColumn("masked", F.regexp_replace("line", r"[0-9]+", "#"))
    body = body.join(heads.select(doc, "masked", F.lit(True).alias("_head")), [doc, "masked"], "left").where("not (edge and coalesce(_head, false))")
    w = W.partitionBy(doc).orderBy(page, "pos")
    ended = F.coalesce(F.regexp_like(F.lag("line").over(w), F.lit("[.!?:]$")), F.lit(True))
    body = body.withColumn("_new", ended.cast("long")).withColumn("paragraph", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "pos", "line"))), lambda x: x["line"]), "\n")
    closed = F.regexp_replace(F.regexp_replace(text, r"([a-z])-\n([a-z])", "$1$2"), "\n", " ")
    return body.groupBy(doc, "paragraph").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), closed.alias("text"))

"""A stored lexical index in blocks with upper bounds: stemmed terms, and blocks that can't reach a query's best scores aren't read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions import stem
from lexmill.functions.text import words
from lexmill.operators.retrieve import B, K1, ranked
from lexmill.plans.checkpoint import Workspace
from lexmill.plans.layout import spread

#: Documents of a block, and blocks of a file, about.
BLOCK, FILE = 128, 16
#: Scores are rounded to six places, so that a bound may lie below a rounded score by this much.
SLACK = 1e-6


def write_index(docs: DataFrame, id_col: str, fields: dict[str, float], path: str, stemmed: bool = True) -> None:
    """Stores BM25 postings below ``path``: ``blocks``, a row for each term and block of documents, ``terms`` with their idf and largest part, and ``meta``.

    A document's part of a score but for the term's idf is stored, and each block has its largest. Documents are dealt to blocks by a hash of their ids, about ``BLOCK`` to each, so that a row stays small however frequent
    its term is. Words are shuffled once, to the files of their blocks; there words are counted and grouped without another shuffle, a file's documents at a time. A file is sorted by term and has all terms of its blocks, so a document is scored in the
    task that reads it. Rows that repeat an id count as one document in blocks and postings; ids should be unique.
    """
    names = [f"w_{i}" for i in range(len(fields))]
    length = sum((F.size(n) * F.lit(float(w)) for n, w in zip(names, fields.values(), strict=True)), F.lit(0.0))
    all_ = spread(docs.select(id_col, *fields)).select(*cut_columns(id_col, fields)).select(length.alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.avg(F.when(F.col("dl") > 0, F.col("dl"))), F.lit(1.0)).alias("avgdl")).first()
    blocks = max(1, -(-all_.n // BLOCK))
    d = docs.select(*cut_columns(id_col, fields))
    d = stem.with_stems(d, names) if stemmed else d
    d = d.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks))).withColumn("file", F.floor(F.col("block") / FILE)).repartition(-(-blocks // FILE), "file")
    own = F.concat(*(F.transform(n, lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w"))) for n, w in zip(names, fields.values(), strict=True)))  # noqa: B023
    # grouped by the file first, which the rows are dealt by already
    tf = d.select("file", "block", "id", length.alias("dl"), F.explode(own).alias("x")).groupBy("file", "block", "id", "dl", "x.term").agg(F.sum("x.w").alias("tf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / all_.avgdl))
    rows = tf.groupBy("file", "block", "term").agg(F.max(weight).alias("top"), F.count("*").cast("int").alias("n"), F.collect_list(F.struct("id", weight.alias("weight"))).alias("posts"))
    rows.select("term", "block", "top", "n", "posts").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
    stored = docs.sparkSession.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("most"))
    stored.withColumn("idf", F.log(1 + (all_.n - F.col("df") + 0.5) / (F.col("df") + 0.5))).write.mode("overwrite").parquet(f"{path}/terms")
    docs.sparkSession.createDataFrame([(all_.n, all_.avgdl, stemmed)], "n long, avgdl double, stemmed boolean").write.mode("overwrite").parquet(f"{path}/meta")


def cut_columns(id_col: str, fields: dict[str, float]) -> list[Column]:
    """The id and the words of each field."""
    return [F.col(id_col).alias("id"), *(words(F.coalesce(F.col(c), F.lit(""))).alias(f"w_{i}") for i, c in enumerate(fields))]


class Search:
    """The steps of one search of a stored index; ``asked(query, term, idf, most)`` are the queries' terms that the index has."""

    def __init__(self, queries: DataFrame, path: str, query_id: str, query_terms: Column, k: int, ws: Workspace | None = None):
        self.spark, self.path, self.k = queries.sparkSession, path, k
        self.ws = ws or Workspace(self.spark, "search")
        self.blocks = self.spark.read.parquet(f"{path}/blocks")
        self.asked = self.ws.table(asked_terms(queries, path, query_id, query_terms), "asked")

    def hits(self, terms: DataFrame, blocks: DataFrame) -> DataFrame:
        """``(query, block, id, found)``: scores by the given ``(query, term, idf)`` in the given ``(query, block)``. Files have all terms of a document, so most of a sum is done where it is read."""
        met = terms.select("query", "term", "idf").join(self.blocks.select("term", "block", "posts"), "term").join(blocks.select("query", "block"), ["query", "block"], "left_semi")
        x = met.select("query", "block", "idf", F.explode("posts").alias("x"))
        return x.groupBy("query", "block", F.col("x.id").alias("id")).agg(F.sum(F.col("idf") * F.col("x.weight")).alias("found"))

    def bounds(self, terms: DataFrame, name: str) -> DataFrame:
        """``(query, block, bound)``: the sum of the terms' largest parts in each block, from the narrow columns."""
        return terms.select("query", "term", "idf").join(self.blocks.select("term", "block", "top"), "term").groupBy("query", "block").agg(F.sum(F.col("idf") * F.col("top")).alias(name))

    def plan(self) -> tuple[DataFrame, DataFrame]:
        """``(query, term, idf, least, needed)`` and the blocks ``(query, block, least)`` that may hold one of a query's ``k``.

        The ``k`` blocks with the largest bounds are scored first, and their kth score is ``least`` (null if there are fewer documents): blocks with a smaller bound hold none of the ``k``. Of the terms,
        those that can't reach ``least`` together even with their largest parts aren't ``needed`` to find a document, as each of the ``k`` has another term too.
        """
        bounds = self.ws.table(self.bounds(self.asked, "bound"), "bounds")
        first = bounds.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("bound"), "block"))).where(F.col("place") <= self.k).select("query", "block")
        seen = self.hits(self.asked, self.ws.table(first, "first")).select("query", "id", F.round("found", 6).alias("score"))
        least = self.ws.table(ranked(seen, "score").where(F.col("rank") == self.k).select("query", F.col("score").alias("least")), "least")
        together = F.sum(F.col("idf") * F.col("most")).over(W.partitionBy("query").orderBy(F.col("idf") * F.col("most"), "term").rowsBetween(W.unboundedPreceding, W.currentRow))  # a query's terms
        terms = self.asked.withColumn("together", together).join(least, "query", "left")
        terms = terms.select("query", "term", "idf", (F.col("least").isNull() | (F.col("together") + SLACK >= F.col("least"))).alias("needed"))
        able = bounds.join(least, "query", "left").where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))).drop("bound")
        return self.ws.table(terms, "terms"), self.ws.table(able, "able")

    def candidates(self, terms: DataFrame, able: DataFrame) -> DataFrame:
        """``(query, block, id, found)``: documents with a needed term that may reach ``least`` with all that their block can add by the other terms."""
        more = self.bounds(terms.where("not needed"), "more")
        d = self.hits(terms.where("needed"), able).join(able, ["query", "block"]).join(more, ["query", "block"], "left")
        return self.ws.table(d.where(F.col("least").isNull() | (F.col("found") + F.coalesce("more", F.lit(0.0)) + SLACK >= F.col("least"))).select("query", "block", "id", "found"), "candidates")


def asked_terms(queries: DataFrame, path: str, query_id: str, query_terms: Column) -> DataFrame:
    """``(query, term, idf, most)``: the distinct terms of each query that the index has, stemmed if its terms are."""
    spark = queries.sparkSession
    asked = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(query_terms)).alias("term"))
    if spark.read.parquet(f"{path}/meta").first().stemmed:
        asked = stem.with_stem(asked, "term").select("query", F.col("stem").alias("term")).distinct()
    return asked.join(spark.read.parquet(f"{path}/terms"), "term").select("query", "term", "idf", "most")


def search(queries: DataFrame, path: str, query_id: str, query_terms: Column, k: int, ws: Workspace | None = None) -> DataFrame:
    """Best ``k`` documents of each query, any term matching: ``(query, id, score, rank)``, the same as scoring every posting. Scores are rounded before ranking, ties go by id."""
    s = Search(queries, path, query_id, query_terms, k, ws)
    terms, able = s.plan()
    found = s.candidates(terms, able)
    more = s.hits(terms.where("not needed"), found.select("query", "block").distinct()).select("query", "id", F.col("found").alias("more"))
    whole = found.join(more, ["query", "id"], "left").select("query", "id", F.round(F.col("found") + F.coalesce("more", F.lit(0.0)), 6).alias("score"))
    return ranked(whole, "score").where(F.col("rank") <= k)


def postings_read(queries: DataFrame, path: str, query_id: str, query_terms: Column, k: int, ws: Workspace | None = None) -> DataFrame:
    """``(query, postings, read)``: postings of a query's terms, and those in the blocks that are read for it, the first ones apart."""
    s = Search(queries, path, query_id, query_terms, k, ws)
    terms, able = s.plan()
    some = s.candidates(terms, able).select("query", "block").distinct().withColumn("some", F.lit(True))
    d = terms.join(s.blocks.select("term", "block", "n"), "term").join(able.select("query", "block", F.lit(True).alias("able")), ["query", "block"], "left").join(some, ["query", "block"], "left")
    return d.groupBy("query").agg(F.sum("n").alias("postings"), F.coalesce(F.sum(F.when(F.when(F.col("needed"), F.col("able")).otherwise(F.col("some")), F.col("n"))), F.lit(0)).alias("read"))

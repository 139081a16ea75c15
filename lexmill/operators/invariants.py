"""Invariants of a chunked corpus as one report of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import PLACEHOLDER, digest


def violations(blocks: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """``(invariant, key)``: one row for every key that breaks an invariant.

    Blocks are ``(segment, pos, text)``, positions from 1; chunks ``(chunk, segment, ordinal, first, last, text, text_sha256)``;
    edges ``(source, target, relation)`` between chunks. A chunk's text is its blocks joined by a blank line. Null texts count as empty;
    empty tables break nothing. Blocks meet chunks on the segment and the range, and no row holds more than a segment's blocks.
    """
    c = chunks.withColumn("text", F.coalesce("text", F.lit("")))
    b = blocks.select(F.col("segment").alias("_s"), "pos", F.coalesce("text", F.lit("")).alias("_t"))
    report = lambda name, df, key: df.select(F.lit(name).alias("invariant"), F.col(key).cast("string").alias("key")).distinct()

    hits = b.join(c.select("chunk", "segment", "first", "last"), (F.col("_s") == F.col("segment")) & F.col("pos").between(F.col("first"), F.col("last")), "left")
    met = hits.groupBy("_s", "pos").agg(F.count("chunk").alias("n"))
    marks = lambda df, key, t: df.select(key, F.explode(F.regexp_extract_all(t, F.lit(PLACEHOLDER), F.lit(0))).alias("mark")).distinct()
    lost = marks(b, "_s", "_t").join(marks(c, "segment", "text").withColumnRenamed("segment", "_s"), ["_s", "mark"], "left_anti")
    joined = hits.where("chunk is not null").groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("pos", "_t"))), lambda x: x["_t"]), "\n\n").alias("whole"))
    altered = c.join(joined, "chunk", "left").where("text <> coalesce(whole, '')")
    ordinals = c.groupBy("segment").agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count("*").alias("n"), F.count_distinct("ordinal").alias("d"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("end")).distinct()
    parts = [
        report("BLOCK_GAP", met.where("n = 0"), "_s"),
        report("BLOCK_OVERLAP", met.where("n > 1"), "_s"),
        report("LOST_PLACEHOLDER", lost, "_s"),
        report("ALTERED_TEXT", altered, "chunk"),
        report("WRONG_HASH", c.where(~F.col("text_sha256").eqNullSafe(digest(F.col("text")))), "chunk"),
        report("DUPLICATE_CHUNK", c.groupBy("chunk").count().where("count > 1"), "chunk"),
        report("ORDINAL_GAP", ordinals.where("lo <> 1 or hi <> n or d <> n"), "segment"),
        report("UNKNOWN_SEGMENT", c.join(b.select(F.col("_s").alias("segment")).distinct(), "segment", "left_anti"), "segment"),
        report("DANGLING_ENDPOINT", ends.join(c.select(F.col("chunk").alias("end")), "end", "left_anti"), "end"),
        report("DUPLICATE_EDGE", edges.groupBy("source", "relation", "target").count().where("count > 1").withColumn("edge", F.concat_ws("|", "source", "relation", "target")), "edge"),
    ]
    return reduce(DataFrame.unionByName, parts)

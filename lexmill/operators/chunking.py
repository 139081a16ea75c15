"""Grouping ordered blocks into chunks, and checks of chunks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(blocks: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    """One row per document with its blocks in order; a document's blocks are the bound."""
    return blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("blocks"))


def _grouped(docs: DataFrame, key: str, step) -> DataFrame:
    start = F.struct(F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("acc"), F.array().cast("array<bigint>").alias("out"))
    out = F.aggregate("blocks", start, step, lambda a: a["out"])
    return docs.select(key, F.posexplode(F.arrays_zip(F.col("blocks").alias("b"), out.alias("g"))).alias("pos", "x")).select(key, F.col("pos").cast("long").alias("pos"), F.col("x.g").alias("grp"))


def close_after(docs: DataFrame, key: str, size, target: int) -> DataFrame:
    """Group of each block where a group ends once its size reaches the target."""

    def step(a: Column, b: Column) -> Column:
        n = a["acc"] + size(b)
        return F.struct((a["g"] + (n >= target).cast("long")).alias("g"), F.when(n >= target, F.lit(0).cast("long")).otherwise(n).alias("acc"), F.concat(a["out"], F.array(a["g"])).alias("out"))

    return _grouped(docs, key, step)


def close_before(docs: DataFrame, key: str, size, most: int, heading) -> DataFrame:
    """Group of each block where a group ends before a block that would overflow it, or before a heading once a third is full."""

    def step(a: Column, b: Column) -> Column:
        n = size(b)
        cut = (a["acc"] > 0) & ((a["acc"] + n > most) | (heading(b) & (a["acc"] * 3 >= most)))
        g = a["g"] + cut.cast("long")
        return F.struct(g.alias("g"), F.when(cut, n).otherwise(a["acc"] + n).alias("acc"), F.concat(a["out"], F.array(g)).alias("out"))

    return _grouped(docs, key, step)


def windows(blocks: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Fixed windows of ``n`` blocks."""
    return blocks.withColumn("chunk", F.ceil(F.row_number().over(W.partitionBy(key).orderBy(order)) / n).cast("long"))


def islands(blocks: DataFrame, key: str, order: str, begins: Column) -> DataFrame:
    """Adds ``island``: a new one begins where ``begins`` holds."""
    return blocks.withColumn("island", F.sum(begins.cast("long")).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def range_join(chunks: DataFrame, blocks: DataFrame, key: str, first: str, last: str, order: str) -> DataFrame:
    """Blocks between the first and the last position of each chunk of the same document."""
    b = blocks.withColumnRenamed(key, "_k")
    return chunks.join(b, (F.col(key) == F.col("_k")) & F.col(order).between(F.col(first), F.col(last))).drop("_k")


def severed(chunks: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Adds ``severed``: the text ends without a sentence end and the next one of the key begins in lower case."""
    after = F.trim(F.lead(text).over(W.partitionBy(key).orderBy(order)))
    open_end = ~F.regexp_like(F.rtrim(text), F.lit(r"[.!?:;,\"')\]]$"))
    return chunks.withColumn("severed", open_end & F.coalesce(F.regexp_like(after, F.lit(r"^\p{Ll}")), F.lit(False)))


def defects(text: Column, after: Column, title: Column, ordinal: Column) -> Column:
    """Names of what is wrong with a chunk."""
    t = F.trim(F.coalesce(text, F.lit("")))
    marker = r"^(\([a-z0-9]{1,4}\)|[-*•])\s"
    found = [
        F.when(t == "", "EMPTY_TEXT"),
        F.when((t != "") & ~F.regexp_like(t, F.lit(r"[.!?:;,\"')\]]$")) & F.coalesce(F.regexp_like(F.trim(after), F.lit(r"^\p{Ll}")), F.lit(False)), "SEVERED_SENTENCE"),
        F.when(F.regexp_like(t, F.lit(r"\b(or|and|unless)\W*$")), "SEVERED_ENUMERATION"),
        F.when(F.endswith(t, F.lit(":")), "SEVERED_LIST_STEM"),
        F.when(F.regexp_like(t, F.lit(marker)) & (ordinal > 1), "ORPHAN_LIST_ITEM"),
        F.when((t != "") & (F.greatest(F.lit(1), F.floor(F.length(t) / 4)) < 15), "TOO_SMALL_TO_RETRIEVE"),
        F.when(F.trim(F.coalesce(title, F.lit(""))) == "", "NO_TITLE"),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def not_continuous(chunks: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Keys whose ordinals aren't 1 to n."""
    g = chunks.groupBy(key).agg(F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"), F.count("*").alias("n"), F.count_distinct(ordinal).alias("d"))
    return g.where("lo <> 1 or hi <> n or d <> n").select(key)


# Beginnings of provisions in plain statutory text. Fixed value.
PROVISION = r"(?m)^\s*(?:(?:Section|Regulation|Article|Schedule)\s+)?\d+[A-Z]?\s+(?=[A-Z(])"


def provision_cuts(text: str, target: int, most: int) -> list[int]:
    """Ends of windows that prefer provisions' beginnings and never exceed ``most`` characters.

    A window ends at the last provision within ``most``, else at the last blank line behind half of ``target``, else at ``most``.
    """
    marks = np.array(sorted({m.start() for m in re.finditer(PROVISION, text)} | {len(text)}))
    cuts, start = [], 0
    while start < len(text):
        near = marks[np.searchsorted(marks, start, "right") : np.searchsorted(marks, start + most, "right")]
        if len(near):
            end = int(near[-1])
        else:
            blank = text.rfind("\n\n", start + target // 2 + 1, start + most)
            end = blank if blank > 0 else start + most
        cuts.append(min(end, len(text)))
        start = cuts[-1]
    return cuts


def provision_windows(docs: DataFrame, id_col: str, text: str = "text", target: int = 9000, most: int | None = None) -> DataFrame:
    """``(id, window, start, text)``: each text in windows that put together give it again; null and empty texts have none."""
    most = most or int(target * 1.6)

    def work(batches):
        for batch in batches:
            ids, made = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                cuts = provision_cuts(t or "", target, most)
                ids += [i] * len(cuts)
                made += [(k, a, t[a:b]) for k, (a, b) in enumerate(zip([0, *cuts][: len(cuts)], cuts, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["id", "window", "start", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(work, f"id {kind}, window long, start long, text string").withColumnRenamed("id", id_col)

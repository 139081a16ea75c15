"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.llm.textkit import WORD
from lexmill.plans.checkpoint import Workspace

#: Rows of a source in one stretch of its order, about; a stretch is what one task sorts.
STRETCH = 4096
#: Cells of the keys' logarithm by which a source's order is cut into stretches: so many for each unit.
CELLS = 64
#: Weight of a document by its label of quality; without one.
BY_LABEL, UNLABELLED = {1: 1.0, 0: 0.25}, 0.5


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size)`` -> that with ``target``: the budget by weight, no source above ``most`` times its size.

    The budget is ``share`` of all sizes. Sources by code point, null last, weigh ``weights`` in turn.
    What a source can't take is shared again by weight until none is above its cap; that ends where every
    source has the lesser of its cap and one common rate times its weight, so the rate is found in one
    ordered pass over the sources, by rising cap to weight. One row per source, no document's row.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("budget", share * F.sum("source_size").over(W.partitionBy()))
    s = s.withColumn("rate", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rate = F.min(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rate"))).over(W.partitionBy())["rate"]
    return s.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.coalesce(rate * F.col("weight"), "cap"))).alias("target"))


def unit(*cols: str, seed: str = ""):
    """A fixed number in (0, 1) of the columns: 52 bits of their SHA-256."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, labels: DataFrame | None = None, quality: str = "quality", seed: str = "mix", stretch: int = STRETCH, with_stretch: bool = False, ws: Workspace | None = None) -> DataFrame:
    """How much of every document a mix takes: ``(id, source, size, source_size, target, taken, text_hash)``.

    Size: the text's words (null: 0). A source's target is met by complete epochs, then by documents in
    falling order of Efraimidis-Spirakis keys, the exponentials ``-ln(u) / quality`` rising, until their
    prefix sums fill the rest; the document that crosses it gives its first words only. ``u`` is a hash of id and
    ``seed``, so reruns agree. Quality is a document's label in ``labels`` (the largest, if several; one column is named as the ids), 1 or 0, which weigh 1 and 0.25; without a
    label 0.5. A source's order is cut by the counts of its keys into stretches of equal rows, whatever the weights: sums of stretches are ranked
    first, and only a stretch is sorted in one task, so a hot source is split. Null sources are one source;
    empty texts take part with size 0 and give nothing; equal keys go by id, then size; repeated ids are ordered together; an empty table
    gives an empty result; further columns are ignored.
    """
    ws = ws or Workspace(docs.sparkSession, "mix")
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_col).alias("text_hash"))
    weight = F.lit(UNLABELLED)
    if labels is not None:
        own = ws.table(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("of")).agg(F.max(quality).alias("label")), "labels")
        d = d.join(own, F.col("id") == F.col("of"), "left").drop("of")
        weight = F.coalesce(*(F.when(F.col("label") == k, v) for k, v in BY_LABEL.items()), F.lit(UNLABELLED))
    d = d.withColumn("key", -F.log(unit("id", seed=seed)) / weight).select("id", "source", "size", "text_hash", "key")
    d = ws.table(d.withColumn("cell", F.floor(F.log("key") * CELLS)), "sizes")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = ws.table(source_targets(sizes, weights, share, most), "targets").withColumnRenamed("source", "of")
    d = d.join(targets, d["source"].eqNullSafe(targets["of"])).drop("of")
    # a stretch is a cell's rows before it, and its own by the place of the key in the cell, in units of ``stretch``
    cells = d.groupBy("source", "cell").agg(F.count("*").alias("rows"))
    cells = cells.select(F.col("source").alias("of"), F.col("cell").alias("at"), "rows", F.coalesce(F.sum("rows").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    d = d.join(ws.table(cells, "cells"), d["source"].eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at"))).drop("of", "at")
    inner = F.log("key") * CELLS - F.col("cell")
    d = d.withColumn("stretch", F.floor((F.col("first") + inner * F.col("rows")) / stretch)).drop("cell", "rows", "first")
    sums = d.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    sums = sums.select(F.col("source").alias("of"), F.col("stretch").alias("cut"), F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    d = d.join(ws.table(sums, "stretches"), d["source"].eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("cut"))).drop("of", "cut")
    inside = W.partitionBy("source", "stretch").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return d.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "text_hash", *(["stretch"] if with_stretch else []))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until the table has no such column."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None, **options) -> DataFrame:
    """The mix as documents: each as often as whole copies are taken, and the one that crosses a source's target once more with its first words.

    A document of which nothing is taken goes, so null and empty texts go. Columns, of any name, stay as they are, but a cut text's words are parted by blanks. Repeated
    rows are taken one by one; ties and null sources as in ``mix_sources``; an empty table gives an empty result.
    """
    of, hashed, size, taken, copy, row = free_names(docs, "_id", "_hash", "_size", "_taken", "_copy", "_row")
    mix = mix_sources(docs, id_col, text_col, ws=ws, **options).where("taken > 0")
    mix = (ws or Workspace(docs.sparkSession, "mixed")).table(mix, "taken")
    d = docs.withColumn(hashed, F.xxhash64(text_col)).withColumn(row, F.lit(1))
    mix = mix.withColumn("turn", F.lit(1))
    if not mix.groupBy(id_col, "text_hash").count().where("count > 1").isEmpty():  # rows that repeat id and text: each share once
        turn = lambda *c: F.row_number().over(W.partitionBy(*c[:2]).orderBy(*c))
        mix = mix.withColumn("turn", turn(F.col(id_col), F.col("text_hash"), F.desc("taken")))
        d = d.withColumn(row, turn(F.col(id_col), F.col(hashed)))
    mix = mix.select(F.struct(F.col(id_col).alias("id"), F.col("text_hash").alias("hash"), "turn").alias(of), F.col("size").alias(size), F.col("taken").alias(taken))
    same = F.col(id_col).eqNullSafe(F.col(f"{of}.id")) & (F.col(hashed) == F.col(f"{of}.hash")) & (F.col(row) == F.col(f"{of}.turn"))
    d = d.join(mix.hint("merge"), same)
    whole, rest = F.expr(f"int({taken} div {size})"), F.expr(f"int({taken} % {size})")
    d = d.withColumn(copy, F.explode(F.sequence(F.lit(1), whole + F.when(rest > 0, 1).otherwise(0))))
    cut = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)), F.lit(1), rest), " ")
    return d.withColumn(text_col, F.when(F.col(copy) <= whole, F.col(text_col)).otherwise(cut)).select(docs.columns)

"""How far the sources of a language stand apart: bounded search for overused terms, distances of sources from postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.llm.textkit import LOWER, blocks, give_back, pieces, words
from lexmill.plans.checkpoint import Workspace
from lexmill.plans.layout import spread

#: Bytes that are in no term: all of ASCII but its letters.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:128] = True
OUTSIDE[65:91] = OUTSIDE[97:123] = False

#: Rows that a task counts together before it sends them on.
HELD = 1 << 17

#: Added to every count, and the unit of probabilities.
PRIOR, UNIT = 5, 1_000_000_000


NAMES = ["lang", "source", "term", "n", "docs"]


def counted(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    """The tables' counts by group and term, as one."""
    if held:
        t = pa.concat_tables(held).group_by(NAMES[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        t = pa.table([t["lang"], t["source"], t["term"].cast(pa.binary()).cast(pa.string()), t["n_sum"], t["docs_sum"]], names=NAMES)
        yield from t.to_batches(max_chunksize=1 << 15)


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and documents with the term. Blocks of texts are counted in their task before anything is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held = [], 0
        for rows, data, at in blocks(batches):
            own = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
            names = sorted(set(own))
            number = {x: i for i, x in enumerate(names)}
            group = np.array([number[x] for x in own])
            low = LOWER[data]
            start, end, first = words(low, at, OUTSIDE)
            if not len(start):
                continue
            term = pieces(low, start, end).dictionary_encode()
            size = len(term.dictionary)
            each, n = np.unique(np.repeat(np.arange(len(own)), np.diff(first)) * size + term.indices.to_numpy(), return_counts=True)
            key, place = np.unique(group[each // size] * size + each % size, return_inverse=True)
            of = pa.array(key // size)
            held.append(
                pa.table([pa.array([x[0] for x in names]).take(of), pa.array([x[1] for x in names]).take(of), term.dictionary.take(pa.array(key % size)), np.bincount(place, n).astype(np.int64), np.bincount(place).astype(np.int64)], names=NAMES)
            )
            rows_held += len(key)
            if rows_held > HELD:
                yield from counted(held)
                held, rows_held = [], 0
        yield from counted(held)
        held.clear()
        give_back()

    d = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    found = spread(d).mapInArrow(work, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * terms)) in decimals, so exact for any counts; 0 where there are no terms."""
    over = F.expr(f"CAST({UNIT} AS DECIMAL(10,0))") * (n + PRIOR).cast("decimal(20,0)")
    return F.when(terms > 0, 1 + F.call_function("div", over, (total + PRIOR * terms).cast("decimal(20,0)"))).otherwise(0)


def overused(posted: DataFrame, k: int) -> DataFrame:
    """The ``k`` terms of each group with the largest p - q above 0: ``(lang, source, item, value, rank)``.

    A group's terms with one count share p, so they are a bucket, and the smallest probability in the language of its terms bounds p - q. Buckets are evaluated best first, in two
    waves: those with the largest bounds until they hold ``k`` terms; then all others whose bound isn't strictly below the kth value found so far, as no term of the rest can be among the ``k``.
    Both waves keep ``k`` rows of a group in each task before the shuffle.
    """
    group = ["lang", "source"]
    best_first = W.partitionBy(*group).orderBy(F.desc("bound"), F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    buckets = posted.groupBy(*group, "n", "p").agg(F.min("q").alias("least"), F.count("*").alias("terms")).withColumn("bound", F.col("p") - F.col("least")).where("bound > 0")
    buckets = buckets.withColumn("first", F.coalesce(F.sum("terms").over(best_first), F.lit(0)) < k).select(*group, "n", "bound", "first")

    def evaluated(chosen: DataFrame) -> DataFrame:
        found = posted.join(chosen.select(*group, "n"), [*group, "n"]).where("p > q").select(*group, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        return found.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("value"), "item"))).where(F.col("rank") <= k)

    kth = evaluated(buckets.where("first")).where(F.col("rank") == k).select(*group, F.col("value").alias("kth"))
    return evaluated(buckets.join(kth, group, "left").where("first OR kth IS NULL OR bound >= kth"))


def distances(posted: DataFrame, groups: DataFrame) -> DataFrame:
    """Sum of abs(p - q) over all kept terms for each two sources of a language: ``(lang, source, item, value, rank)``.

    With z = abs(p0 - q0) for the probabilities of a count of 0, the sum is V z, plus abs(p - q0) - z for each term that one has, plus the same for the other,
    plus abs(p - q) - abs(p - q0) - abs(p0 - q) + z for each term that both have. The last comes from joining the postings of a term, at most one for each source; the others from
    running sums over a source's counts, without a row for each term and pair.
    """
    one, other = (groups.select("lang", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "p0", "held")), "terms") for x in "ab")
    each = one.join(other, ["lang", "terms"]).where("source_a <> source_b")
    z = F.abs(F.col("p0_a") - F.col("p0_b"))
    base = each.where("source_a < source_b").select("lang", "source_a", "source_b", (z * (F.col("terms") - F.col("held_a") - F.col("held_b"))).alias("value"))

    counts = posted.groupBy("lang", F.col("source").alias("source_a"), F.col("p").alias("at")).agg(F.count("*").alias("k"))
    asked = each.select("lang", "source_a", F.col("p0_b").alias("at"), F.lit(0).cast("long").alias("k"), "source_b")
    line = counts.withColumn("source_b", F.lit(None).cast("string")).unionByName(asked).repartition("lang", "source_a")
    whole, below = W.partitionBy("lang", "source_a"), W.partitionBy("lang", "source_a").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    k, s = F.sum("k"), F.sum(F.col("k") * F.col("at"))
    away = F.col("at") * (2 * k.over(below) - k.over(whole)) + s.over(whole) - 2 * s.over(below)
    alone = line.withColumn("value", away).where("source_b is not null").select("lang", F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b"), "value")

    a, b = (posted.select("lang", "term", F.col("source").alias(f"source_{x}"), F.col("p").alias(f"p_{x}"), F.col("p0").alias(f"p0_{x}")) for x in "ab")
    gain = F.abs(F.col("p_a") - F.col("p_b")) - F.abs(F.col("p_a") - F.col("p0_b")) - F.abs(F.col("p0_a") - F.col("p_b")) + z
    both = a.join(b, ["lang", "term"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(gain).alias("value"))

    parts = base.unionByName(alone).unionByName(both).repartition("lang", "source_a", "source_b")
    total = parts.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    sides = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    out = total.select("lang", F.explode(sides).alias("x"), "value").select("lang", "x.source", "x.item", "value")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30, top: int = 50, ws: Workspace | None = None) -> DataFrame:
    """Audit of the sources of each language: ``(lang, source, part, item, value, rank)``.

    A term is a run of ASCII letters and other characters beyond ASCII, A-Z as a-z; a language keeps the terms that at least ``least_docs`` of its rows have. A group is a language and a source that occur together,
    and it gives each kept term 1 + floor(10^9 (count + 5) / (N + 5 V)), N being its occurrences of the V kept terms; so does the language as a whole. Part `pair` has the sum of the absolute differences
    to each other source of the language, part `term` the ``top`` terms that a group has and gives more than its language. Ranks fall with the value, then rise with the item's UTF-8 bytes.
    Null languages and sources are '', null and empty texts have no terms but their groups count. Rows that repeat count as often as they occur. Without kept terms all distances are 0; a language of one source
    has no pairs; an empty table gives an empty one. Ids are not read, further columns neither.
    """
    ws = ws or Workspace(docs.sparkSession, "divergence")
    counts = ws.table(term_counts(docs, lang_col, source_col, text_col), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    own = ws.table(counts.drop("docs").join(kept, ["lang", "term"]), "own")
    named = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    words_of = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    langs = own.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    groups = named.join(words_of, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "held", "lang_total", "terms"])
    groups = ws.table(groups.withColumn("p0", probability(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    p, q = probability(F.col("n"), F.col("total"), F.col("terms")), probability(F.col("all"), F.col("lang_total"), F.col("terms"))
    posted = own.join(groups.drop("held"), ["lang", "source"]).select("lang", "source", "term", "n", p.alias("p"), q.alias("q"), "p0")
    posted = ws.table(posted, "postings")
    cols = ("lang", "source", F.lit("pair").alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return distances(posted, groups).select(*cols).unionByName(overused(posted, top).withColumn("part", F.lit("term")).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")))

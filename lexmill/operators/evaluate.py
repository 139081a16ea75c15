"""Ranking metrics, agreement of judges and paired tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.plans.checkpoint import Workspace


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def ndcg(ranked: DataFrame, qrels: DataFrame, k: int, pooled: bool) -> DataFrame:
    """``(query, ndcg)``: the ideal order is of all judged rows (pooled; null where all are 0) or of the returned ones (0 then)."""
    r = ranked.where(F.col("rank") <= k).join(qrels, ["query", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    dcg = r.groupBy("query").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    ideal = (qrels if pooled else r).select("query", "grade").withColumn("i", F.row_number().over(W.partitionBy("query").orderBy(F.desc("grade"))))
    best = ideal.where(F.col("i") <= k).groupBy("query").agg(F.sum(gain(F.col("grade"), F.col("i"))).alias("best"))
    value = F.when(F.col("best") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("best")).otherwise(F.lit(None) if pooled else F.lit(0.0))
    return best.join(dcg, "query", "left").select("query", F.round(value, 6).alias("ndcg"))


def first_hit(ranked: DataFrame, qrels: DataFrame, least: int) -> DataFrame:
    """``(query, first_rank, rr)`` of the first row with a grade of ``least`` or more."""
    r = ranked.join(qrels, ["query", "id"], "left")
    first = F.min(F.when(F.col("grade") >= least, F.col("rank")))
    return r.groupBy("query").agg(first.alias("first_rank"), F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("rr"))


def kappa(ratings: DataFrame, top: int) -> DataFrame:
    """Quadratic weighted kappa of each two judges: ``(a, b, n, exact, kappa)`` from ``(item, judge, grade)``; null where chance explains all."""
    x, y = (ratings.select("item", F.col("judge").alias(j), F.col("grade").alias(g)) for j, g in (("a", "ga"), ("b", "gb")))
    pairs = x.join(y, "item").where("a < b")
    w = F.pow((F.col("ga") - F.col("gb")) / F.lit(float(top)), 2)
    seen = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg((F.col("ga") == F.col("gb")).cast("double")).alias("exact"), F.avg(w).alias("observed"))
    one = lambda j, g: pairs.groupBy("a", "b", g).agg(F.count("*").alias(f"n_{j}"))
    chance = one("a", "ga").join(one("b", "gb"), ["a", "b"]).groupBy("a", "b").agg(F.sum(w * F.col("n_a") * F.col("n_b")).alias("chance"))
    k = F.when(F.col("chance") > 0, 1 - F.col("observed") * F.col("n") * F.col("n") / F.col("chance"))
    return seen.join(chance, ["a", "b"]).select("a", "b", "n", F.round("exact", 6).alias("exact"), F.round(k, 6).alias("kappa"))


def consensus(ratings: DataFrame, judges: int = 3) -> DataFrame:
    """``(item, status, grade)``: the median where all judges are within one grade, else for adjudication."""
    g = ratings.groupBy("item").agg(F.count("*").alias("n"), F.min("grade").alias("lo"), F.max("grade").alias("hi"), F.median("grade").alias("grade")).where(F.col("n") == judges)
    agreed = F.col("hi") - F.col("lo") <= 1
    return g.select("item", F.when(agreed, "AGREED").otherwise("REQUIRES_ADJUDICATION").alias("status"), F.when(agreed, F.col("grade")).alias("grade"))


def sign_test(deltas: DataFrame) -> DataFrame:
    """Exact two-sided sign test of ``(pair, delta)``: ``(pair, wins, losses, p)``; ties count for neither."""
    g = deltas.groupBy("pair").agg(F.sum((F.col("delta") > 0).cast("long")).alias("wins"), F.sum((F.col("delta") < 0).cast("long")).alias("losses"))
    n, low = F.col("wins") + F.col("losses"), F.least("wins", "losses")
    # logarithms of binomial terms by the ratio of neighbours, from 2^-n, which itself is 0 in a double for more than 1074 pairs
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), low), F.struct((n * F.lit(math.log(0.5))).alias("t"), F.lit(0.0).alias("s")), lambda a, i: F.struct(F.when(i < n, a["t"] + F.log((n - i) / (i + 1))).otherwise(a["t"]).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")), lambda a: a["s"])
    return g.select("pair", "wins", "losses", F.round(F.least(F.lit(1.0), 2 * tail), 6).alias("p"))


def bootstrap(deltas: DataFrame, replicates: int, seed: str, ws: Workspace | None = None) -> DataFrame:
    """Mean and 95 % interval of ``(i, delta)``, rows drawn by a hash of seed, replicate and place, so any engine draws alike.

    Places are numbered within ranges of ``i`` and then by the rows of the ranges before, and a draw is a row from the start: no task and no plan holds all of them.
    """
    spark = deltas.sparkSession
    ws = ws or Workspace(spark, "bootstrap")
    ranged = deltas.select("i", "delta").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.asc_nulls_last("i"))
    d = ws.table(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    sizes = d.groupBy("part").agg(F.count("*").alias("rows")).withColumn("before", F.sum("rows").over(W.orderBy("part")) - F.col("rows"))  # a row for each range
    within = F.row_number().over(W.partitionBy("part").orderBy(F.asc_nulls_last("i"))) - 1
    placed = ws.table(d.withColumn("within", within).join(F.broadcast(sizes), "part").select((F.col("within") + F.col("before")).alias("place"), "delta"), "placed")
    n = placed.count()
    draw = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("replicate").cast("string"), F.col("slot").cast("string")), 256), 1, 8), 16, 10).cast("long") % F.lit(max(n, 1))
    slots = spark.range(replicates * n).select(F.expr(f"id div {max(n, 1)}").alias("replicate"), (F.col("id") % F.lit(max(n, 1))).alias("slot"))
    means = slots.select("replicate", draw.alias("place")).join(placed, "place").groupBy("replicate").agg(F.avg("delta").alias("m"))
    q = means.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))
    return placed.agg(F.round(F.avg("delta"), 6).alias("mean"), F.count("*").alias("n")).crossJoin(q)


def diagnosis(in_final: Column, in_pool: Column, in_corpus: Column) -> Column:
    """Where a target was lost; the order of the tests matters."""
    return F.when(in_final, "OK").when(in_pool, "RANKING_PROBLEM").when(in_corpus, "GENERATION_PROBLEM").otherwise("NOT_IN_CORPUS")


def requirement_coverage(judged: DataFrame) -> DataFrame:
    """``(query, requirements, content, strict)`` of ``(query, requirement, support, role_ok)``: shares of requirements with full support, and with full support by a source of the wanted role."""
    full = F.col("support") == "FULL"
    met = judged.groupBy("query", "requirement").agg(F.max(F.coalesce(full, F.lit(False)).cast("int")).alias("content"), F.max(F.coalesce(full & F.col("role_ok"), F.lit(False)).cast("int")).alias("strict"))
    return met.groupBy("query").agg(F.count("*").alias("requirements"), F.round(F.avg("content"), 6).alias("content"), F.round(F.avg("strict"), 6).alias("strict"))


#: Upper limits of uniform numbers below 2^32 for 0, 1, ... events of a Poisson variable of mean 1; above the last there are as many as there are limits.
POISSON = [int(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(9)]


def uniform(h: np.ndarray, r: np.ndarray) -> np.ndarray:
    """A number below 2^32 for each group's hash and replicate, in integers that any engine has."""
    x = (h[:, None] + r[None, :] * 0x9E3779B9) & 0xFFFFFFFF
    for shift, by in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
        x = ((x ^ (x >> shift)) * by) & 0xFFFFFFFF
    return x ^ (x >> 15)


def grouped_bootstrap(deltas: DataFrame, replicates: int = 2000, seed: str = "37") -> DataFrame:
    """``(n_groups, delta, low, high, wins, ties, losses, p)`` of paired differences ``(group, delta)``: groups weigh alike, and whole groups are drawn.

    Every group gets a Poisson number of copies in every replicate, from a hash of seed, group and replicate. So there is one pass: a task sums its groups' copies and differences for all replicates, and Spark
    adds those sums up, ``replicates`` rows a task. Null differences are left out. Without groups ``n_groups`` is 0 and the rest null, but p, which is 1 without wins and losses.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("group").cast("string")), 256), 1, 8), 16, 10).cast("long")
    each = deltas.where("delta is not null").groupBy("group").agg(F.avg("delta").alias("delta")).select(h.alias("h"), "delta")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, copies, sums = np.arange(replicates, dtype=np.int64), np.zeros(replicates, np.int64), np.zeros(replicates)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                n = np.searchsorted(POISSON, uniform(part.column(0).to_numpy(), r), "right")
                copies += n.sum(0)
                sums += part.column(1).to_numpy() @ n
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(copies), pa.array(sums)], names=["replicate", "copies", "sums"])

    boot = each.mapInArrow(work, "replicate long, copies long, sums double").groupBy("replicate").agg((F.sum("sums") / F.nullif(F.sum("copies"), F.lit(0))).alias("m"))
    q = boot.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))
    total = each.agg(F.count("*").alias("n_groups"), F.round(F.avg("delta"), 6).alias("delta"))
    sides = sign_test(each.where(F.abs("delta") > 1e-12).select(F.lit("all").alias("pair"), "delta")).select("wins", "losses", "p")
    out = total.crossJoin(F.broadcast(q)).join(F.broadcast(sides), F.lit(True), "left")  # a row each
    return out.select("n_groups", "delta", "low", "high", F.coalesce("wins", F.lit(0)).alias("wins"), (F.col("n_groups") - F.coalesce("wins", F.lit(0)) - F.coalesce("losses", F.lit(0))).alias("ties"), F.coalesce("losses", F.lit(0)).alias("losses"), F.coalesce("p", F.lit(1.0)).alias("p"))

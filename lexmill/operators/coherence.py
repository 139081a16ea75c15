"""How alike the topics of linked nodes are, against chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.plans.checkpoint import Workspace

#: Pairs of a component that are compared, in order of their members' ids.
PAIRS = 400
#: Places of a slot, and the draws of a place before it counts as failed: one in PLACES slots is hit, so a draw fails with a probability of about 1e-5 in all.
PLACES, TRIES = 16, 192


def similarity(a: str, b: str) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def draw(seed: str, *parts: Column) -> Column:
    """A number below 2^32 from a SHA-256, so that any engine draws alike."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts)), 256), 1, 8), 16, 10).cast("long")


def random_pairs(nodes: DataFrame, draws: int, seed: str, ws: Workspace) -> DataFrame:
    """``(draw, a, b)``: seeded pairs of different nodes of ``(id)``, each node equally likely, without numbering the nodes.

    Nodes are hashed to as many slots as there are nodes, and get places within their slot. A draw names a slot and a place and counts if a node is there; else it is drawn again, as is the second node where it equals the first.
    So tasks meet by slot, and a draw's rows are ``TRIES`` for each end, whatever the number of nodes.
    """
    n = nodes.count()
    if n < 2:
        return nodes.sparkSession.createDataFrame([], f"draw long, a {nodes.schema['id'].dataType.simpleString()}, b {nodes.schema['id'].dataType.simpleString()}")
    slots = nodes.select("id", (draw(seed, F.lit("slot"), F.col("id")) % n).alias("slot"))
    slots = slots.withColumn("place", F.row_number().over(W.partitionBy("slot").orderBy("id")) - 1)
    each = nodes.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))))
    each = each.withColumn("slot", draw(seed, F.lit("at"), F.col("draw"), F.col("side"), F.col("try")) % n).withColumn("place", (draw(seed, F.lit("place"), F.col("draw"), F.col("side"), F.col("try")) % PLACES).cast("int"))
    met = ws.table(each.join(slots, ["slot", "place"]).select("draw", "side", "try", "id"), "draws")
    first = met.where("side = 0").groupBy("draw").agg(F.min_by("id", "try").alias("a"))
    return met.where("side = 1").join(first, "draw").where("id <> a").groupBy("draw", "a").agg(F.min_by("id", "try").alias("b"))


def chance(topics: DataFrame, draws: int, seed: str, ws: Workspace) -> DataFrame:
    """One row, ``baseline``: the mean similarity of random pairs of the nodes ``(id, topics)`` that have topics."""
    some = topics.where(F.size("topics") > 0)
    p = random_pairs(some.select("id"), draws, seed, ws)
    p = p.join(some.select(F.col("id").alias("a"), F.col("topics").alias("_a")), "a").join(some.select(F.col("id").alias("b"), F.col("topics").alias("_b")), "b")
    return p.agg(F.round(F.avg(similarity("_a", "_b")), 6).alias("baseline"))


def of_relations(edges: DataFrame, topics: DataFrame, draws: int = 4000, seed: str = "13", ws: Workspace | None = None) -> DataFrame:
    """``(relation, edges, mean, median, zero_share, baseline, lift)`` of the edges ``(source, target, relation)`` whose ends both have topics; lift is null where chance gives 0."""
    ws = ws or Workspace(edges.sparkSession, "coherence")
    some = topics.where(F.size("topics") > 0)
    end = lambda e, name: some.select(F.col("id").alias(e), F.col("topics").alias(name))
    j = edges.join(end("source", "_a"), "source").join(end("target", "_b"), "target").select("relation", similarity("_a", "_b").alias("j"))
    r = j.groupBy("relation").agg(F.count("*").alias("edges"), F.avg("j").alias("m"), F.round(F.percentile("j", F.lit(0.5)), 6).alias("median"), F.round(F.avg((F.col("j") == 0).cast("double")), 6).alias("zero_share"))
    r = r.crossJoin(F.broadcast(chance(topics, draws, seed, ws)))  # one row
    return r.select("relation", "edges", F.round("m", 6).alias("mean"), "median", "zero_share", "baseline", F.round(F.try_divide("m", "baseline"), 2).alias("lift"))


def of_components(members: DataFrame, topics: DataFrame, pairs: int = PAIRS, least: int = 3) -> DataFrame:
    """``(component, size, pairs, mean)`` of the components of ``(component, node)`` with ``least`` nodes, of which two have topics.

    Compared are the first ``pairs`` pairs of a component's nodes with topics, in order of both ids; the bound is part of the measure. They need the first ``pairs`` + 1 nodes at most, which each task keeps before the
    shuffle, so a component of any size is ranked without gathering it, and a node is the first of its pairs only if it begins within the bound.
    """
    size = members.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    some = members.join(topics.where(F.size("topics") > 0).withColumnRenamed("id", "node"), "node")
    some = some.withColumn("i", F.row_number().over(W.partitionBy("component").orderBy("node"))).where(F.col("i") <= pairs + 1)
    m = some.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("m")).where("m > 1")
    a = some.join(m, F.col("component") == F.col("c")).withColumn("before", (F.col("i") - 1) * F.col("m") - F.col("i") * (F.col("i") - 1) / 2).where(F.col("before") < pairs)
    b = some.select(F.col("component").alias("c"), F.col("i").alias("j"), F.col("topics").alias("other"))
    p = a.drop("c").join(b, (F.col("component") == F.col("c")) & (F.col("j") > F.col("i")) & (F.col("before") + F.col("j") - F.col("i") <= pairs))
    mean = p.groupBy("component").agg(F.count("*").alias("pairs"), F.round(F.avg(similarity("topics", "other")), 6).alias("mean"))
    return size.join(mean, "component")

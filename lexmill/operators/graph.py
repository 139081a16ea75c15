"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.plans.checkpoint import Workspace


#: A node is a hub from this share of the edge ends on (so there are at most 1 / HUB of them); its edges are dealt to SALTS tasks.
HUB, LEAST_HUB, SALTS = 0.002, 256, 64


def _with_least(edges: DataFrame, own: bool, ends: int) -> DataFrame:
    """Adds ``m``, the smallest ``v`` of each ``u`` (or ``u`` itself, if ``own``), where the edges of a hub never meet in one task."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    low = low.select(F.col("u").alias("_u"), F.least("u", "m").alias("m") if own else "m", (F.col("n") > max(LEAST_HUB, HUB * ends)).alias("hub"))
    hubs = F.broadcast(low.where("hub").select(F.col("_u").alias("_h")))  # at most 1 / HUB rows
    e = edges.join(hubs, F.col("u") == F.col("_h"), "left").withColumn("_salt", F.when(F.col("_h").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0).cast("int"))
    low = low.withColumn("_s", F.explode(F.sequence(F.lit(0), F.when(F.col("hub"), SALTS - 1).otherwise(0))))
    return e.join(low, (F.col("u") == F.col("_u")) & (F.col("_salt") == F.col("_s"))).select("u", "v", "m")


def connected_components(edges: DataFrame, ws: Workspace, label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node on an edge: ``(a, b)`` -> ``(node, component)``.

    Alternates large-star and small-star steps; each is a grouped minimum (combined before the shuffle)
    joined back to the edges, those of a hub in salted parts, so a hub's neighbourhood is never gathered in one task. Every round is
    written to the workspace. Self loops and repeated edges are allowed; an empty table gives an empty one.
    """
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    e = ws.table(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}-0")
    before, ends = None, 2 * e.count()
    for k in range(1, max_rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, True, ends).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large, False, ends).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = ws.table(small, f"{label}-{k}")
        ws.drop(f"{label}-{k - 1}")
        after = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first())
        if after == before:
            break
        before, ends = after, 2 * after[0]
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def expand(frontier: DataFrame, edges: DataFrame, per_hop: int) -> DataFrame:
    """One hop for each query: ``(query, node)`` along ``(source, target, confidence)``, the best ``per_hop`` new nodes of a query."""
    hit = frontier.join(edges, F.col("node") == F.col("source")).groupBy("query", F.col("target").alias("node")).agg(F.max("confidence").alias("confidence"))
    new = hit.join(frontier.select("query", "node"), ["query", "node"], "left_anti")
    return new.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("confidence"), "node"))).where(F.col("r") <= per_hop)


def along(edges: DataFrame, *relations: str) -> DataFrame:
    """The edges of some relations."""
    return edges.where(F.col("relation").isin(*relations))


def both_ways(edges: DataFrame) -> DataFrame:
    flipped = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *[c for c in edges.columns if c not in ("source", "target")])
    return edges.unionByName(flipped)


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges.select("source", "target")).groupBy(F.col("source").alias("node")).agg(F.count("*").alias("degree"))


def longest_prefix(keys: DataFrame, key: str, nodes: DataFrame, sep: str = "-") -> DataFrame:
    """Adds ``found``: the key itself or its nearest ancestor among ``nodes(node)``; null where there is none."""
    parts = F.split(key, sep)
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), sep).alias("node")))
    hit = keys.select(key, F.explode(chain).alias("c")).join(nodes, F.col("c.node") == nodes["node"]).groupBy(key).agg(F.max("c").alias("c")).select(F.col(key).alias("_k"), F.col("c.node").alias("found"))
    return keys.join(hit, F.col(key) == F.col("_k"), "left").drop("_k")


def longest_start(keys: DataFrame, key: str, held: DataFrame, prefix: str) -> DataFrame:
    """Adds ``found``: the longest of the strings ``held(prefix)`` that the key starts with, null where there is none.

    Keys are cut at the lengths that prefixes have, and the pieces meet the prefixes by equality, so there is no nested loop: a row for each key and length. Lengths are as many as the longest prefix has characters at most.
    Empty and null prefixes are nobody's start; a key may be its own prefix.
    """
    own = held.select(F.col(prefix).alias("_p")).where("length(_p) > 0").distinct()
    lengths = own.agg(F.array_sort(F.collect_set(F.length("_p"))).alias("_lengths"))  # one row
    each = keys.select(F.col(key).alias("_k")).where("_k is not null").distinct().crossJoin(F.broadcast(lengths))
    cut = each.select("_k", F.explode(F.filter("_lengths", lambda n: n <= F.length("_k"))).alias("_n")).withColumn("_p", F.left("_k", F.col("_n")))
    best = cut.join(own, "_p").groupBy("_k").agg(F.max_by("_p", "_n").alias("found"))
    return keys.join(best, F.col(key) == F.col("_k"), "left").drop("_k")

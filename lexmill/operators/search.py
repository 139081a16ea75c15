"""The whole search for a table of queries: channels, graph expansion, fusion, liveness, priors, lane promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators import graph, retrieve
from lexmill.plans.layout import together


def anchors(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query, anchor, place)``: of each hit in order its chunk, parent and document, each anchor once, where it came first.

    Hits are ``(query, id, rank)``, chunks ``(id, parent, document)``; null and empty anchors are none.
    """
    parts = F.array(*(F.col(c).cast("string") for c in ("id", "parent", "document")))
    x = hits.join(chunks, "id").select("query", "rank", F.posexplode(parts).alias("turn", "anchor")).where("anchor <> ''")
    first = x.groupBy("query", "anchor").agg(F.min(F.struct("rank", "turn")).alias("first"))
    return first.select("query", "anchor", F.row_number().over(W.partitionBy("query").orderBy("first")).cast("long").alias("place"))


def chunks_of(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds ``id``: the chunks whose own id, parent or document is the ``node``; one equi-join over the three keys."""
    keys = chunks.select("id", F.explode(F.array_distinct(F.array(*(F.col(c).cast("string") for c in ("id", "parent", "document"))))).alias("node")).where("node is not null")
    return nodes.join(keys, "node")


def graph_channel(hits: DataFrame, edges: DataFrame, seeds: int = 3, per_hop: int = 20, hops: int = 1, cap: int | None = None) -> DataFrame:
    """``(query, id, rank)``: what the best ``seeds`` of each query reach, the most confident first; ``cap`` bounds the channel's length."""
    frontier = hits.where(F.col("rank") <= seeds).select("query", F.col("id").alias("node"))
    found = []
    for hop in range(hops):
        new = graph.expand(frontier, edges, per_hop).select("query", "node", "confidence", F.lit(hop).alias("hop"))
        found.append(new)
        frontier = together([frontier, new.select("query", "node")])
    rank = F.row_number().over(W.partitionBy("query").orderBy("hop", F.desc("confidence"), "node")).cast("long")
    out = together(found).select("query", F.col("node").alias("id"), rank.alias("rank"))
    return out.where(F.col("rank") <= cap) if cap else out


def search(channels: dict[str, DataFrame], live: DataFrame, edges: DataFrame | None = None, intent: Column | None = None, law: Column | None = None, seeds: int = 3, per_hop: int = 20, hops: int = 1, cap: int | None = None, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` of each query, ``(query, id, score, channels, via_graph_only, rank)`` with the columns of ``live``, and the trace ``(query, stage, n)``.

    ``channels`` are rankings ``(query, id, rank)`` by name. With ``edges`` what the fused head reaches is one more ranked channel. ``live(id, authority, regime, jurisdiction)`` has the
    rows that may be shown: others go after fusion, where they have taken their places. With ``intent`` (a column of
    current_query or legacy_query) scores are weighted by authority, regime and jurisdiction; with ``law`` a query without such a row among its
    first three gets the best of them first. A query without hits has no rows.
    """
    base = retrieve.fuse(channels)
    if edges is not None:
        channels = {**channels, "graph": graph_channel(base, edges, seeds, per_hop, hops, cap)}
        base = retrieve.fuse(channels)
    shown = base.drop("rank").join(live, "id").withColumn("via_graph_only", F.col("channels") == "graph")
    shown = retrieve.with_priors(shown, intent) if intent is not None else retrieve.ranked(shown, "score")
    if law is not None:
        shown = retrieve.promote(shown, law)
    stages = [(name, df) for name, df in channels.items()] + [("fused", base), ("live", shown)]
    trace = None
    for name, df in stages:
        one = df.groupBy("query").agg(F.count("*").alias("n")).select("query", F.lit(name).alias("stage"), "n")
        trace = one if trace is None else trace.unionByName(one)
    return shown.where(F.col("rank") <= k), trace


def expanded(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Queries with the terms that a cache ``(key, terms)`` has for them; the key is the first 24 digits of the text's SHA-256. A miss leaves the query as it is."""
    key = F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 24)
    q = queries.withColumn("_key", key).join(cache.select(F.col("key").alias("_key"), "terms"), "_key", "left")
    return q.withColumn("text", F.concat_ws(" ", "text", "terms")).drop("_key", "terms")


def merged_lanes(laned: DataFrame) -> DataFrame:
    """Lanes as one ranking by score, ties by id: for evaluation."""
    return retrieve.ranked(laned.drop("rank"), "score")

"""Queries of the whole search: aliases, encoded texts, the graph channel, all switches, stored index."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.registry import query
from lexmill.functions import text as T
from lexmill.operators import graph, retrieve, search
from lexmill.plans.checkpoint import Workspace
from lexmill.plans.layout import together
from lexmill.plans.retrieval_queries import OVERLAP, TERMS, bm25_sql, channels, lexical
from lexmill.plans.text_queries import read

ALIAS = "text" + "".join(" || CASE WHEN regexp_matches(text, '{}') AND NOT contains(lower(text), '{}') THEN ' {}' ELSE '' END".format(p, n.lower(), n) for p, n in T.ALIASES)
# every second query names an instrument by its abbreviation
NAMED = "nb AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text || ' under PA 2023 and FOIA' ELSE text END AS text FROM benchmark), ab AS (SELECT item_id, " + ALIAS + " AS text FROM nb)"


@query(f"WITH {NAMED}, {bm25_sql().replace('FROM benchmark', 'FROM ab')} SELECT query, id, score, rank FROM lex")
def alias_expanded_bm25(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").withColumn("text", F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit(" under PA 2023 and FOIA"))).otherwise(F.col("text")))
    return retrieve.bm25(b, read(spark, sf_dir, "documents"), "item_id", T.words(T.with_aliases(F.col("text"))), "doc_id", {"text": 1.0}, 10).select("query", "id", "score", "rank")


@query(f"WITH {bm25_sql()} SELECT query, id, score, rank FROM lex")
def bm25_stored_index(spark, sf_dir):
    """The same ranking from postings that were stored by term."""
    path = Workspace(spark, "stored").path("index")
    retrieve.write_index(read(spark, sf_dir, "documents"), "doc_id", {"text": 1.0}, path)
    return retrieve.search_index(read(spark, sf_dir, "benchmark"), path, "item_id", T.words(F.col("text")), 10).select("query", "id", "score", "rank")


def encoded_sql(table, key):
    return f"""(SELECT id, place, sum(sign) AS v FROM (SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS place, CASE WHEN ('0x' || substr(md5(term), 9, 1))::INT < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign
  FROM (SELECT {key} AS id, unnest({TERMS}) AS term FROM {table})) GROUP BY ALL)"""


ENCODED = f"""qv AS MATERIALIZED {encoded_sql("benchmark", "item_id")}, dv AS MATERIALIZED {encoded_sql("documents", "doc_id")},
qn AS (SELECT id, sqrt(sum(v * v)) AS n FROM qv GROUP BY id HAVING n > 0), dn AS (SELECT id, sqrt(sum(v * v)) AS n FROM dv GROUP BY id HAVING n > 0),
dot AS (SELECT q.id AS query, d.id, sum(q.v * d.v) AS s FROM qv q JOIN dv d USING (place) GROUP BY ALL),
cs AS (SELECT qn.id AS query, dn.id, round(coalesce(s, 0) / (qn.n * dn.n), 5) AS score FROM qn CROSS JOIN dn LEFT JOIN dot ON dot.query = qn.id AND dot.id = dn.id),
enc AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM cs QUALIFY rank <= 10)"""


def encoded(spark, sf_dir, k=10):
    """Vectors of texts; a query's key is made negative, so that it is no document's."""
    q = retrieve.encode(read(spark, sf_dir, "benchmark"), "item_id", F.col("text")).select((-1 - F.col("id")).alias("query"), "vector")
    d = retrieve.encode(read(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return retrieve.nearest(q, d, k).withColumn("query", -1 - F.col("query"))


@query(f"WITH {ENCODED} SELECT query, id, score, rank FROM enc")
def encoded_top10(spark, sf_dir):
    """Nearest documents by signed hashed bags of terms."""
    return encoded(spark, sf_dir)


EDGES = "ge AS (SELECT doc_id AS source, (doc_id * 7 + 3) % (SELECT count(*) FROM documents) AS target, ((doc_id % 10) + 1) / 10.0::DOUBLE AS confidence FROM documents), gb AS MATERIALIZED (SELECT source, target, confidence FROM ge WHERE source <> target UNION ALL SELECT target, source, confidence FROM ge WHERE source <> target)"
GRAPH = f"""{EDGES}, gs AS (SELECT query, id AS node FROM fused WHERE rank <= 3), gh AS (SELECT s.query, gb.target AS node, max(confidence) AS confidence FROM gs s JOIN gb ON gb.source = s.node GROUP BY ALL),
gr AS (SELECT query, node AS id, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, node) AS rank FROM gh ANTI JOIN gs USING (query, node)), gc AS (SELECT * FROM gr WHERE rank <= 5),
gu AS (SELECT * FROM u UNION ALL SELECT query, id, rank, 'graph' FROM gc), gg AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(c, '+' ORDER BY c) AS channels FROM gu GROUP BY query, id)"""
LIVE = "live AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'PRIMARY_LEGISLATION' WHEN 1 THEN 'OFFICIAL_TRAINING' WHEN 2 THEN 'INDUSTRY_PRACTICE' ELSE 'OTHER' END AS authority FROM documents WHERE doc_id % 11 <> 0)"


def doc_edges(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id")
    n = d.agg(F.count("*").alias("n"))
    e = d.crossJoin(F.broadcast(n)).select(F.col("doc_id").alias("source"), ((F.col("doc_id") * 7 + 3) % F.col("n")).alias("target"), (((F.col("doc_id") % 10) + 1) / 10.0).alias("confidence"))  # one row
    return graph.both_ways(e.where("source <> target"))


def live(spark, sf_dir):
    m = F.col("id") % 4
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).where("id % 11 <> 0")
    authority = F.when(m == 0, "PRIMARY_LEGISLATION").when(m == 1, "OFFICIAL_TRAINING").when(m == 2, "INDUSTRY_PRACTICE").otherwise("OTHER")
    return d.withColumns({"authority": authority, "regime": F.when(F.col("id") % 5 == 0, "PA2023").when(F.col("id") % 5 == 1, "PCR2015"), "jurisdiction": F.when(F.col("id") % 7 == 0, "EU")})


@query(f"WITH {bm25_sql()}, {OVERLAP}, {GRAPH}, {LIVE}, r AS (SELECT query, id, score, channels, channels = 'graph' AS via_graph_only, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM gg JOIN live USING (id)) SELECT * FROM r WHERE rank <= 10")
def hybrid_graph(spark, sf_dir):
    """Two channels and the graph channel, rows without effect removed after fusion."""
    hits, _ = search.search(channels(spark, sf_dir), live(spark, sf_dir), doc_edges(spark, sf_dir), cap=5)
    return hits.select("query", "id", "score", "channels", "via_graph_only", "rank")


PRIOR = """pw AS (SELECT query, id, channels, authority, round(score * CASE authority WHEN 'PRIMARY_LEGISLATION' THEN 1.0::DOUBLE WHEN 'OFFICIAL_TRAINING' THEN 0.74::DOUBLE WHEN 'INDUSTRY_PRACTICE' THEN 0.55::DOUBLE ELSE 0.6::DOUBLE END
  * CASE id % 5 WHEN 0 THEN 1.6::DOUBLE WHEN 1 THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN id % 7 = 0 THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score FROM gg JOIN live USING (id)),
pr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM pw), pb AS (SELECT *, min(CASE WHEN authority = 'PRIMARY_LEGISLATION' THEN rank END) OVER (PARTITION BY query) AS best FROM pr),
pp AS (SELECT query, id, score, channels, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN best > 3 AND rank = best THEN 0 ELSE rank END) AS rank FROM pb)"""


def full_search(spark, sf_dir):
    return search.search(channels(spark, sf_dir), live(spark, sf_dir), doc_edges(spark, sf_dir), F.lit("current_query"), F.col("authority") == "PRIMARY_LEGISLATION", cap=5)


@query(f"WITH {bm25_sql()}, {OVERLAP}, {GRAPH}, {LIVE}, {PRIOR} SELECT query, id, score, channels, rank FROM pp WHERE rank <= 10")
def search_all_switches(spark, sf_dir):
    """Lexical, overlap and graph channels, fusion, liveness, priors and the promotion of legislation."""
    return full_search(spark, sf_dir)[0].select("query", "id", "score", "channels", "rank")


@query(f"WITH {bm25_sql()}, {OVERLAP}, {GRAPH}, {LIVE} SELECT query, 'lexical' AS stage, count(*) AS n FROM lex GROUP BY 1 UNION ALL SELECT query, 'overlap', count(*) FROM ovl GROUP BY 1 UNION ALL SELECT query, 'graph', count(*) FROM gc GROUP BY 1 UNION ALL SELECT query, 'fused', count(*) FROM gg GROUP BY 1 UNION ALL SELECT query, 'live', count(*) FROM gg JOIN live USING (id) GROUP BY 1")
def search_trace(spark, sf_dir):
    return full_search(spark, sf_dir)[1]


@query(f"WITH {bm25_sql()}, {OVERLAP}, {GRAPH} SELECT query, id FROM gc ANTI JOIN u USING (query, id)")
def graph_only_candidates(spark, sf_dir):
    """What the graph adds to what was retrieved."""
    own = channels(spark, sf_dir)
    got = search.graph_channel(retrieve.fuse(own), doc_edges(spark, sf_dir), cap=5).select("query", "id")
    return got.join(together((own[c].select("query", "id") for c in ("lexical", "overlap"))).distinct(), ["query", "id"], "left_anti")


CHUNKS = "ck AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'P' || (doc_id % 20) END AS parent, source AS document FROM documents)"


def chunks(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("P"), (F.col("doc_id") % 20).cast("string"))).alias("parent"), F.col("source").alias("document"))


@query(f"WITH {bm25_sql()}, {CHUNKS}, a AS (SELECT query, rank, unnest([0, 1, 2]) AS turn, unnest([id::VARCHAR, parent, document]) AS anchor FROM lex JOIN ck USING (id)), f AS (SELECT query, anchor, min(rank * 3 + turn) AS f FROM a WHERE anchor <> '' GROUP BY ALL) SELECT query, anchor, row_number() OVER (PARTITION BY query ORDER BY f) AS place FROM f")
def anchors_for(spark, sf_dir):
    return search.anchors(lexical(spark, sf_dir), chunks(spark, sf_dir))


@query(f"WITH {CHUNKS}, n AS (SELECT unnest(['P1', 'P2', '5', '9', 'P19']) AS node) SELECT DISTINCT node, id FROM n JOIN ck ON node = id::VARCHAR OR node = parent OR node = document")
def node_to_chunks(spark, sf_dir):
    """Chunks by their own id, their parent or their document, without a nested loop."""
    nodes = spark.createDataFrame([(x,) for x in ("P1", "P2", "5", "9", "P19")], "node string")
    return search.chunks_of(nodes, chunks(spark, sf_dir)).select("node", "id").distinct()


@query("SELECT item_id AS id, text || CASE WHEN item_id % 3 = 0 THEN ' procurement threshold' ELSE '' END AS text FROM benchmark")
def query_expansion(spark, sf_dir):
    """Terms of a cache, for the third of the queries that it knows."""
    b = read(spark, sf_dir, "benchmark")
    cache = b.where("item_id % 3 = 0").select(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 24).alias("key"), F.lit("procurement threshold").alias("terms")).distinct()
    return search.expanded(b.select(F.col("item_id").alias("id"), "text"), cache)


@query(f"WITH {bm25_sql()}, l AS (SELECT query, id, score, id % 2 AS lane, rank FROM lex QUALIFY row_number() OVER (PARTITION BY query, id % 2 ORDER BY rank) <= 3) SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM l")
def lane_merge_by_score(spark, sf_dir):
    laned = retrieve.lanes(lexical(spark, sf_dir), (F.col("id") % 2).cast("string"), 3)
    return search.merged_lanes(laned).select("query", "id", "rank")

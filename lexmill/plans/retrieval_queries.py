"""Retrieval, chunking, graph and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.registry import query
from lexmill.functions import stem
from lexmill.functions import text as T
from lexmill.operators import chunking, evaluate, graph, retrieve, vectors
from lexmill.operators import lexical as lexical_blocks
from lexmill.plans.checkpoint import Workspace
from lexmill.plans import stem_sql
from lexmill.plans.layout import spread, together
from lexmill.plans.text_queries import LINES, lines, read

TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def bm25_sql(first: str = "text", weighted: str = "") -> str:
    """SQL of the ten best; ``weighted`` adds the terms of another field with a weight."""
    return rf"""
t AS (SELECT doc_id AS id, unnest({TERMS}) AS term, 1.0::DOUBLE AS w FROM documents {weighted}),
p AS MATERIALIZED (SELECT id, term, sum(w) AS tf FROM t GROUP BY ALL),
dl AS (SELECT id, sum(tf) AS dl FROM p GROUP BY id), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id AS query, unnest(list_distinct({TERMS})) AS term FROM benchmark),
s AS (SELECT query, id, round(sum(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avg(dl) FROM dl)))), 6) AS score
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN dl USING (id) GROUP BY query, id),
lex AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10)"""


def lexical(spark, sf_dir, fields=None, k=10):
    b, d = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    return retrieve.bm25(b, d, "item_id", T.words(F.col("text")), "doc_id", fields or {"text": 1.0}, k)


@query(f"WITH {bm25_sql()} SELECT query, id, score, rank FROM lex")
def bm25_top10(spark, sf_dir):
    return lexical(spark, sf_dir).select("query", "id", "score", "rank")


@query(f"WITH {bm25_sql(weighted=' UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(source), chr(91) || chr(92) || chr(112) || chr(123) || chr(76) || chr(125) || chr(92) || chr(112) || chr(123) || chr(78) || chr(125) || chr(95) || chr(93) || chr(43))), 2.0::DOUBLE FROM documents')} SELECT query, id, score, rank FROM lex")
def bm25_weighted_fields(spark, sf_dir):
    return lexical(spark, sf_dir, {"text": 1.0, "source": 2.0}).select("query", "id", "score", "rank")


DENSE = """
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
n AS MATERIALIZED (SELECT q.id AS query, v.id, round(list_dot_product(v.v, q.v) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(q.v, q.v))), 5) AS score, q.label AS ql, v.label FROM v, v q WHERE q.id % 25 = 0 AND q.id <> v.id),
den AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM n QUALIFY rank <= 10)"""


def dense(spark, sf_dir, k=10):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieve.nearest(v.where("id % 25 = 0").select(F.col("id").alias("query"), "vector"), v, k)


@query(f"WITH {DENSE} SELECT query, id, score, rank FROM den")
def dense_top10(spark, sf_dir):
    return dense(spark, sf_dir)


@query(f"WITH {DENSE} SELECT query, round(avg(CASE WHEN ql = label THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall FROM den GROUP BY query")
def dense_label_recall(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    d = dense(spark, sf_dir).join(e.select(F.col("vec_id").alias("id"), "label"), "id").join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query")
    return d.groupBy("query").agg(F.round(F.avg((F.col("ql") == F.col("label")).cast("double")), 6).alias("recall"))


# a second channel: documents by the number of distinct query words, of those with three at least
OVERLAP = """
dw AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS term FROM documents),
o AS (SELECT query, id, count(*)::DOUBLE AS score FROM q JOIN dw USING (term) GROUP BY query, id HAVING count(*) >= 3),
ovl AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM o QUALIFY rank <= 10),
u AS (SELECT query, id, rank, 'lexical' AS c FROM lex UNION ALL SELECT query, id, rank, 'overlap' FROM ovl),
g AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(c, '+' ORDER BY c) AS channels FROM u GROUP BY query, id),
fused AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM g)"""


def channels(spark, sf_dir, alias=False):
    """The lexical and the overlap ranking, from one written table of the best of each block."""
    b, d, ws = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), Workspace(spark, "channels")
    text = T.with_aliases(F.col("text")) if alias else F.col("text")
    asked = b.select(F.col("item_id").alias("query"), F.explode(F.array_distinct(T.words(text))).alias("term"))
    m = ws.table(retrieve.best(asked, retrieve.postings(d, "doc_id", {"text": 1.0}, asked, ws), 10, least=3), "best")
    lex, ovl = (retrieve.ranked(m.where(F.col("ranking") == r).drop("ranking"), "score").where("rank <= 10") for r in ("score", "terms"))
    return {"lexical": lex, "overlap": ovl}


def fused(spark, sf_dir):
    return retrieve.fuse(channels(spark, sf_dir))


@query(f"WITH {bm25_sql()}, {OVERLAP} SELECT query, id, score, channels, rank FROM fused")
def rrf_hybrid(spark, sf_dir):
    return fused(spark, sf_dir)


LABELLED = "case_ AS (SELECT *, CASE id % 4 WHEN 0 THEN 'PRIMARY_LEGISLATION' WHEN 1 THEN 'OFFICIAL_TRAINING' WHEN 2 THEN 'INDUSTRY_PRACTICE' ELSE 'OTHER' END AS authority FROM fused)"


def labelled(spark, sf_dir):
    m = F.col("id") % 4
    return fused(spark, sf_dir).withColumn("authority", F.when(m == 0, "PRIMARY_LEGISLATION").when(m == 1, "OFFICIAL_TRAINING").when(m == 2, "INDUSTRY_PRACTICE").otherwise("OTHER"))


@query(
    f"""WITH {bm25_sql()}, {OVERLAP}, {LABELLED}, w AS (SELECT query, id, round(score * CASE authority WHEN 'PRIMARY_LEGISLATION' THEN 1.0::DOUBLE WHEN 'OFFICIAL_TRAINING' THEN 0.74::DOUBLE WHEN 'INDUSTRY_PRACTICE' THEN 0.55::DOUBLE ELSE 0.6::DOUBLE END
  * CASE id % 5 WHEN 0 THEN 1.6::DOUBLE WHEN 1 THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN id % 7 = 0 THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score FROM case_)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM w"""
)
def rrf_with_priors(spark, sf_dir):
    h = labelled(spark, sf_dir).withColumn("regime", F.when(F.col("id") % 5 == 0, "PA2023").when(F.col("id") % 5 == 1, "PCR2015")).withColumn("jurisdiction", F.when(F.col("id") % 7 == 0, "EU"))
    return retrieve.with_priors(h, F.lit("current_query")).select("query", "id", "score", "rank")


@query(f"WITH {bm25_sql()}, {OVERLAP}, {LABELLED}, l AS (SELECT query, id, CASE WHEN authority = 'PRIMARY_LEGISLATION' THEN 'law' ELSE 'other' END AS lane, rank FROM case_), r AS (SELECT query, id, lane, row_number() OVER (PARTITION BY query, lane ORDER BY rank) AS lane_rank FROM l QUALIFY lane_rank <= 3) SELECT *, row_number() OVER (PARTITION BY query ORDER BY lane_rank, lane, id) AS rank FROM r")
def two_lane(spark, sf_dir):
    h = retrieve.lanes(labelled(spark, sf_dir), F.when(F.col("authority") == "PRIMARY_LEGISLATION", "law").otherwise("other"), 3)
    return retrieve.interleave(h, "law").select("query", "id", "lane", "lane_rank", "rank")


@query(
    f"""WITH {bm25_sql()}, {OVERLAP}, {LABELLED}, b AS (SELECT *, min(CASE WHEN authority = 'PRIMARY_LEGISLATION' THEN rank END) OVER (PARTITION BY query) AS best FROM case_)
SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN best > 3 AND rank = best THEN 0 ELSE rank END) AS rank FROM b"""
)
def lane_promotion(spark, sf_dir):
    return retrieve.promote(labelled(spark, sf_dir), F.col("authority") == "PRIMARY_LEGISLATION").select("query", "id", "rank")


# chunks
@query(f"WITH {LINES} SELECT doc_id, pos, ceil(row_number() OVER (PARTITION BY doc_id ORDER BY pos) / 4.0)::BIGINT AS chunk FROM l")
def fixed_block_windows(spark, sf_dir):
    return chunking.windows(lines(spark, sf_dir), "doc_id", "pos", 4).select("doc_id", "pos", "chunk")


@query(
    f"""WITH RECURSIVE {LINES}, r AS (SELECT doc_id, pos, 0::BIGINT AS grp, length(text)::BIGINT AS acc FROM l WHERE pos = 0
UNION ALL SELECT l.doc_id, l.pos, r.grp + CASE WHEN r.acc >= 800 THEN 1 ELSE 0 END, CASE WHEN r.acc >= 800 THEN 0 ELSE r.acc END + length(l.text) FROM r JOIN l ON l.doc_id = r.doc_id AND l.pos = r.pos + 1) SELECT doc_id, pos, grp FROM r"""
)
def deterministic_split(spark, sf_dir):
    docs = chunking.ordered(lines(spark, sf_dir), "doc_id", "pos", "text")
    return chunking.close_after(docs, "doc_id", lambda b: F.length(b["text"]).cast("long"), 800)


@query(
    f"""WITH RECURSIVE {LINES}, h AS (SELECT *, length(text)::BIGINT AS n, length(text) < 60 AND NOT contains(text, '.') AS head FROM l), r AS (SELECT doc_id, pos, 0::BIGINT AS grp, n AS acc FROM h WHERE pos = 0
UNION ALL SELECT h.doc_id, h.pos, r.grp + CASE WHEN r.acc > 0 AND (r.acc + n > 900 OR (head AND r.acc * 3 >= 900)) THEN 1 ELSE 0 END, CASE WHEN r.acc > 0 AND (r.acc + n > 900 OR (head AND r.acc * 3 >= 900)) THEN n ELSE r.acc + n END FROM r JOIN h ON h.doc_id = r.doc_id AND h.pos = r.pos + 1) SELECT doc_id, pos, grp FROM r"""
)
def greedy_char_groups(spark, sf_dir):
    docs = chunking.ordered(lines(spark, sf_dir), "doc_id", "pos", "text")
    heading = lambda b: (F.length(b["text"]) < 60) & ~F.contains(b["text"], F.lit("."))
    return chunking.close_before(docs, "doc_id", lambda b: F.length(b["text"]).cast("long"), 900, heading)


@query(f"WITH {LINES}, b AS (SELECT *, lag(regexp_matches(text, '[.!?]$')) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM l) SELECT doc_id, pos, sum(CASE WHEN coalesce(e, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS island FROM b")
def paragraph_islands(spark, sf_dir):
    ended = F.lag(F.regexp_like("text", F.lit("[.!?]$"))).over(W.partitionBy("doc_id").orderBy("pos"))
    return chunking.islands(lines(spark, sf_dir).withColumn("new", F.coalesce(ended, F.lit(True))), "doc_id", "pos", F.col("new")).select("doc_id", "pos", "island")


@query(f"WITH {LINES}, c AS (SELECT doc_id, 1 AS lo, 3 AS hi FROM documents) SELECT c.doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM c JOIN l ON l.doc_id = c.doc_id AND pos BETWEEN lo AND hi GROUP BY 1")
def block_range_join(spark, sf_dir):
    c = read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("lo"), F.lit(3).alias("hi"))
    return chunking.range_join(c, lines(spark, sf_dir), "doc_id", "lo", "hi", "pos").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(rf"WITH {LINES}, s AS (SELECT doc_id, pos, NOT regexp_matches(rtrim(text), '[.!?:;,\x22'')\]]$') AND coalesce(regexp_matches(trim(lead(text) OVER (PARTITION BY doc_id ORDER BY pos)), '^\p{{Ll}}'), false) AS s FROM l) SELECT doc_id, pos FROM s WHERE s")
def lead_severed_sentence(spark, sf_dir):
    return chunking.severed(lines(spark, sf_dir), "doc_id", "pos").where("severed").select("doc_id", "pos")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)")
def ordinal_continuity(spark, sf_dir):
    return chunking.not_continuous(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    rf"""WITH {LINES}, a AS (SELECT *, trim(text) AS t, trim(lead(text) OVER (PARTITION BY doc_id ORDER BY pos)) AS nx FROM l),
d AS (SELECT unnest([CASE WHEN t = '' THEN 'EMPTY_TEXT' END, CASE WHEN t <> '' AND NOT regexp_matches(t, '[.!?:;,\x22'')\]]$') AND coalesce(regexp_matches(nx, '^\p{{Ll}}'), false) THEN 'SEVERED_SENTENCE' END, CASE WHEN regexp_matches(t, '\b(or|and|unless)\W*$') THEN 'SEVERED_ENUMERATION' END,
  CASE WHEN t LIKE '%:' THEN 'SEVERED_LIST_STEM' END, CASE WHEN regexp_matches(t, '^(\([a-z0-9]{{1,4}}\)|[-*•])\s') AND pos > 0 THEN 'ORPHAN_LIST_ITEM' END, CASE WHEN t <> '' AND greatest(1, length(t) // 4) < 15 THEN 'TOO_SMALL_TO_RETRIEVE' END]) AS defect FROM a)
SELECT defect, count(*) AS n FROM d WHERE defect IS NOT NULL GROUP BY 1"""
)
def chunk_defects(spark, sf_dir):
    after = F.lead("text").over(W.partitionBy("doc_id").orderBy("pos"))
    d = lines(spark, sf_dir).withColumn("after", after).select(F.explode(chunking.defects(F.col("text"), F.col("after"), F.lit("t"), F.col("pos") + 1)).alias("defect"))
    return d.groupBy("defect").agg(F.count("*").alias("n"))


# graph
def trade(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target"))
    return e.agg(F.round(F.avg("l_discount"), 6).alias("confidence"))


TRADE = "e AS MATERIALIZED (SELECT 'P' || l_partkey AS source, 'S' || l_suppkey AS target, round(avg(l_discount), 6) AS confidence FROM lineitem GROUP BY 1, 2)"
BOTH = "b AS MATERIALIZED (SELECT source, target, confidence FROM e UNION ALL SELECT target, source, confidence FROM e)"
SEEDS = "f0 AS (SELECT 'q' || s_suppkey AS query, 'S' || s_suppkey AS node FROM supplier)"


def hop_sql(k, n, seen):
    return f"h{k} AS (SELECT f.query, b.target AS node, max(b.confidence) AS confidence FROM {seen} f JOIN b ON f.node = b.source GROUP BY ALL), f{k} AS MATERIALIZED (SELECT h.*, row_number() OVER (PARTITION BY h.query ORDER BY h.confidence DESC, h.node) AS r FROM h{k} h ANTI JOIN {seen} s ON s.query = h.query AND s.node = h.node QUALIFY r <= {n})"


def seeds(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("query"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"))


@query(f"WITH {TRADE}, {BOTH}, {SEEDS}, {hop_sql(1, 5, 'f0')} SELECT query, node, confidence, r FROM f1")
def expand_one_hop(spark, sf_dir):
    return graph.expand(seeds(spark, sf_dir), graph.both_ways(trade(spark, sf_dir)), 5).select("query", "node", "confidence", F.col("r").cast("long").alias("r"))


@query(f"WITH {TRADE}, {BOTH}, {SEEDS}, {hop_sql(1, 5, 'f0')}, s1 AS (SELECT query, node FROM f0 UNION ALL SELECT query, node FROM f1), {hop_sql(2, 8, 's1')} SELECT query, node, confidence, r FROM f2")
def expand_two_hop(spark, sf_dir):
    e, f = graph.both_ways(trade(spark, sf_dir)), seeds(spark, sf_dir)
    f = together([f, graph.expand(f, e, 5).select("query", "node")])
    return graph.expand(f, e, 8).select("query", "node", "confidence", F.col("r").cast("long").alias("r"))


@query(f"WITH {TRADE}, {BOTH} SELECT source, target, r FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, target) AS r FROM b) WHERE r <= 2")
def bidirectional_fanout(spark, sf_dir):
    b = graph.both_ways(trade(spark, sf_dir))
    return retrieve.pick(b, ["source"], F.desc("confidence"), F.col("target"), n=2).withColumn("r", F.row_number().over(W.partitionBy("source").orderBy(F.desc("confidence"), "target")).cast("long")).select("source", "target", "r")


@query(f"WITH {TRADE}, {BOTH}, d AS (SELECT source AS node, count(*) AS n FROM b GROUP BY 1) SELECT n AS degree, count(*) AS nodes FROM d GROUP BY 1")
def degree_distribution(spark, sf_dir):
    return graph.degrees(trade(spark, sf_dir)).groupBy("degree").agg(F.count("*").alias("nodes"))


@query(f"WITH {TRADE}, {BOTH}, d AS (SELECT source AS node, count(*) AS n FROM b GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, node) AS r, count(*) OVER () AS all_ FROM d) SELECT round(sum(CASE WHEN r <= greatest(1, floor(0.01::DOUBLE * all_)) THEN n END) / sum(n), 6)::DOUBLE AS share FROM r")
def hub_share(spark, sf_dir):
    """Share of edge ends at the top hundredth of the nodes; the cut is found on counts of degrees, not by ranking nodes in one task."""
    d = graph.degrees(trade(spark, sf_dir)).groupBy("degree").agg(F.count("*").alias("nodes"))
    w = W.orderBy(F.desc("degree"))
    c = d.withColumn("before", F.sum("nodes").over(w) - F.col("nodes")).withColumn("top", F.greatest(F.lit(1), F.floor(0.01 * F.sum("nodes").over(W.partitionBy()))))
    inside = F.greatest(F.lit(0), F.least(F.col("nodes"), F.col("top") - F.col("before")))
    return c.agg(F.round(F.sum(inside * F.col("degree")) / F.sum(F.col("nodes") * F.col("degree")), 6).alias("share"))


@query("SELECT n.n_name AS from_nation, s.n_name AS to_nation, count(*) AS n FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON n.n_nationkey = c_nationkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation s ON s.n_nationkey = s_nationkey GROUP BY 1, 2")
def authority_flow(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    c = read(spark, sf_dir, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("from_nation")), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "from_nation")
    s = read(spark, sf_dir, "supplier").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("to_nation")), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "to_nation")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey")
    x = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(o, "o_orderkey").join(s, "l_suppkey")
    return x.groupBy("from_nation", "to_nation").agg(F.count("*").alias("n"))


@query()
def connected_components(spark, sf_dir):
    """Components of the graph of parts and suppliers; the recursive SQL is too slow on its giant component, so a test has brute force."""
    e = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")).distinct()
    return graph.connected_components(e, Workspace(spark, "components"))


@query(
    """WITH k AS (SELECT o_orderkey, 'A-' || (o_orderkey % 7) || '-' || (o_orderkey % 5) || '-' || o_orderkey AS key FROM orders),
n AS (SELECT 'A-' || i AS node FROM range(5) t(i) UNION ALL SELECT 'A-' || i || '-2' FROM range(4) t(i)),
m AS (SELECT key, max(struct_pack(d := length(node), node := node)) AS m FROM k JOIN n ON key = node OR starts_with(key, node || '-') GROUP BY key) SELECT k.key, m.m.node AS found FROM k LEFT JOIN m USING (key)""",
)
def longest_prefix_lookup(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    text = lambda c: c.cast("string")
    k = o.select(F.concat_ws("-", F.lit("A"), text(F.col("o_orderkey") % 7), text(F.col("o_orderkey") % 5), text(F.col("o_orderkey"))).alias("key"))
    n = spark.createDataFrame([(f"A-{i}",) for i in range(5)] + [(f"A-{i}-2",) for i in range(4)], "node string")
    return graph.longest_prefix(k, "key", n)


# evaluation: a document's grade for a query is 3, 2, 1 or 0 by a fixed rule over its lexical ranking
QRELS = "qrels AS (SELECT query, id, ((query * 7 + id * 3) % 4)::INT AS grade FROM lex WHERE (query + id) % 5 <> 0)"


def judged(spark, sf_dir):
    r = Workspace(spark, "ranking").table(lexical(spark, sf_dir), "lexical")
    return r, r.where("(query + id) % 5 <> 0").select("query", "id", ((F.col("query") * 7 + F.col("id") * 3) % 4).cast("int").alias("grade"))


def ndcg_sql(ideal, otherwise):
    return f"""WITH {bm25_sql()}, {QRELS}, r AS (SELECT query, rank, coalesce(grade, 0) AS grade FROM lex LEFT JOIN qrels USING (query, id) WHERE rank <= 5),
d AS (SELECT query, sum((pow(2.0, grade) - 1) / log2(rank + 1)) AS dcg FROM r GROUP BY 1), i AS (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC) AS i FROM {ideal}),
b AS (SELECT query, sum((pow(2.0, grade) - 1) / log2(i + 1)) AS best FROM i WHERE i <= 5 GROUP BY 1) SELECT query, round(CASE WHEN best > 0 THEN coalesce(dcg, 0) / best ELSE {otherwise} END, 6) AS ndcg FROM b LEFT JOIN d USING (query)"""


@query(ndcg_sql("qrels", "NULL"))
def ndcg_pooled(spark, sf_dir):
    return evaluate.ndcg(*judged(spark, sf_dir), 5, True)


@query(ndcg_sql("r", "0"))
def ndcg_self(spark, sf_dir):
    return evaluate.ndcg(*judged(spark, sf_dir), 5, False)


@query(f"WITH {bm25_sql()}, {QRELS} SELECT query, min(CASE WHEN grade >= 2 THEN rank END) AS first_rank, round(coalesce(1.0::DOUBLE / min(CASE WHEN grade >= 2 THEN rank END), 0), 6) AS rr FROM lex LEFT JOIN qrels USING (query, id) GROUP BY query")
def mrr_first_sufficient(spark, sf_dir):
    return evaluate.first_hit(*judged(spark, sf_dir), 2)


@query(f"WITH {bm25_sql()}, {QRELS}, g AS (SELECT query, query % 3 AS suite, max(CASE WHEN grade = 3 AND rank <= 5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS h FROM lex LEFT JOIN qrels USING (query, id) GROUP BY 1, 2) SELECT suite, count(*) AS n, round(avg(h), 6) AS recall FROM g GROUP BY GROUPING SETS ((suite), ())")
def strict_recall_by_suite(spark, sf_dir):
    r, q = judged(spark, sf_dir)
    g = r.join(q, ["query", "id"], "left").groupBy("query", (F.col("query") % 3).alias("suite")).agg(F.max(((F.coalesce("grade", F.lit(0)) == 3) & (F.col("rank") <= 5)).cast("double")).alias("h"))
    return g.groupingSets([["suite"], []], "suite").agg(F.count("*").alias("n"), F.round(F.avg("h"), 6).alias("recall"))


@query(f"WITH {bm25_sql()}, {QRELS} SELECT CASE WHEN rank <= 3 THEN 'OK' WHEN rank <= 10 THEN 'RANKING_PROBLEM' WHEN d.doc_id IS NOT NULL THEN 'GENERATION_PROBLEM' ELSE 'NOT_IN_CORPUS' END AS diagnosis, count(*) AS n FROM (SELECT item_id AS query, item_id * 13 % 1100 AS id FROM benchmark UNION ALL SELECT query, id FROM qrels WHERE grade = 3) t LEFT JOIN lex USING (query, id) LEFT JOIN documents d ON d.doc_id = t.id GROUP BY 1")
def candidate_ceiling(spark, sf_dir):
    r, q = judged(spark, sf_dir)
    t = together([read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), (F.col("item_id") * 13 % 1100).alias("id")), q.where("grade = 3").select("query", "id")])
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(True).alias("held"))
    x = t.join(r.select("query", "id", "rank"), ["query", "id"], "left").join(d, "id", "left")
    at = F.coalesce("rank", F.lit(99))
    return x.groupBy(evaluate.diagnosis(at <= 3, at <= 10, F.coalesce("held", F.lit(False))).alias("diagnosis")).agg(F.count("*").alias("n"))


RATINGS = "r AS (SELECT user_id AS item, event_type AS judge, (min(event_id) % 4)::INT AS grade FROM events GROUP BY 1, 2)"


def ratings(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item"), F.col("event_type").alias("judge")).agg((F.min("event_id") % 4).cast("int").alias("grade"))


@query(
    f"""WITH {RATINGS}, p AS (SELECT x.judge AS a, y.judge AS b, x.grade AS ga, y.grade AS gb FROM r x JOIN r y ON x.item = y.item AND x.judge < y.judge),
o AS (SELECT a, b, count(*) AS n, avg(CASE WHEN ga = gb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS exact, avg(pow((ga - gb) / 3.0::DOUBLE, 2)) AS observed FROM p GROUP BY 1, 2),
ma AS (SELECT a, b, ga, count(*) AS n FROM p GROUP BY ALL), mb AS (SELECT a, b, gb, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT ma.a, ma.b, sum(pow((ga - gb) / 3.0::DOUBLE, 2) * ma.n * mb.n) AS chance FROM ma JOIN mb ON ma.a = mb.a AND ma.b = mb.b GROUP BY 1, 2)
SELECT o.a, o.b, n, round(exact, 6) AS exact, round(CASE WHEN chance > 0 THEN 1 - observed * n * n / chance END, 6) AS kappa FROM o JOIN c ON o.a = c.a AND o.b = c.b"""
)
def judge_kappa(spark, sf_dir):
    return evaluate.kappa(ratings(spark, sf_dir), 3)


@query(f"WITH {RATINGS} SELECT item, CASE WHEN max(grade) - min(grade) <= 1 THEN 'AGREED' ELSE 'REQUIRES_ADJUDICATION' END AS status, CASE WHEN max(grade) - min(grade) <= 1 THEN median(grade)::DOUBLE END AS grade FROM r WHERE judge IN (SELECT DISTINCT judge FROM r ORDER BY 1 LIMIT 3) GROUP BY item HAVING count(*) = 3")
def three_judge_consensus(spark, sf_dir):
    r = ratings(spark, sf_dir)
    return evaluate.consensus(r.join(F.broadcast(r.select("judge").distinct().orderBy("judge").limit(3)), "judge", "left_semi"))


@query(
    """WITH d AS (SELECT x.event_type AS pair, x.user_id, avg(x.value) - 20 AS delta FROM events x GROUP BY 1, 2), g AS (SELECT pair, sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END)::BIGINT AS wins, sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END)::BIGINT AS losses FROM d GROUP BY 1)
SELECT pair, wins, losses, round(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2.0::DOUBLE))) FROM range(0, least(wins, losses) + 1) t(i))), 6) AS p FROM g""",
)
def paired_sign_test(spark, sf_dir):
    d = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("pair"), "user_id").agg((F.avg("value") - 20).alias("delta"))
    return evaluate.sign_test(d)


@query(
    """WITH d AS (SELECT user_id AS i, round(avg(value), 6) AS delta, row_number() OVER (ORDER BY user_id) - 1 AS place FROM events GROUP BY 1), n AS (SELECT count(*) AS n FROM d),
s AS (SELECT r.i AS replicate, ('0x' || substr(sha256('b37|' || r.i || '|' || t.i), 1, 8))::BIGINT % n AS place FROM n, range(200) r(i), range((SELECT count(*) FROM d)) t(i)), m AS (SELECT replicate, avg(delta) AS m FROM s JOIN d USING (place) GROUP BY 1)
SELECT (SELECT round(avg(delta), 6) FROM d) AS mean, (SELECT count(*) FROM d) AS n, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""",
)
def bootstrap_ci(spark, sf_dir):
    d = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("i")).agg(F.round(F.avg("value"), 6).alias("delta"))
    return evaluate.bootstrap(d, 200, "b37")


@query(
    r"""WITH c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z\-]{3,}')) AS w FROM conversations WHERE role = 'assistant'), u AS (SELECT conv_id, turn + 1 AS turn, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z\-]{3,}')) AS e FROM conversations WHERE role = 'user'),
s AS (SELECT string_split('"""
    + " ".join(T.STOPWORDS)
    + """', ' ') AS s), x AS (SELECT conv_id, turn, list_filter(w, lambda y: NOT list_contains(s, y)) AS w, list_filter(e, lambda y: NOT list_contains(s, y)) AS e FROM c JOIN u USING (conv_id, turn), s)
SELECT conv_id, turn, round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, e)) / len(w) ELSE 0 END, 3) AS overlap, CASE WHEN len(w) > 0 THEN len(list_intersect(w, e)) / len(w) ELSE 0 END >= 0.05 AS grounded FROM x"""
)
def claim_grounding(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    e = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), T.content_words(F.col("text"), 4).alias("e"))
    x = c.where("role = 'assistant'").select("conv_id", "turn", T.content_words(F.col("text"), 4).alias("w")).join(e, ["conv_id", "turn"])
    share = T.containment(F.col("w"), F.col("e"))
    return x.select("conv_id", "turn", F.round(share, 3).alias("overlap"), (share >= 0.05).alias("grounded"))


# a stored index of vectors
HUNDREDTH = DENSE.replace("q.id % 25", "q.id % 100")


def vector_index(spark, sf_dir):
    """The path of an index of all embeddings, and the query set."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    path = Workspace(spark, "vector-index").path("index")
    vectors.write_index(v, path)
    return path, v.where("id % 100 = 0").select(F.col("id").alias("query"), "vector")


@query(f"WITH {HUNDREDTH} SELECT query, id, score, rank FROM den")
def dense_index_all_cells(spark, sf_dir):
    """Every cell probed, so the neighbours are exact."""
    path, asked = vector_index(spark, sf_dir)
    return vectors.search_index(asked, path, 10, probes=0)


@query()
def dense_index_top10(spark, sf_dir):
    """The cells that the index itself was tuned to probe."""
    path, asked = vector_index(spark, sf_dir)
    return vectors.search_index(asked, path, 10)


@query()
def dense_index_recall(spark, sf_dir):
    """Share of each query's exact neighbours that the index finds."""
    path, asked = vector_index(spark, sf_dir)
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.recall(vectors.search_index(asked, path, 10), retrieve.nearest(asked, v, 10))


# a stored lexical index in blocks
def lexical_index(spark, sf_dir, stemmed):
    path = Workspace(spark, "lexical-index").path("index")
    lexical_blocks.write_index(read(spark, sf_dir, "documents"), "doc_id", {"text": 1.0}, path, stemmed)
    return path


def stemmed_sql() -> str:
    """``bm25_sql`` over stems: terms of documents and queries are replaced by those of a stem table."""
    base = bm25_sql().replace("t AS (", "raw AS MATERIALIZED (", 1).replace("q AS (", "asked AS MATERIALIZED (", 1)
    head, tail = base.split("p AS MATERIALIZED", 1)
    asked = tail[tail.index("asked AS") : tail.index("s AS (SELECT query")]
    rest = "p AS MATERIALIZED" + tail.replace(asked, "")
    tables = f"""known AS MATERIALIZED (SELECT * FROM {stem_sql.with_stem("(SELECT term FROM raw UNION SELECT term FROM asked)")}), t AS (SELECT id, stem AS term, w FROM raw JOIN known USING (term)),
q AS (SELECT DISTINCT query, stem AS term FROM asked JOIN known USING (term)),"""
    return head + asked + tables + rest


@query(f"WITH {bm25_sql()} SELECT query, id, score, rank FROM lex")
def bm25_blocks_top10(spark, sf_dir):
    """Blocks that can't reach the tenth score aren't read."""
    return lexical_blocks.search(read(spark, sf_dir, "benchmark"), lexical_index(spark, sf_dir, False), "item_id", T.words(F.col("text")), 10)


@query(f"WITH {stemmed_sql()} SELECT query, id, score, rank FROM lex")
def bm25_stemmed_top10(spark, sf_dir):
    return lexical_blocks.search(read(spark, sf_dir, "benchmark"), lexical_index(spark, sf_dir, True), "item_id", T.words(F.col("text")), 10)


@query()
def bm25_postings_read(spark, sf_dir):
    """Of the postings of each query's stems, those that its search reads."""
    return lexical_blocks.postings_read(read(spark, sf_dir, "benchmark"), lexical_index(spark, sf_dir, True), "item_id", T.words(F.col("text")), 10)


@query(f"SELECT term, stem FROM {stem_sql.with_stem('(SELECT DISTINCT unnest(' + TERMS + ') AS term FROM documents)')}")
def stem_table(spark, sf_dir):
    """Every word of the documents with its stem."""
    words = spread(read(spark, sf_dir, "documents").select("text")).select(F.explode(T.words(F.col("text"))).alias("term")).distinct()
    return stem.with_stem(words, "term")

"""Queries of metrics, audits, answers, pools and freezes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.registry import query
from lexmill.functions import text as T
from lexmill.operators import retrieve, scoring
from lexmill.plans.checkpoint import Workspace
from lexmill.plans.retrieval_queries import OVERLAP, bm25_sql, channels, lexical, ratings
from lexmill.plans.text_queries import read

# every lexical hit has a label by a fixed rule, and two requirements
JUDGED = """jl AS MATERIALIZED (SELECT query, id, rank, CASE id % 4 WHEN 0 THEN 'PRIMARY_LEGISLATION' WHEN 1 THEN 'OFFICIAL_TRAINING' WHEN 2 THEN 'INDUSTRY_PRACTICE' ELSE 'OTHER' END AS authority, ((query * 7 + id * 3) % 4)::INT AS grade,
  CASE id % 5 WHEN 0 THEN 'INAPPLICABLE' WHEN 1 THEN 'CONDITIONAL' WHEN 2 THEN 'UNKNOWN' ELSE 'APPLICABLE' END AS applicability FROM lex),
js AS (SELECT query, id, r AS requirement FROM jl, (SELECT unnest(['R1', 'R2']) AS r) WHERE (id + query + CASE r WHEN 'R1' THEN 0 ELSE 1 END) % 3 = 0),
jr AS (SELECT item_id AS query, unnest(['R1', 'R2']) AS requirement FROM benchmark),
jm AS (SELECT j.query, requirement, rank, CASE requirement WHEN 'R1' THEN authority IN ('PRIMARY_LEGISLATION', 'SECONDARY_LEGISLATION') ELSE authority IN ('PRIMARY_LEGISLATION', 'OFFICIAL_TRAINING') END AS ok FROM jl j JOIN js USING (query, id)
  WHERE rank <= 5 AND (applicability = 'APPLICABLE' OR applicability = 'CONDITIONAL' AND requirement = 'R2')),
jc AS (SELECT query, requirement, 1 AS content, max(ok::INT) AS strict, min(CASE WHEN ok THEN rank END) AS first FROM jm GROUP BY ALL),
jn AS (SELECT r.query, avg(coalesce(strict, 0)) AS req, avg(coalesce(content, 0)) AS con, min(first) AS first, avg(CASE WHEN requirement = 'R1' THEN coalesce(strict, 0) END) AS binding, avg(CASE WHEN requirement = 'R2' THEN coalesce(strict, 0) END) AS official FROM jr r LEFT JOIN jc USING (query, requirement) GROUP BY 1),
jt AS (SELECT query, count(*) AS returned, max((grade >= 2)::INT) AS hit, sum((grade >= 2)::INT) AS good, sum((pow(2.0, grade) - 1) / log2(rank + 1)) AS dcg, sum((applicability = 'INAPPLICABLE')::INT) AS wrong, sum((applicability = 'UNKNOWN')::INT) AS unk FROM jl WHERE rank <= 5 GROUP BY 1),
ji AS (SELECT query, sum((pow(2.0, grade) - 1) / log2(i + 1)) AS ideal FROM (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC) AS i FROM jl) WHERE i <= 5 GROUP BY 1),
met AS (SELECT query, coalesce(returned, 0)::BIGINT AS returned, round(req, 6) AS requirement_coverage, round(con, 6) AS content_coverage, (req = 1)::BIGINT AS scenario_complete, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr_first_sufficient, coalesce(hit, 0)::BIGINT AS hit_ge2,
  round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal END, 6) AS pooled_ndcg, round(coalesce(good, 0) / 5.0::DOUBLE, 6) AS precision_ge2_at_k, round(binding, 6) AS binding_requirement_coverage, round(official, 6) AS official_requirement_coverage,
  round(wrong / returned, 6) AS inapplicable_fraction_returned, round(unk / returned, 6) AS applicability_unknown_fraction FROM jn LEFT JOIN jt USING (query) LEFT JOIN ji USING (query))"""


def judged(spark, sf_dir):
    m, a = F.col("id") % 4, F.col("id") % 5
    r = Workspace(spark, "judged").table(lexical(spark, sf_dir), "lexical").withColumn("sha", F.sha2(F.col("id").cast("string"), 256))
    r = r.withColumn("authority", F.when(m == 0, "PRIMARY_LEGISLATION").when(m == 1, "OFFICIAL_TRAINING").when(m == 2, "INDUSTRY_PRACTICE").otherwise("OTHER"))
    labels = r.select("query", "id", "sha", ((F.col("query") * 7 + F.col("id") * 3) % 4).cast("int").alias("grade"), F.when(a == 0, "INAPPLICABLE").when(a == 1, "CONDITIONAL").when(a == 2, "UNKNOWN").otherwise("APPLICABLE").alias("applicability"), F.lit("HUMAN_REVIEWED").alias("status"))
    needs = F.explode(F.array(F.struct(F.lit("R1").alias("r"), F.lit(0).alias("k")), F.struct(F.lit("R2").alias("r"), F.lit(1).alias("k"))))
    supports = r.select("query", "id", needs.alias("x")).select("query", "id", F.col("x.r").alias("requirement"), F.when((F.col("id") + F.col("query") + F.col("x.k")) % 3 == 0, "FULL").otherwise("PARTIAL").alias("support"))
    spec = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), needs.alias("x")).select("query", F.col("x.r").alias("requirement"), F.when(F.col("x.k") == 0, "BINDING_REQUIRED").otherwise("OFFICIAL_ALLOWED").alias("policy"), F.lit(True).alias("mandatory"), (F.col("x.k") == 1).alias("allow_conditional"))
    return r, labels, supports, spec


@query(f"WITH {bm25_sql()}, {JUDGED} SELECT * FROM met")
def requirement_metrics(spark, sf_dir):
    """All metrics of each query's first five, with labels and requirements."""
    return scoring.evaluate_ranking(*judged(spark, sf_dir), k=5)


@query(f"WITH {bm25_sql()}, {JUDGED}, x AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS v FROM met" for m in scoring.METRICS) + ") SELECT metric, round(avg(v), 6) AS mean, count(v) AS n_defined FROM x GROUP BY 1")
def macro_metric_summary(spark, sf_dir):
    return scoring.macro_summary(scoring.evaluate_ranking(*judged(spark, sf_dir), k=5))


@query(f"WITH {bm25_sql()}, x AS (SELECT query, sum((id % 7 = 0)::INT)::BIGINT AS u, sum((id % 7 <> 0 AND id % 6 = 0)::INT)::BIGINT AS s, sum((id % 7 <> 0 AND id % 5 = 0)::INT)::BIGINT AS g FROM lex WHERE rank <= 5 GROUP BY 1) SELECT query, 'UNJUDGED' AS fault, u AS n FROM x WHERE u > 0 UNION ALL SELECT query, 'STALE_TEXT', s FROM x WHERE s > 0 UNION ALL SELECT query, 'INVALID_GRADE', g FROM x WHERE g > 0")
def ranking_audit(spark, sf_dir):
    """Faults of rankings whose labels lack rows, are of other texts, or have impossible grades."""
    r, labels, _, _ = judged(spark, sf_dir)
    labels = labels.where("id % 7 <> 0").withColumn("sha", F.when(F.col("id") % 6 == 0, "old").otherwise(F.col("sha"))).withColumn("grade", F.when(F.col("id") % 5 == 0, 9).otherwise(F.col("grade")))
    return scoring.ranking_faults(r, labels, 5)


CONFIGS = "cf AS (SELECT 'overlap' AS config, query, max(1.0::DOUBLE / rank) AS v FROM ovl WHERE id % 3 = 0 GROUP BY ALL UNION ALL SELECT 'lexical', query, max(1.0::DOUBLE / rank) FROM lex WHERE id % 3 = 0 GROUP BY ALL UNION ALL SELECT 'fused', query, max(1.0::DOUBLE / rank) FROM fused WHERE id % 3 = 0 GROUP BY ALL)"


@query(f"WITH {bm25_sql()}, {OVERLAP}, {CONFIGS}, d AS (SELECT x.config AS a, y.config AS b, round(y.v - x.v, 9) AS d FROM cf x JOIN cf y ON x.query = y.query AND x.config < y.config) SELECT a, b, count(*) AS n, round(avg(d), 6) AS delta, sum((d > 0)::INT)::BIGINT AS wins, sum((d < 0)::INT)::BIGINT AS losses FROM d GROUP BY 1, 2")
def config_pairwise(spark, sf_dir):
    """Reciprocal ranks of three configurations against one another."""
    own = channels(spark, sf_dir)
    ranked = {**own, "fused": retrieve.fuse(own)}
    scores = None
    for name, df in ranked.items():
        one = df.where("id % 3 = 0").groupBy("query").agg(F.max(1 / F.col("rank")).alias("value")).withColumn("config", F.lit(name))
        scores = one if scores is None else scores.unionByName(one)
    return scoring.paired(scores)


@query("""WITH x AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'GENERATION_PROBLEM' WHEN 1 THEN 'RANKING_PROBLEM' ELSE 'OK' END AS d FROM events)
SELECT CASE WHEN d = 'GENERATION_PROBLEM' THEN CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN 'MISSING_CORPUS_EVIDENCE' ELSE 'QUERY_UNDERSTANDING' END WHEN d = 'RANKING_PROBLEM' THEN 'RANKING_FAILURE' WHEN user_id % 6 = 0 THEN 'WRONG_REGIME' WHEN event_type = 'error' THEN 'VOCABULARY_MISMATCH'
  WHEN user_id % 2 = 0 AND event_id % 7 = 0 AND event_id % 9 <> 0 THEN 'GRAPH_SEED_FAILURE' ELSE 'OTHER' END AS category, count(*) AS n FROM x GROUP BY 1""")
def error_taxonomy(spark, sf_dir):
    e, c = read(spark, sf_dir, "events"), F.col
    d = F.when(c("event_id") % 4 == 0, "GENERATION_PROBLEM").when(c("event_id") % 4 == 1, "RANKING_PROBLEM").otherwise("OK")
    suite = F.when(c("event_type") == "error", "vocabulary_mismatch").otherwise("other")
    category = scoring.error_category(d, c("event_id") % 3 == 0, c("event_id") % 5 == 0, c("user_id") % 6 == 0, suite, c("user_id") % 2 == 0, c("event_id") % 7 == 0, c("event_id") % 9 == 0)
    return e.groupBy(category.alias("category")).agg(F.count("*").alias("n"))


# an answer is an assistant's turn whose sentences carry marks; its evidence are the conversation's user turns
ANSWERS = r"""an AS (SELECT conv_id * 1000 + turn AS answer, conv_id, regexp_replace(text, '([.!?])', ' [E' || (turn % 4 + 1) || ']\1', 'g') || ' "' || substr(text, 1, 20) || '" [E1].' AS text FROM conversations WHERE role = 'assistant'),
ev AS (SELECT conv_id, 'E' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, text FROM conversations WHERE role = 'user')"""


def answers(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer"), "conv_id", F.concat(F.expr(r"regexp_replace(text, '([.!?])', concat(' [E', cast(turn % 4 + 1 as string), ']$1'))"), F.lit(' "'), F.substring("text", 1, 20), F.lit('" [E1].')).alias("text"))
    e = c.where("role = 'user'").select("conv_id", F.concat(F.lit("E"), F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("string")).alias("id"), F.col("text").alias("own"))
    return a, a.select("answer", "conv_id").join(e, "conv_id").select("answer", "id", F.col("own").alias("text"))


@query(rf"""WITH {ANSWERS}, s AS (SELECT answer, conv_id, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]'), lambda x: trim(x)), lambda x: length(x) > 25) AS long, list_distinct(list_transform(regexp_extract_all(text, '\[E(\d+)\]', 1), lambda x: 'E' || x)) AS cited FROM an),
i AS (SELECT conv_id, list(id) AS ids FROM ev GROUP BY 1), x AS (SELECT s.*, coalesce(ids, []) AS ids, len(list_filter(long, lambda y: regexp_matches(y, '\[E(\d+)\]'))) AS w FROM s LEFT JOIN i USING (conv_id))
SELECT answer, len(ids)::BIGINT AS supplied, len(list_intersect(cited, ids))::BIGINT AS used, len(list_filter(cited, lambda y: NOT list_contains(ids, y)))::BIGINT AS invalid, len(long)::BIGINT AS sentences, w::BIGINT AS with_citation,
  round(CASE WHEN len(long) > 0 THEN w::DOUBLE / len(long) END, 3) AS citation_coverage, coalesce(w::DOUBLE / nullif(len(long), 0) >= 0.8, false) AS format_pass FROM x""")
def citation_verify(spark, sf_dir):
    """Marks of answers against the evidence supplied."""
    return scoring.verify(*answers(spark, sf_dir)).drop("bad_quotes", "citations_valid")


@query(r"""WITH c AS (SELECT conv_id * 1000 + turn AS answer, conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z\-]{2,}')) AS w FROM conversations WHERE role = 'assistant'), e AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z\-]{2,}')) AS e FROM conversations WHERE role = 'user'),
st AS (SELECT string_split('""" + " ".join(T.STOPWORDS) + r"""', ' ') AS s), x AS (SELECT answer, list_filter(w, lambda y: NOT list_contains(s, y)) AS w, list_filter(e, lambda y: NOT list_contains(s, y)) AS e FROM c LEFT JOIN e ON c.conv_id = e.conv_id AND e.turn < c.turn, st),
o AS (SELECT answer, max(CASE WHEN len(w) > 0 AND e IS NOT NULL THEN len(list_intersect(w, e)) / len(w) ELSE 0 END) AS overlap FROM x GROUP BY 1) SELECT answer, count(*) AS claims, sum((overlap >= 0.05)::INT)::BIGINT AS grounded, round(avg((overlap >= 0.05)::INT), 3) AS rate FROM o GROUP BY 1""")
def claim_grounding_rate(spark, sf_dir):
    """Whether each assistant's turn is supported by one of the user's turns before it."""
    c = read(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", F.col("turn").alias("at"), F.col("text").alias("own"))
    a = c.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer"), "conv_id", "turn", F.col("text").alias("statement"))
    e = a.join(u, "conv_id").where("at < turn").select("answer", F.col("at").cast("string").alias("id"), F.col("own").alias("text"))
    cites = e.groupBy("answer").agg(F.collect_set("id").alias("cites"))
    claims = a.join(cites, "answer", "left").select("answer", F.lit(1).alias("claim"), "statement", F.coalesce("cites", F.array().cast("array<string>")).alias("cites"))
    return scoring.grounding_rate(scoring.claim_support(claims, e, 0.05))


@query(f"WITH {bm25_sql()} SELECT query, sha256('[' || string_agg('\"' || id || '\"', ',' ORDER BY rank) || ']') AS hash FROM lex GROUP BY 1")
def bundle_hashes(spark, sf_dir):
    r = lexical(spark, sf_dir).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x"))
    return r.select("query", scoring.bundle_hash(F.transform("x", lambda y: y["id"])).alias("hash"))


@query(f"WITH {bm25_sql()}, {OVERLAP}, pu AS (SELECT query, id, 'lexical' AS s FROM lex WHERE rank <= 5 UNION ALL SELECT query, id, 'overlap' FROM ovl WHERE rank <= 5) SELECT query, id, sha256(id::VARCHAR) AS sha, string_agg(s, '+' ORDER BY s) AS systems FROM pu GROUP BY 1, 2")
def pooled_union(spark, sf_dir):
    runs = None
    for name, df in channels(spark, sf_dir).items():
        one = df.select("query", "id", "rank", F.lit(name).alias("system"), F.sha2(F.col("id").cast("string"), 256).alias("sha"))
        runs = one if runs is None else runs.unionByName(one)
    return scoring.pool(runs, 5)


@query("SELECT count(*) * 3 AS calls, (sum(length(text)) // 4)::BIGINT * 3 + count(*) * 3 * 900 AS input_tokens, count(*) * 3 * 200 AS output_tokens, round(((sum(length(text)) // 4) * 3 + count(*) * 3 * 900) * 0.5 / 1e6 + count(*) * 3 * 200 * 1.5 / 1e6, 6)::DOUBLE AS cost FROM documents")
def judging_cost_plan(spark, sf_dir):
    return scoring.judging_cost(read(spark, sf_dir, "documents"), "text", 3, 900, 0.5, 1.5, 200)


GRADED = "gd AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 4)::INT END AS grade, value / 40 AS confidence, CASE event_id % 6 WHEN 0 THEN 'MAYBE' ELSE 'APPLICABLE' END AS applicability, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE event_type END AS rationale FROM events)"


def graded(spark, sf_dir):
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    return e.select("event_id", F.when(k % 11 != 0, (k % 4).cast("int")).alias("grade"), (F.col("value") / 40).alias("confidence"), F.when(k % 6 == 0, "MAYBE").otherwise("APPLICABLE").alias("applicability"), F.when(k % 9 == 0, " ").otherwise(F.col("event_type")).alias("rationale"))


@query(f"WITH {GRADED} SELECT event_id, grade FROM gd WHERE grade = 3 OR confidence < 0.5 OR grade IS NULL")
def human_review_queue(spark, sf_dir):
    return scoring.review_queue(graded(spark, sf_dir)).select("event_id", "grade")


@query(f"WITH {GRADED}, v AS (SELECT event_id, unnest([CASE WHEN grade IS NULL OR grade NOT BETWEEN 0 AND 3 THEN 'GRADE' END, CASE WHEN confidence IS NULL OR confidence NOT BETWEEN 0 AND 1 THEN 'CONFIDENCE' END, CASE WHEN applicability = 'MAYBE' THEN 'APPLICABILITY' END, CASE WHEN trim(rationale) = '' THEN 'RATIONALE' END]) AS fault FROM gd) SELECT fault, count(*) AS n FROM v WHERE fault IS NOT NULL GROUP BY 1")
def judgment_violations(spark, sf_dir):
    return graded(spark, sf_dir).select(F.explode(scoring.judgment_faults()).alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


SPLIT = "sp AS (SELECT doc_id AS id, source AS grp, CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS p FROM documents)"


def split_rows(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("grp"), F.when(F.col("doc_id") % 2 == 0, "dev").otherwise("test").alias("split"), "text")


@query(f"WITH {SPLIT} SELECT a.id AS dev, b.id AS test FROM sp a JOIN sp b ON a.p = b.p AND a.split = 'dev' AND b.split = 'test'")
def normalized_cross_dups(spark, sf_dir):
    return scoring.split_audit(split_rows(spark, sf_dir))[1]


@query(f"WITH {SPLIT} SELECT grp FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1")
def groups_across_splits(spark, sf_dir):
    return scoring.split_audit(split_rows(spark, sf_dir))[0]


@query("WITH a AS (SELECT 'o' || o_orderkey AS path, sha256(o_orderstatus) AS s FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT 'o' || o_orderkey AS path, sha256(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderstatus END) AS s FROM orders WHERE o_orderkey % 7 <> 0) SELECT path, CASE WHEN b.s IS NULL THEN 'MISSING' WHEN a.s IS NULL THEN 'NEW' ELSE 'CHANGED' END AS change FROM a FULL JOIN b USING (path) WHERE a.s IS NULL OR b.s IS NULL OR a.s <> b.s")
def freeze_check(spark, sf_dir):
    """What changed between two manifests of orders."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderstatus").alias("s"))
    old = o.where("o_orderkey % 5 <> 0").select("path", F.sha2("s", 256).alias("sha256"))
    new = o.where("o_orderkey % 7 <> 0").select("path", F.sha2(F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("s")), 256).alias("sha256"))
    return scoring.changed_since(old, new)


@query("WITH r AS (SELECT user_id AS item, event_type AS judge, (min(event_id) % 4)::INT AS grade FROM events GROUP BY 1, 2) SELECT judge, count(*) AS n, round(avg(grade), 6) AS mean, round(avg((grade = 3)::INT), 6) AS top_share, grouping(judge)::BIGINT AS g FROM r GROUP BY GROUPING SETS ((judge), ())")
def judge_score_summary(spark, sf_dir):
    r = ratings(spark, sf_dir)
    return r.groupingSets([["judge"], []], "judge").agg(F.count("*").alias("n"), F.round(F.avg("grade"), 6).alias("mean"), F.round(F.avg((F.col("grade") == 3).cast("double")), 6).alias("top_share"), F.grouping_id().cast("long").alias("g"))

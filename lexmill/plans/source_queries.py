"""Queries over pages, citations, hierarchies and journals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.registry import query
from lexmill.operators import refs, tables
from lexmill.plans.text_queries import read
from lexmill.sources import html


@query()
def html_block_counts(spark, sf_dir):
    """Blocks of each kind in every page."""
    p = html.parse_pages(read(spark, sf_dir, "pages"))
    return p.select("page_id", F.explode("blocks").alias("b")).groupBy("page_id", "b.kind").agg(F.count("*").alias("n"), F.sum(F.length("b.text")).alias("chars"))


@query()
def heading_paths(spark, sf_dir):
    p = html.parse_pages(read(spark, sf_dir, "pages"))
    return p.select("page_id", "title", F.posexplode("blocks").alias("pos", "b")).select("page_id", "title", "pos", "b.level", "b.path").where("path <> ''")


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages) SELECT CASE WHEN regexp_matches(lower(h), '^(mailto|tel):') THEN 'CONTACT' WHEN regexp_matches(h, '^#') THEN 'FRAGMENT' WHEN regexp_matches(lower(h), '\.(pdf|docx?|xlsx?|pptx?)([?#]|$)') THEN 'DOCUMENT' WHEN regexp_matches(lower(h), 'legislation\.[a-z.]+/') THEN 'LEGISLATION' WHEN regexp_matches(lower(h), '^https?://') THEN 'EXTERNAL' ELSE 'INTERNAL' END AS class, count(*) AS n FROM h GROUP BY 1""")
def link_classify(spark, sf_dir):
    h = read(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h"))
    return h.groupBy(html.classify_link(F.col("h")).alias("class")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, length(html) AS chars FROM pages""")
def meta_extract(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.length("html").alias("chars"))


def cited(spark, sf_dir):
    d = read(spark, sf_dir, "orders")
    n, text = (F.col("o_orderkey") % 40).cast("string"), F.lit(" applies")
    k = F.col("o_orderkey") % 5
    tail = F.when(k == 0, " of the Procurement Act 2023").when(k == 1, " of the Freedom of Information Act 2000").otherwise(text)
    t = F.concat(F.lit("See section "), n, F.lit("(2)"), tail, F.lit("; also regulation "), n, F.lit(" here."))
    return d.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "UKPGA_2023_54").otherwise("UKSI_2024_692").alias("document"), t.alias("text"))


CITED = """c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'UKPGA_2023_54' ELSE 'UKSI_2024_692' END AS document, o_orderkey % 40 AS n, o_orderkey % 5 AS k FROM orders)"""


@query(f"WITH {CITED} SELECT o_orderkey, 0::BIGINT AS occurrence, 'section' AS unit, n || '(2)' AS locator FROM c UNION ALL SELECT o_orderkey, 1, 'regulation', n::VARCHAR FROM c")
def citation_extract(spark, sf_dir):
    return refs.citations(cited(spark, sf_dir), "o_orderkey").select("o_orderkey", "occurrence", "unit", "locator")


@query(
    f"""WITH {CITED}, r AS (SELECT document, 'section' AS unit, CASE WHEN k = 1 THEN 'TARGET_NOT_IN_CORPUS' WHEN n BETWEEN 1 AND 9 THEN CASE WHEN document = 'UKPGA_2023_54' THEN 'EXACT_INTERNAL' ELSE 'EXACT_CROSS_DOCUMENT' END WHEN n BETWEEN 10 AND 19 THEN 'NEAREST_ANCESTOR' ELSE 'DOCUMENT_ONLY' END AS status FROM c
UNION ALL SELECT document, 'regulation', CASE WHEN document = 'UKPGA_2023_54' THEN 'EXTERNAL_INSTRUMENT_REFERENCE' WHEN n BETWEEN 1 AND 19 THEN 'EXACT_INTERNAL' ELSE 'DOCUMENT_ONLY' END FROM c) SELECT document, unit, status, count(*) AS n FROM r GROUP BY ALL"""
)
def reference_status_pivot(spark, sf_dir):
    nodes = [f"UKPGA_2023_54__section-{i}" for i in range(1, 20)] + [f"UKPGA_2023_54__section-{i}-2" for i in range(1, 10)] + [f"UKSI_2024_692__regulation-{i}" for i in range(1, 20)]
    d = cited(spark, sf_dir)
    x = refs.citations(d, "o_orderkey").join(d.select("o_orderkey", "document"), "o_orderkey")
    return refs.resolve(x, spark.createDataFrame([(n,) for n in nodes], "node string")).groupBy("document", "unit", "status").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_type, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT p_name)), 1, 3), '; ') AS names FROM part ANTI JOIN customer ON p_partkey = c_custkey GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type LIMIT 20")
def missing_reference_ranking(spark, sf_dir):
    """The twenty most cited groups that aren't held, with their first three names; a part is held if a customer has its key."""
    held = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("p_partkey"))
    p = read(spark, sf_dir, "part").join(held, "p_partkey", "left_anti").groupBy("p_brand", "p_type")
    return p.agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("p_name")), 1, 3), "; ").alias("names")).orderBy(F.desc("n"), "p_brand", "p_type").limit(20)


@query("""SELECT r_name || '/' || n_name || '/' || lpad(c_custkey::VARCHAR, 8, '0') AS path, 3 AS depth FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT r_name || '/' || n_name, 2 FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 1 FROM region""")
def tree_preorder(spark, sf_dir):
    """Nodes of the region, nation, customer tree with paths that sort in pre-order, by a recursive query over the child table."""
    for t in ("region", "nation", "customer"):
        read(spark, sf_dir, t).createOrReplaceTempView(f"_tree_{t}")
    return spark.sql(
        """WITH RECURSIVE child AS (SELECT 'R' || r_regionkey AS id, CAST(NULL AS STRING) AS parent, r_name AS name FROM _tree_region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM _tree_nation
        UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, lpad(CAST(c_custkey AS STRING), 8, '0') FROM _tree_customer),
        walk(id, path, depth) AS (SELECT id, name, 1 FROM child WHERE parent IS NULL UNION ALL SELECT c.id, w.path || '/' || c.name, w.depth + 1 FROM walk w JOIN child c ON c.parent = w.id) SELECT path, depth FROM walk"""
    )


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) = 1")
def ambiguous_key_suppress(spark, sf_dir):
    return tables.unique_or_null(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("SELECT user_id, event_id, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS gain FROM (SELECT user_id, event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS value FROM events)")
def action_gains(spark, sf_dir):
    """What each action adds to the best value so far."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("event_id")
    e = read(spark, sf_dir, "events").withColumn("value", F.round(F.max("value").over(w.rowsBetween(W.unboundedPreceding, 0)), 6))
    return e.select("user_id", "event_id", (F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0))).alias("gain"))


@query("WITH k AS (SELECT DISTINCT event_type, user_id FROM events) SELECT event_type, user_id FROM k WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL)")
def journal_resume(spark, sf_dir):
    from lexmill.streaming.journal import still_to_do

    e = read(spark, sf_dir, "events")
    done = e.where("event_type = 'error'").select("user_id", F.lit("ok").alias("status"))
    return still_to_do(e.select("event_type", "user_id").distinct(), done, "user_id")

"""Queries of edges, addresses, and aggregates of graphs and chunks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.registry import query
from lexmill.sources import html
from lexmill.functions import text as T
from lexmill.operators import filters, graph, linking, tables
from lexmill.plans.text_queries import LINES, lines, read

# addresses of statutes made of orders: type, year, number, and for some a unit with a locator
URLS = """ur AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'mailto:a@b.c' WHEN 1 THEN 'https://www.legislation.gov.uk/ukpga/2023/54' WHEN 2 THEN 'https://www.legislation.gov.uk/ukpga/2023/54/section/' || (o_orderkey % 30) WHEN 3 THEN 'https://www.legislation.gov.uk/ukpga/2023/54/section/' || (o_orderkey % 30) || '.2'
  WHEN 4 THEN 'http://legislation.gov.uk/uksi/' || (1990 + o_orderkey % 30) || '/7' WHEN 5 THEN 'https://Example.org/page/' || (o_orderkey % 4) || '/#x' WHEN 6 THEN 'https://other.example/' ELSE '' END AS url FROM orders)"""


def urls(spark, sf_dir):
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    base = F.lit("https://www.legislation.gov.uk/ukpga/2023/54")
    url = (
        F.when(k % 8 == 0, "mailto:a@b.c").when(k % 8 == 1, base).when(k % 8 == 2, F.concat(base, F.lit("/section/"), text(k % 30))).when(k % 8 == 3, F.concat(base, F.lit("/section/"), text(k % 30), F.lit(".2")))
        .when(k % 8 == 4, F.concat(F.lit("http://legislation.gov.uk/uksi/"), text(1990 + k % 30), F.lit("/7"))).when(k % 8 == 5, F.concat(F.lit("https://Example.org/page/"), text(k % 4), F.lit("/#x"))).when(k % 8 == 6, "https://other.example/").otherwise("")
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", url.alias("url"))


@query(f"WITH {URLS} SELECT o_orderkey, CASE o_orderkey % 8 WHEN 4 THEN 'UKSI_' || (1990 + o_orderkey % 30) || '_7' ELSE CASE WHEN o_orderkey % 8 BETWEEN 1 AND 3 THEN 'UKPGA_2023_54' END END AS document FROM ur")
def doc_id_from_url(spark, sf_dir):
    return urls(spark, sf_dir).select("o_orderkey", linking.document_id(F.col("url")).alias("document"))


@query(f"""WITH {URLS}, r AS (SELECT o_orderkey % 8 AS k, o_orderkey % 30 AS n, o_orderkey % 4 AS m FROM ur), s AS (SELECT CASE k WHEN 0 THEN 'NOT_A_LEGAL_REFERENCE' WHEN 1 THEN 'EXACT_DOCUMENT' WHEN 2 THEN CASE WHEN n BETWEEN 1 AND 19 THEN 'EXACT_URL' ELSE 'DOCUMENT_ONLY' END
  WHEN 3 THEN CASE WHEN n BETWEEN 1 AND 9 THEN 'EXACT_URL' WHEN n BETWEEN 10 AND 19 THEN 'NEAREST_ANCESTOR' ELSE 'DOCUMENT_ONLY' END WHEN 4 THEN 'TARGET_NOT_IN_CORPUS' WHEN 5 THEN CASE WHEN m = 1 THEN 'EXACT_DOCUMENT' ELSE 'TARGET_NOT_IN_CORPUS' END WHEN 6 THEN 'TARGET_NOT_IN_CORPUS' ELSE 'UNRESOLVED' END AS status, k FROM r)
SELECT status, count(*) AS n, round(sum(CASE WHEN k IN (5, 6) AND status = 'TARGET_NOT_IN_CORPUS' THEN 0.6::DOUBLE ELSE CASE status WHEN 'NOT_A_LEGAL_REFERENCE' THEN 1.0::DOUBLE WHEN 'EXACT_URL' THEN 0.98::DOUBLE WHEN 'EXACT_DOCUMENT' THEN 0.9::DOUBLE WHEN 'TARGET_NOT_IN_CORPUS' THEN 0.9::DOUBLE WHEN 'NEAREST_ANCESTOR' THEN 0.75::DOUBLE WHEN 'DOCUMENT_ONLY' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END), 4) AS confidence FROM s GROUP BY 1""")
def url_resolution(spark, sf_dir):
    """Addresses resolved to nodes, documents, or what they lack."""
    nodes = [f"UKPGA_2023_54__section-{i}" for i in range(1, 20)] + [f"UKPGA_2023_54__section-{i}-2" for i in range(1, 10)]
    docs = [("UKPGA_2023_54", "https://www.legislation.gov.uk/ukpga/2023/54"), ("PAGE_1", "https://example.org/page/1/")]
    got = linking.resolve_urls(urls(spark, sf_dir), spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(docs, "document string, url string"))
    return got.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


# a tree of nodes A-x-y-z: every x and every x-2 has chunks; edges go from an order's node to that of another
TREE = """tr AS (SELECT o_orderkey, 'A-' || (o_orderkey % 7) || '-' || (o_orderkey % 5) || '-' || (o_orderkey % 3) AS source, CASE WHEN o_custkey % 4 = 0 THEN 'A-' || (o_custkey % 7) ELSE 'A-' || (o_custkey % 9) || '-' || (o_custkey % 4) || '-1' END AS target FROM orders),
pv AS (SELECT 'A-' || i AS node, 'A-' || i AS up FROM range(6) t(i) UNION ALL SELECT 'A-' || i || '-2', 'A-' || i || '-2' FROM range(4) t(i)),
an AS (SELECT DISTINCT k, unnest([2, 1]) AS d, unnest([array_to_string(string_split(k, '-')[1:3], '-'), array_to_string(string_split(k, '-')[1:2], '-')]) AS a FROM (SELECT source AS k FROM tr UNION SELECT target FROM tr)),
up AS (SELECT k, arg_max(a, d) AS found FROM an JOIN pv ON pv.node = a WHERE a <> k GROUP BY k)"""


def tree(spark, sf_dir):
    o, text = F.col("o_orderkey"), lambda c: c.cast("string")
    c = F.col("o_custkey")
    e = read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("-", F.lit("A"), text(o % 7), text(o % 5), text(o % 3)).alias("source"), F.when(c % 4 == 0, F.concat_ws("-", F.lit("A"), text(c % 7))).otherwise(F.concat_ws("-", F.lit("A"), text(c % 9), text(c % 4), F.lit("1"))).alias("target"))
    p = spark.createDataFrame([(f"A-{i}",) for i in range(6)] + [(f"A-{i}-2",) for i in range(4)], "node string")
    return e, p


@query(f"""WITH {TREE}, x AS (SELECT tr.*, t.found AS t, s.found AS s FROM tr LEFT JOIN up t ON t.k = target LEFT JOIN up s ON s.k = source)
SELECT o_orderkey, CASE WHEN target IN (SELECT node FROM pv) THEN target WHEN t IS NOT NULL AND t <> coalesce(s, source) THEN t END AS "to", CASE WHEN target IN (SELECT node FROM pv) THEN 'DIRECT' WHEN t IS NULL THEN 'UNRESOLVABLE' WHEN t = coalesce(s, source) THEN 'SELF_LOOP' ELSE 'NEAREST_ANCESTOR_ROLLUP' END AS resolution, s AS start, CASE WHEN s IS NULL THEN 'UNRESOLVABLE' ELSE 'NEAREST_ANCESTOR_ROLLUP' END AS start_resolution FROM x""")
def ancestor_rollup(spark, sf_dir):
    """Edges whose ends are rolled up to provisions that have chunks."""
    e, p = tree(spark, sf_dir)
    none = p.limit(0)
    return linking.densify(e, p, none, none).select("o_orderkey", "to", "resolution", "start", "start_resolution")


@query("WITH e AS (SELECT 'P' || l_partkey AS source, l_returnflag AS relation, 'S' || (l_suppkey % 10) AS t, 'S' || l_suppkey AS target, l_discount AS confidence, l_linestatus AS status FROM lineitem) SELECT source, relation, t AS \"to\", min(target) AS target, max(confidence) AS confidence, min(status) AS status FROM e GROUP BY ALL")
def edge_dedup(spark, sf_dir):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    e = read(spark, sf_dir, "lineitem").select(text("P", F.col("l_partkey")).alias("source"), F.col("l_returnflag").alias("relation"), text("S", F.col("l_suppkey") % 10).alias("to"), text("S", F.col("l_suppkey")).alias("target"), F.col("l_discount").alias("confidence"), F.col("l_linestatus").alias("status"))
    return linking.deduplicated(e)


CHUNKED = "ck AS (SELECT 'C' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || '-P' || (doc_id % 20) END AS parent, source AS document FROM documents)"


def chunked(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat("source", F.lit("-P"), (F.col("doc_id") % 20).cast("string"))).alias("parent"), F.col("source").alias("document"))


@query(f"WITH {CHUNKED}, s AS (SELECT CASE WHEN parent = '' THEN document ELSE parent END AS source, id AS target, 'HAS_CHUNK' AS relation FROM ck UNION ALL SELECT DISTINCT document, parent, 'CONTAINS' FROM ck WHERE parent <> '') SELECT source, target, relation, 'structural' AS origin FROM s UNION ALL SELECT id, document, 'REFERENCES', 'reference' FROM ck")
def structural_edges(spark, sf_dir):
    """Edges of two origins as one table."""
    c = chunked(spark, sf_dir)
    cited = c.select(F.col("id").alias("source"), F.col("document").alias("target"), F.lit("REFERENCES").alias("relation"))
    return linking.tagged({"structural": linking.structural(c), "reference": cited})


@query(f"WITH {CHUNKED}, e AS (SELECT 'C' || l_partkey AS source FROM lineitem) SELECT id, count(e.source) AS n_edges FROM ck LEFT JOIN e ON e.source = id GROUP BY 1")
def chunk_edge_counts(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("source"))
    return linking.edge_counts(chunked(spark, sf_dir).select("id"), e)


@query("WITH t AS (SELECT o_custkey AS c, CASE o_orderkey % 6 WHEN 0 THEN 'UKPGA_2023_54' WHEN 1 THEN 'UKSI_2024_692' END AS i FROM orders) SELECT c AS o_custkey, CASE WHEN count(DISTINCT i) = 1 THEN min(i) END AS instrument FROM t GROUP BY 1")
def instrument_inference(spark, sf_dir):
    """The instrument that all texts of a customer name, if it is one."""
    t = F.when(F.col("o_orderkey") % 6 == 0, "under the Procurement Act 2023").when(F.col("o_orderkey") % 6 == 1, "see PR 2024").otherwise("nothing")
    return linking.inferred_instrument(read(spark, sf_dir, "orders").withColumn("text", t), "o_custkey", "text")


@query("""WITH t AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'FOREIGN' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ALIEN_UNIT' END END AS status FROM orders) SELECT coalesce(status, 'OWN') AS status, count(*) AS n FROM t GROUP BY 1""")
def citation_refusal(spark, sf_dir):
    """Citations that the text around them hands to other instruments, by what it says."""
    k = F.col("o_orderkey")
    following = F.when(k % 5 == 0, " of the Local Government Act").when(k % 5 == 3, " of the Procurement Act 2023").otherwise(" applies")
    around = F.when(k % 5 == 1, "which amends section 4 of the Highways Act").otherwise("section 4 applies")
    unit = F.when((k % 5 == 2) & (k % 2 == 0), "regulation").otherwise("section")
    return read(spark, sf_dir, "orders").select(F.coalesce(linking.guidance_status(following, around, unit, F.lit("UKPGA_2023_54")), F.lit("OWN")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


TOPICS = "tp AS (SELECT l_partkey AS id, list_distinct(list(l_returnflag || l_linestatus || (l_suppkey % 3))) AS t FROM lineitem GROUP BY 1)"


def topics(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 3).cast("string"))).alias("topics"))


@query(f"WITH {TOPICS} SELECT id, array_to_string(list_sort(t), ',') AS topics FROM tp")
def topic_vocabulary(spark, sf_dir):
    return topics(spark, sf_dir).select("id", F.array_join(F.array_sort("topics"), ",").alias("topics"))


@query(f"WITH {TOPICS}, e AS (SELECT p_partkey AS source, p_partkey % 50 + 1 AS target, p_brand AS relation FROM part), j AS (SELECT relation, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS j FROM e JOIN tp a ON a.id = source JOIN tp b ON b.id = target) SELECT relation, count(*) AS edges, round(avg(j), 6) AS mean, round(avg((j = 0)::INT), 6) AS zero_share FROM j GROUP BY 1")
def edge_coherence(spark, sf_dir):
    e = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") % 50 + 1).alias("target"), F.col("p_brand").alias("relation"))
    return linking.coherence(e, topics(spark, sf_dir))


@query("WITH b AS (SELECT l_partkey AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) UNION ALL SELECT 1000000 + l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)), d AS (SELECT n, count(*) AS d FROM b GROUP BY 1) SELECT count(*) AS nodes, round(avg(d), 6) AS mean, median(d)::DOUBLE AS median, max(d) AS most, quantile_cont(d, 0.99)::DOUBLE AS p99, sum((d = 1)::INT)::BIGINT AS leaves FROM d")
def degree_statistics(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 1000000).alias("target")).distinct()
    d = graph.degrees(e)
    return d.agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 6).alias("mean"), F.percentile("degree", F.lit(0.5)).alias("median"), F.max("degree").alias("most"), F.percentile("degree", F.lit(0.99)).alias("p99"), F.sum((F.col("degree") == 1).cast("long")).alias("leaves"))


@query(f"WITH {LINES}, t AS (SELECT source, text, greatest(1, length(text) // 4) AS k, trim(text) = '' OR regexp_matches(trim(text), ':$') AS bad FROM l) SELECT source, count(*) AS n, sum(bad::INT)::BIGINT AS defects, sum((k BETWEEN 15 AND 200)::INT)::BIGINT AS in_band FROM t GROUP BY 1")
def method_rollup(spark, sf_dir):
    t = lines(spark, sf_dir).withColumn("k", T.tokens_by_length(F.col("text"))).withColumn("bad", (F.trim("text") == "") | F.trim("text").rlike(":$"))
    return t.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("defects"), F.sum(F.col("k").between(15, 200).cast("long")).alias("in_band"))


@query("SELECT source, lang, n_chars // 1000 AS size, count(*) AS n, grouping(source, lang, n_chars // 1000)::BIGINT AS g FROM documents GROUP BY GROUPING SETS ((source), (lang), (n_chars // 1000), (source, lang))")
def crawl_summary(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", "lang", F.floor(F.col("n_chars") / 1000).alias("size"))
    return d.groupingSets([["source"], ["lang"], ["size"], ["source", "lang"]], "source", "lang", "size").agg(F.count("*").alias("n"), F.grouping_id("source", "lang", "size").cast("long").alias("g"))


@query(f"WITH {LINES}, c AS (SELECT doc_id, pos, text FROM l WHERE trim(text) <> '') SELECT doc_id, pos, doc_id || '-' || lpad(row_number() OVER (PARTITION BY doc_id ORDER BY pos)::VARCHAR, 4, '0') AS chunk_id FROM c")
def chunk_ids(spark, sf_dir):
    """Ordinals and zero-padded ids of the lines that have text."""
    c = lines(spark, sf_dir).where(F.trim("text") != "")
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    return c.select("doc_id", "pos", F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.lpad(n.cast("string"), 4, "0")).alias("chunk_id"))


@query(r"""WITH h AS (SELECT page_id, unnest(range(len(x))) AS pos, unnest(x) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS x FROM pages)), f AS (SELECT page_id, href, min(pos) AS pos FROM h GROUP BY ALL) SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place FROM f""")
def first_links(spark, sf_dir):
    """Links of a page in order, each once, where it came first."""
    h = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    f = h.groupBy("page_id", "href").agg(F.min("pos").alias("pos"))
    return f.select("page_id", "href", F.row_number().over(W.partitionBy("page_id").orderBy("pos")).cast("long").alias("place"))


@query("WITH a AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber AS id FROM lineitem WHERE l_returnflag <> 'A'), b AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber AS id FROM lineitem WHERE l_returnflag <> 'R') SELECT CASE WHEN b.id IS NULL THEN 'shipped' WHEN a.id IS NULL THEN 'fresh' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b USING (id) GROUP BY 1")
def shipped_against_fresh(spark, sf_dir):
    """Provision ids of two builds: in both, or in one alone."""
    d = read(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), "l_returnflag")
    a, b = (d.where(F.col("l_returnflag") != x).select("id").distinct().withColumn(s, F.lit(True)) for x, s in (("A", "a"), ("R", "b")))
    side = F.when(F.col("b").isNull(), "shipped").when(F.col("a").isNull(), "fresh").otherwise("both")
    return a.join(b, "id", "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT *, source IN ('web', 'forum') AS l FROM documents), k AS (SELECT doc_id, CASE WHEN trim(text) = '' THEN 'EMPTY' WHEN regexp_matches(lower(text), '(license|token)') THEN 'RELEVANT' ELSE 'OTHER' END AS gate FROM d) SELECT gate, count(*) AS n FROM k GROUP BY 1""")
def relevance_gate(spark, sf_dir):
    """Empty texts, texts with a wanted word, others."""
    d = read(spark, sf_dir, "documents")
    wanted = F.exists(F.array(F.lit("license"), F.lit("token")), lambda t: F.contains(F.lower("text"), t))
    return d.select(F.when(F.trim("text") == "", "EMPTY").when(wanted, "RELEVANT").otherwise("OTHER").alias("gate")).groupBy("gate").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, coalesce(regexp_extract(url, '\.([A-Za-z0-9]{1,5})([?#]|$)', 1), '') AS suffix, regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '/(search|login|contact|about|cookies|privacy|feedback|help|tag|category)(/|$)') AS skipped FROM pages")
def url_gate(spark, sf_dir):
    """Suffix of each address, and whether its path names a page that is no document."""
    p, path = read(spark, sf_dir, "pages"), F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    return p.select("page_id", F.regexp_extract("url", r"\.([A-Za-z0-9]{1,5})([?#]|$)", 1).alias("suffix"), path.rlike("/(search|login|contact|about|cookies|privacy|feedback|help|tag|category)(/|$)").alias("skipped"))


@query(r"SELECT page_id, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'), ' ')), chr(10)) AS text FROM pages")
def page_plain_text(spark, sf_dir):
    """Pages without their tags, blanks within lines as one."""
    plain = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\n{3,}", "\n\n")
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " "))), "\n").alias("text"))


@query("WITH v AS (SELECT *, sum(1) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders), n AS (SELECT o_orderkey, regexp_replace('Order: ' || o_custkey || '/' || o_orderstatus || '.pdf', '[\\\\/:*?\"<>|]+', '_', 'g') AS f, k FROM v) SELECT o_orderkey, CASE WHEN k = 1 THEN f ELSE regexp_replace(f, '\\.pdf$', '') || '_' || k || '.pdf' END AS name FROM n")
def file_names(spark, sf_dir):
    """Safe file names, with a number where one repeats."""
    o = read(spark, sf_dir, "orders").withColumn("f", F.regexp_replace(F.concat(F.lit("Order: "), F.col("o_custkey").cast("string"), F.lit("/"), "o_orderstatus", F.lit(".pdf")), r'[\\/:*?"<>|]+', "_"))
    k = F.row_number().over(W.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey"))
    return o.withColumn("k", k).select("o_orderkey", F.when(F.col("k") == 1, F.col("f")).otherwise(F.concat(F.regexp_replace("f", r"\.pdf$", ""), F.lit("_"), F.col("k").cast("string"), F.lit(".pdf"))).alias("name"))


@query(f"WITH {LINES} SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS text FROM l WHERE pos % 5 <> 4 GROUP BY 1")
def document_rebuild(spark, sf_dir):
    """Documents put together again from their live lines."""
    c = lines(spark, sf_dir).where("pos % 5 <> 4").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"))
    return c.select("doc_id", F.array_join(F.transform("x", lambda y: y["text"]), "\n").alias("text"))


@query("WITH s AS (SELECT o_orderkey AS s, sha256(o_orderstatus) AS h FROM orders), b AS (SELECT l_orderkey AS s, sha256(CASE WHEN l_orderkey % 7 = 0 THEN 'x' ELSE 'O' END) AS h, l_linenumber AS v FROM lineitem WHERE l_orderkey % 3 <> 0), c AS (SELECT s, arg_max(h, v) AS h FROM b GROUP BY 1) SELECT s.s AS segment, CASE WHEN c.s IS NULL THEN 'NO_PLAN' WHEN c.h = s.h THEN 'OK' ELSE 'INPUT_HASH_MISMATCH' END AS status FROM s LEFT JOIN c USING (s)")
def boundary_status(spark, sf_dir):
    """Segments with their latest plan, and whether it was made for this text."""
    s = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment"), F.sha2("o_orderstatus", 256).alias("h"))
    b = read(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("segment"), F.sha2(F.when(F.col("l_orderkey") % 7 == 0, "x").otherwise("O"), 256).alias("plan"), "l_linenumber")
    x = s.join(b.groupBy("segment").agg(F.max_by("plan", "l_linenumber").alias("plan")), "segment", "left")
    return x.select("segment", F.when(F.col("plan").isNull(), "NO_PLAN").when(F.col("plan") == F.col("h"), "OK").otherwise("INPUT_HASH_MISMATCH").alias("status"))


@query("WITH r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY (value * 1000)::BIGINT * 1000 + event_id % 1000 DESC, event_id) AS k FROM events) SELECT user_id, event_id FROM r WHERE k = 1")
def best_representation(spark, sf_dir):
    """Of each user's events the one with the best score."""
    e = read(spark, sf_dir, "events").withColumn("score", F.round(F.col("value") * 1000).cast("long") * 1000 + F.col("event_id") % 1000)
    return tables.pick(e, ["user_id"], F.desc("score"), F.col("event_id")).select("user_id", "event_id")


@query(r"SELECT doc_id, sha1(lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'))) AS hash FROM documents")
def text_norm_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.norm_hash(F.col("text")).alias("hash"))


@query(r"WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark) SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) AS jaccard FROM b x JOIN b y ON x.item_id < y.item_id WHERE len(list_intersect(x.w, y.w)) > 0")
def jaccard_pairs(spark, sf_dir):
    """Similarity of each two benchmark texts that share a word, by an inverted join."""
    b = read(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.words(F.col("text"))).alias("w"))
    t = b.select("item_id", F.explode("w").alias("t"))
    near = t.join(t.select(F.col("item_id").alias("b"), "t"), "t").where("item_id < b").select(F.col("item_id").alias("a"), "b").distinct()
    x = near.join(b.select(F.col("item_id").alias("a"), F.col("w").alias("wa")), "a").join(b.select(F.col("item_id").alias("b"), F.col("w").alias("wb")), "b")
    return x.select("a", "b", F.round(T.jaccard(F.col("wa"), F.col("wb")), 6).alias("jaccard"))


@query(r"SELECT page_id, regexp_replace(CASE WHEN regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1) <> '' THEN regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1) WHEN regexp_extract(html, '(?is)<main\b[^>]*>(.*?)</main>', 1) <> '' THEN regexp_extract(html, '(?is)<main\b[^>]*>(.*?)</main>', 1) WHEN regexp_extract(html, '(?is)<body\b[^>]*>(.*?)</body>', 1) <> '' THEN regexp_extract(html, '(?is)<body\b[^>]*>(.*?)</body>', 1) ELSE html END, '(?is)<(script|style|nav|form|svg|noscript|template|header|footer|aside)\b[^>]*>.*?</(script|style|nav|form|svg|noscript|template|header|footer|aside)>', '', 'g') AS content FROM pages")
def main_content(spark, sf_dir):
    """What holds a page's content, without navigation, scripts and the like."""
    return read(spark, sf_dir, "pages").select("page_id", html.main_content(F.col("html")).alias("content"))


@query("WITH o AS (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE '' END AS superseded_by, o_orderkey % 7 = 0 AS filtered_out FROM orders), v AS (SELECT * FROM o WHERE superseded_by = '' AND NOT filtered_out) SELECT v.o_orderkey, CASE WHEN v.o_orderkey % 4 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM v")
def live_rows_updated(spark, sf_dir):
    """Rows in effect, with an update of every fourth key."""
    o = read(spark, sf_dir, "orders").withColumn("superseded_by", F.when(F.col("o_orderkey") % 9 == 0, "x").otherwise("")).withColumn("filtered_out", F.col("o_orderkey") % 7 == 0)
    new = read(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("U").alias("o_orderstatus"))
    return tables.keyed_update(tables.live(o), new, "o_orderkey", "o_orderstatus").select("o_orderkey", "o_orderstatus")


@query(f"WITH {URLS} SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://|#.*$', '', 'g'), '^www\\.', ''), '(/data\\.xml|/contents|/made|/enacted)*/?$', '') AS plain, CASE WHEN regexp_matches(trim(url), '(?i)legislation\\.gov\\.uk/.*?/data\\.(akn|xml)$|legislation\\.gov\\.uk/[a-z]+/[0-9]{{4}}/[a-zA-Z0-9_-]+/?$') THEN 'LEGISLATION' ELSE 'BLOCKS' END AS lane FROM ur")
def instrument_urls(spark, sf_dir):
    """Addresses of instruments in one form, and the lane that takes them in."""
    u = urls(spark, sf_dir)
    return u.select("o_orderkey", T.instrument_url(F.col("url")).alias("plain"), filters.route(F.col("url")).alias("lane"))


@query("SELECT p_partkey, left(trim(regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), 220) AS safe, CASE p_partkey % 4 WHEN 0 THEN 'PCR2015' WHEN 1 THEN 'PR2024' WHEN 2 THEN 'PA2023' END AS regime FROM part")
def safe_ids(spark, sf_dir):
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, "on the Public Contracts Regulations 2015 and PA2023").when(k == 1, "PR2024").when(k == 2, "the Procurement Act 2023").otherwise("none")
    return read(spark, sf_dir, "part").select("p_partkey", T.safe_id(F.concat_ws(" / ", "p_name", "p_type")).alias("safe"), T.regime(said).alias("regime"))

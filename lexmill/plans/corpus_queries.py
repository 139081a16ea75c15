"""Queries over chunked corpora, evidence bundles, statutory XML and paged text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.registry import query
from lexmill.functions import text as T
from lexmill.functions.text import digest
from lexmill.operators import bundles, chunking, evaluate, invariants, tables
from lexmill.plans.text_queries import HOST, lines, read
from lexmill.sources import paged, statutes

COUNTS = "c AS (SELECT doc_id, doc_id % 50 AS m, ceil(len(string_split(text, chr(10))) / 4.0)::BIGINT AS n FROM documents WHERE text IS NOT NULL)"
BROKEN = {"BLOCK_GAP": ("count(*)", "m = 1"), "BLOCK_OVERLAP": ("count(*)", "m = 4"), "ALTERED_TEXT": ("sum(n)", "m = 3"), "WRONG_HASH": ("sum(n)", "m = 2"), "DUPLICATE_CHUNK": ("count(*)", "m = 4"), "ORDINAL_GAP": ("count(*)", "m = 4 OR m = 1 AND n > 1"), "DANGLING_ENDPOINT": ("count(*)", "m = 1 AND n > 1")}


@query(f"WITH {COUNTS} " + " UNION ALL ".join(f"SELECT '{k}' AS invariant, {n}::BIGINT AS n FROM c WHERE {w} HAVING count(*) > 0" for k, (n, w) in BROKEN.items()))
def corpus_invariants(spark, sf_dir):
    """Violations of the invariants by chunks of four lines, some of which are damaged by the rest of their document's id by 50."""
    blocks = lines(spark, sf_dir).select(F.col("doc_id").alias("segment"), (F.col("pos") + 1).alias("pos"), "text")
    parts = chunking.windows(blocks, "segment", "pos", 4).groupBy("segment", F.col("chunk").alias("ordinal"))
    chunks = parts.agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    name = lambda n: F.concat_ws("-", "segment", n)
    m = F.pmod("segment", F.lit(50))
    chunks = chunks.withColumn("chunk", name("ordinal")).withColumn("text", F.when(m == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    chunks = chunks.withColumn("text_sha256", F.when(m == 2, "none").otherwise(digest(F.col("text"))))
    edges = chunks.where("ordinal > 1").select(name(F.col("ordinal") - 1).alias("source"), F.col("chunk").alias("target"), F.lit("NEXT").alias("relation"))
    copies = F.when((F.col("ordinal") == 1) & (m == 1), 0).when((F.col("ordinal") == 1) & (m == 4), 2).otherwise(1)
    chunks = chunks.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).drop("_copy")
    return invariants.violations(blocks, chunks, edges).groupBy("invariant").agg(F.count("*").alias("n"))


@query("SELECT doc_id // 20 AS scenario, 'C' || row_number() OVER (PARTITION BY doc_id // 20 ORDER BY sha256(coalesce(text, ''))) AS alias, sha256(coalesce(text, '')) AS digest, length(coalesce(text, ''))::BIGINT AS size FROM documents")
def blinded_payloads(spark, sf_dir):
    """Texts of twenty documents each under aliases that tell neither source nor rank."""
    d = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    d = d.select(F.floor(F.col("doc_id") / 20).alias("scenario"), "text", digest(F.col("text")).alias("digest"), F.length("text").cast("long").alias("size"))
    return bundles.blinded(d, "scenario", "text", ["digest", "size"])


def candidates(spark, sf_dir):
    """Orders as a customer's candidates: lanes, sizes and supported requirements from their keys."""
    o, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    names = F.array_distinct(F.array(*(F.concat(F.lit("R"), (key % n % 5).cast("string")) for n in (7, 11))))
    return o.select(F.col("o_custkey").alias("query"), key.alias("rank"), F.when(key % 3 == 0, bundles.LAW).otherwise(bundles.OTHER).alias("lane"), F.floor(F.col("o_totalprice") % 5000).alias("chars"), names.alias("supports"))


@query()
def assemble_bundle(spark, sf_dir):
    """Contexts of six orders and 12,000 characters for every customer."""
    return bundles.assemble(candidates(spark, sf_dir), 6, 12000)


@query()
def coverage_oracle(spark, sf_dir):
    """The best coverage of five requirements by two orders of a customer."""
    wanted = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"), F.explode(F.array(*(F.lit(f"R{i}") for i in range(5)))).alias("requirement"))
    return bundles.coverage_bound(candidates(spark, sf_dir), wanted, 2, 5000)


PARTS = "p AS (SELECT l_orderkey AS document, l_linenumber AS n, min(l_partkey) AS part, min(l_suppkey) AS supplier FROM lineitem GROUP BY 1, 2)"


@query(
    f"""WITH {PARTS} SELECT document, CASE WHEN document % 40 = 0 THEN 'AKN' ELSE 'CLML' END AS dialect, document || '__section-' || n AS node_id, CASE WHEN document % 40 = 0 THEN document || '__part-1' END AS parent_id, CASE WHEN document % 40 = 0 THEN 1 ELSE 0 END::BIGINT AS depth,
  'section' AS node_type, n::VARCHAR AS number, 'Line ' || n AS heading, 'Part ' || part || ' and supplier ' || supplier AS text FROM p
UNION ALL SELECT DISTINCT document, 'AKN', document || '__part-1', NULL, 0, 'part', 'Part 1', 'Orders', NULL FROM p WHERE document % 40 = 0""",
)
def statute_nodes(spark, sf_dir):
    """Nodes of documents in two dialects, made of orders."""
    p = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supplier"))
    said = F.format_string("Part %d and <b>supplier</b> %d", "part", "supplier")
    akn = F.format_string('<section eId="section-%d"><num>%d.</num><heading>Line %d</heading><content><p>%s</p></content></section>', "n", "n", "n", said)
    clml = F.format_string('<P1group><Title>Line %d</Title><P1 id="section-%d"><Pnumber>%d</Pnumber><P1para><Text>%s</Text></P1para></P1></P1group>', "n", "n", "n", said)
    is_akn = F.col("document") % 40 == 0
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "xml"))), lambda x: x["xml"]), "")
    d = p.withColumn("xml", F.when(is_akn, akn).otherwise(clml)).groupBy("document").agg(body.alias("body"))
    d = d.withColumn("xml", F.when(is_akn, F.format_string('<akomaNtoso xmlns="urn:a"><act><body><part eId="part-1"><num>Part 1</num><heading>Orders</heading>%s</part></body></act></akomaNtoso>', "body")).otherwise(F.format_string("<Legislation>%s</Legislation>", "body")))
    text = F.when(F.col("node_type") == "section", F.col("text"))
    return statutes.parse(d, "document", "xml").select("document", "dialect", "node_id", "parent_id", "depth", "node_type", "number", "heading", text.alias("text"))


def headed_pages(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    text = F.concat(F.lit("Record "), F.col("conv_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\nend of page "), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", text.alias("text"))


@query("WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) >= 2) SELECT conv_id, 'Record #' AS masked, n FROM n UNION ALL SELECT conv_id, 'end of page #', n FROM n")
def running_heads(spark, sf_dir):
    """Edge lines that recur on the pages of a document."""
    p = headed_pages(spark, sf_dir)
    return paged.furniture(paged.page_lines(p, "conv_id", "turn"), p, "conv_id", least=2)


@query()
def page_paragraphs(spark, sf_dir):
    """Paragraphs of conversations read as paged documents."""
    p = headed_pages(spark, sf_dir)
    rows = paged.page_lines(p, "conv_id", "turn")
    return paged.paragraphs(rows, paged.furniture(rows, p, "conv_id", least=2), "conv_id", "turn")


@query("SELECT query, count(*) AS requirements, round(avg(content), 6) AS content, round(avg(strict), 6) AS strict FROM (SELECT l_orderkey AS query, l_linenumber, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS content, max(CASE WHEN l_returnflag = 'R' AND l_tax > 0.03::DOUBLE THEN 1 ELSE 0 END) AS strict FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def requirement_coverage(spark, sf_dir):
    """Orders as scenarios and line numbers as requirements; returned lines support fully, taxed ones by the wanted source."""
    j = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("requirement"), F.when(F.col("l_returnflag") == "R", "FULL").otherwise("NONE").alias("support"), (F.col("l_tax") > 0.03).alias("role_ok"))
    return evaluate.requirement_coverage(j)


@query("SELECT doc_id, CASE WHEN quality IS NULL OR toxic IS NULL THEN 'UNJUDGED' WHEN quality = 1 AND toxic = 1 THEN 'CONTRADICTORY' ELSE 'TOXIC' END AS reason FROM labels WHERE quality IS NULL OR toxic IS NULL OR toxic = 1")
def review_queue(spark, sf_dir):
    """Labels that someone should look at, and why."""
    l = read(spark, sf_dir, "labels")  # noqa: E741
    reason = F.when(F.col("quality").isNull() | F.col("toxic").isNull(), "UNJUDGED").when((F.col("quality") == 1) & (F.col("toxic") == 1), "CONTRADICTORY").otherwise("TOXIC")
    return l.where("quality is null or toxic is null or toxic = 1").select("doc_id", reason.alias("reason"))


@query(f"SELECT {HOST} AS host, page_id, page_id % 3 AS priority, length(url)::BIGINT AS depth FROM pages QUALIFY row_number() OVER (PARTITION BY {HOST} ORDER BY page_id % 3 DESC, length(url), page_id) = 1")
def crawl_dedupe(spark, sf_dir):
    """One page of each host: the highest priority, then the shortest path, then the smallest id."""
    p = read(spark, sf_dir, "pages").select(T.host(F.col("url")).alias("host"), "page_id", (F.col("page_id") % 3).alias("priority"), F.length("url").cast("long").alias("depth"))
    return tables.pick(p, ["host"], F.desc("priority"), F.col("depth"), F.col("page_id"))

"""Edges between chunks, provisions and documents: where they come from and what they resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import ancestors, locator_parts
from lexmill.operators.refs import UNITS, named_instrument
from lexmill.plans.layout import together

# Parts of a statute's address. Fixed values.
STATUTE_URL = r"(?i)legislation\.gov\.uk/([a-z]+)/(\d{4})/(\d+)(?:/(section|regulation|schedule|article|part|paragraph)/([\w.\-]+))?"
EXTERNAL = r"(?i)\bof\s+(the\s+)?[A-Z][\w'’\-]*(\s+[\w'’\-]+){0,7}\s+(Act|Regulations|Order|Rules)\b|\bof\s+that\s+(Act|Order|Regulations)\b"
AMENDMENT = r"(?i)\b(amend(?:ment|ed|s)?|insert|substitute|omit|repeal|revoke)\b"
URL_CONFIDENCE = {"NOT_A_LEGAL_REFERENCE": 1.0, "EXACT_URL": 0.98, "EXACT_DOCUMENT": 0.9, "TARGET_NOT_IN_CORPUS": 0.9, "NEAREST_ANCESTOR": 0.75, "DOCUMENT_ONLY": 0.5, "UNRESOLVED": 0.0}


def document_id(url: Column) -> Column:
    """``.../ukpga/2023/54/...`` -> ``UKPGA_2023_54``; null for other addresses."""
    part = lambda k: F.regexp_extract(url, STATUTE_URL, k)
    return F.when(part(1) != "", F.concat_ws("_", F.upper(part(1)), part(2), part(3)))


def resolve_urls(links: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``target``, ``document``, ``status`` and ``confidence`` to rows with ``url``, against ``nodes(node)`` and ``documents(document, url)``.

    Addresses of statutes resolve to the node of their locator, its deepest held ancestor, or the document; other addresses to the document that has
    them. Mail and telephone links are no references; null and unreadable ones stay unresolved.
    """
    low = F.lower(F.coalesce("url", F.lit("")))
    unit, loc = F.lower(F.regexp_extract("url", STATUTE_URL, 4)), F.regexp_extract("url", STATUTE_URL, 5)
    x = links.withColumn("_doc", document_id(F.col("url"))).withColumn("_unit", unit).withColumn("_loc", loc).withColumn("_plain", F.regexp_replace(F.regexp_replace(low, "#.*$", ""), "/+$", ""))
    parts = F.filter(F.split("_loc", r"[.\-]"), lambda p: p != "")
    x = x.withColumn("_parts", F.when(F.col("_loc") != "", F.flatten(F.transform(parts, locator_parts_or_self))))
    path = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda k: F.struct(k.alias("depth"), F.concat(F.col("_doc"), F.lit("__"), F.col("_unit"), F.lit("-"), F.array_join(F.slice("_parts", F.lit(1), k), "-")).alias("node")))
    x = x.withColumn("_row", F.xxhash64("url"))
    hit = x.where("_doc is not null and size(_parts) > 0").select("_row", F.explode(path).alias("p")).distinct().join(nodes.select(F.col("node").alias("_n")), F.col("p.node") == F.col("_n")).groupBy("_row").agg(F.max("p").alias("p"))
    d = documents.select(F.col("document").alias("_held"), F.regexp_replace(F.lower("url"), "/+$", "").alias("_at"))
    x = x.join(hit, "_row", "left").join(d.select("_held").distinct(), F.col("_doc") == F.col("_held"), "left").join(d.select(F.col("_held").alias("_of"), "_at").dropDuplicates(["_at"]), F.col("_plain") == F.col("_at"), "left")
    web = low.rlike("^[a-z]+://[^/]+")
    status = (
        F.when(low.rlike("^(mailto|tel):"), "NOT_A_LEGAL_REFERENCE").when(F.col("_doc").isNotNull() & F.col("_held").isNull(), "TARGET_NOT_IN_CORPUS")
        .when(F.col("_doc").isNotNull() & F.col("_parts").isNotNull() & (F.col("p.depth") == F.size("_parts")), "EXACT_URL").when(F.col("_doc").isNotNull() & F.col("p").isNotNull(), "NEAREST_ANCESTOR")
        .when(F.col("_doc").isNotNull() & F.col("_parts").isNotNull(), "DOCUMENT_ONLY").when(F.col("_doc").isNotNull() | F.col("_of").isNotNull(), "EXACT_DOCUMENT").when(web, "TARGET_NOT_IN_CORPUS").otherwise("UNRESOLVED")
    )
    x = x.withColumn("target", F.col("p.node")).withColumn("document", F.coalesce("_doc", "_of")).withColumn("status", status)
    weight = F.create_map(*(F.lit(v) for kv in URL_CONFIDENCE.items() for v in kv))[F.col("status")]
    return x.withColumn("confidence", F.when((F.col("status") == "TARGET_NOT_IN_CORPUS") & F.col("_doc").isNull(), 0.6).otherwise(weight)).select(*links.columns, "target", "document", "status", "confidence")


def locator_parts_or_self(p: Column) -> Column:
    return F.when(F.size(locator_parts(p)) > 0, locator_parts(p)).otherwise(F.array(p))


def deepest(keys: DataFrame, nodes: DataFrame, own: bool = True) -> DataFrame:
    """``(key, found)``: the key itself (if ``own``) or its nearest ancestor among ``nodes(node)``."""
    up = F.concat(F.array("key"), ancestors(F.col("key"))) if own else ancestors(F.col("key"))
    x = keys.select("key").distinct().select("key", F.posexplode(up).alias("far", "node")).join(nodes, "node")
    return x.groupBy("key").agg(F.min_by("node", "far").alias("found"))


def densify(edges: DataFrame, provisions: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``to``, ``resolution``, ``start`` and ``start_resolution`` to ``(source, target, ...)``: ends that search can reach.

    Reachable are provisions that have chunks, chunks and documents, each given as ``(node)``. A target is DIRECT, or rolled up to its nearest provision with
    chunks (a roll-up to the edge's own rolled-up source is SELF_LOOP and has no end), else UNRESOLVABLE; a source likewise.
    """
    reach = together([provisions, chunks, documents]).distinct()
    hit = lambda end, name: deepest(edges.select(F.col(end).alias("key")), provisions, own=False).select(F.col("key").alias(end), F.col("found").alias(name))
    flag = lambda end, name: reach.select(F.col("node").alias(end), F.lit(True).alias(name))
    e = edges.join(hit("target", "_t"), "target", "left").join(hit("source", "_s"), "source", "left").join(flag("target", "_to"), "target", "left").join(flag("source", "_from"), "source", "left")
    e = e.join(provisions.select(F.col("node").alias("source"), F.lit(True).alias("_own")), "source", "left")
    rolled = F.when(F.col("_own"), F.col("source")).otherwise(F.coalesce("_s", "source"))
    to = F.when(F.col("_to"), "DIRECT").when(F.col("_t").isNull(), "UNRESOLVABLE").when(F.col("_t") == rolled, "SELF_LOOP").otherwise("NEAREST_ANCESTOR_ROLLUP")
    start = F.when(F.col("_from"), "DIRECT").when(F.col("_s").isNull(), "UNRESOLVABLE").otherwise("NEAREST_ANCESTOR_ROLLUP")
    e = e.withColumn("resolution", to).withColumn("start_resolution", start)
    e = e.withColumn("to", F.when(to == "DIRECT", F.col("target")).when(to == "NEAREST_ANCESTOR_ROLLUP", F.col("_t"))).withColumn("start", F.when(start == "DIRECT", F.col("source")).when(start == "NEAREST_ANCESTOR_ROLLUP", F.col("_s")))
    return e.select(*edges.columns, "to", "resolution", "start", "start_resolution")


def deduplicated(edges: DataFrame) -> DataFrame:
    """One edge for each source, relation and reachable end: the smallest target, the largest confidence, the smallest status."""
    return edges.groupBy("source", "relation", "to").agg(F.min("target").alias("target"), F.max("confidence").alias("confidence"), F.min("status").alias("status"))


def structural(chunks: DataFrame) -> DataFrame:
    """CONTAINS edges from each document to its provisions and HAS_CHUNK edges from a provision, or a document, to its chunks: ``(source, target, relation)`` of ``(id, parent, document)``."""
    has = chunks.select(F.coalesce(F.nullif("parent", F.lit("")), "document").alias("source"), F.col("id").alias("target"), F.lit("HAS_CHUNK").alias("relation"))
    within = chunks.where("parent <> ''").select(F.col("document").alias("source"), F.col("parent").alias("target"), F.lit("CONTAINS").alias("relation")).distinct()
    return has.unionByName(within)


def tagged(origins: dict[str, DataFrame]) -> DataFrame:
    """Edges of several origins as one table with ``origin``."""
    out = None
    for name, df in origins.items():
        one = df.withColumn("origin", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def inferred_instrument(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, instrument)``: the one instrument that a document's texts name; null where they name none or several."""
    x = docs.groupBy(id_col).agg(F.collect_set(named_instrument(F.col(text))).alias("s"))  # at most as many as are known by name
    return x.select(id_col, F.when(F.size("s") == 1, F.col("s")[0]).alias("instrument"))


def guidance_status(following: Column, around: Column, unit: Column, document: Column) -> Column:
    """What the text around a citation says before any lookup: FOREIGN (another instrument that isn't known), AMBIGUOUS (an amendment of another one), ALIEN_UNIT, or null."""
    own = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[F.split(document, "_")[0]]
    foreign = following.rlike(EXTERNAL)
    return F.when(foreign & named_instrument(following).isNull(), "FOREIGN").when(~foreign & around.rlike(AMENDMENT) & around.rlike(EXTERNAL), "AMBIGUOUS").when(unit.isin("section", "regulation") & (unit != own), "ALIEN_UNIT")


def edge_counts(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``n_edges``, the edges that leave each chunk ``(id)``."""
    n = edges.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("n_edges"))
    return chunks.join(n, F.col("id") == F.col("_s"), "left").drop("_s").fillna(0, ["n_edges"])


def coherence(edges: DataFrame, topics: DataFrame) -> DataFrame:
    """``(relation, edges, mean, zero_share)``: Jaccard similarity of the topics of each edge's ends, of ``(id, topics)``."""
    t = lambda end, name: topics.select(F.col("id").alias(end), F.col("topics").alias(name))
    e = edges.join(t("source", "_a"), "source").join(t("target", "_b"), "target")
    j = F.when((F.size("_a") > 0) & (F.size("_b") > 0), F.size(F.array_intersect("_a", "_b")) / F.size(F.array_union("_a", "_b"))).otherwise(0.0)
    return e.withColumn("_j", j).groupBy("relation").agg(F.count("*").alias("edges"), F.round(F.avg("_j"), 6).alias("mean"), F.round(F.avg((F.col("_j") == 0).cast("double")), 6).alias("zero_share"))

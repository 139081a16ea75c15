"""Citations: extraction, and resolution against a node universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import locator_parts

# Instruments by the names that cite them. Fixed values.
NAMED = [(r"(?i)\b(procurement act 2023|PA\s?2023|the 2023 Act)\b", "UKPGA_2023_54"), (r"(?i)\b(procurement regulations 2024|PR\s?2024|the 2024 Regulations)\b", "UKSI_2024_692"), (r"(?i)\b(public contracts regulations 2015|PCR\s?2015|the 2015 Regulations)\b", "UKSI_2015_102")]
UNITS = {"UKPGA": "section", "UKSI": "regulation"}
ENABLING = {"UKSI_2024_692": "UKPGA_2023_54"}
CITATION = r"(?i)\b(section|regulation|schedule|part) ([0-9]+[A-Za-z]*(?:\([^)]+\))*)"
#: Confidence of each status.
CONFIDENCE = {"EXACT_INTERNAL": 0.95, "EXACT_CROSS_DOCUMENT": 0.9, "NEAREST_ANCESTOR": 0.75, "DOCUMENT_ONLY": 0.4, "TARGET_NOT_IN_CORPUS": 0.9, "EXTERNAL_INSTRUMENT_REFERENCE": 0.5}


def named_instrument(text: Column) -> Column:
    return F.coalesce(*(F.when(text.rlike(p), F.lit(d)) for p, d in NAMED))


def citations(docs: DataFrame, id_col: str, text: str = "text", after: int = 90) -> DataFrame:
    """``(id, occurrence, unit, locator, following)``: each citation with the text behind it, up to the next citation or ``after`` characters."""
    found = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))
    behind = F.slice(F.split(text, CITATION, -1), 2, 1_000_000)
    x = docs.select(F.col(id_col), F.posexplode(F.arrays_zip(found.alias("m"), behind.alias("f"))).alias("occurrence", "x"))
    return x.select(id_col, F.col("occurrence").cast("long").alias("occurrence"), F.lower(F.regexp_extract("x.m", CITATION, 1)).alias("unit"), F.regexp_extract("x.m", CITATION, 2).alias("locator"), F.substring("x.f", 1, after).alias("following"))


def resolve(cited: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``target``, ``status`` and ``confidence`` to ``(document, unit, locator, following)`` rows.

    The document meant is one that the following text names, else for a section cited in an instrument of regulations its enabling act, else the
    citing one; a foreign instrument that isn't held, or a unit the document doesn't have, has no target. Then the deepest node on the locator's path is taken.
    """
    prefix = F.split("document", "_")[0]
    own_unit = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[prefix]
    enabling = F.create_map(*(F.lit(x) for kv in ENABLING.items() for x in kv))[F.col("document")]
    foreign = F.col("following").rlike(r"(?i)^\s*(of|to|in) the [A-Z][\w ,()]*?(Act|Regulations|Order) [0-9]{4}")
    other = named_instrument(F.col("following"))
    alien = F.col("unit").isin("section", "regulation") & own_unit.isNotNull() & (F.col("unit") != own_unit)
    doc = F.when(other.isNotNull(), other).when(foreign, F.lit(None)).when(alien, F.when(F.col("unit") == "section", enabling)).otherwise(F.col("document"))
    c = cited.withColumns({"_doc": doc, "_foreign": foreign & other.isNull(), "_alien": alien & other.isNull()})
    parts = locator_parts(F.col("locator"))
    path = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.concat(F.col("_doc"), F.lit("__"), F.col("unit"), F.lit("-"), F.array_join(F.slice(parts, F.lit(1), k), "-")).alias("node")))
    c = c.withColumn("_row", F.xxhash64(F.to_json(F.struct(*cited.columns)))).withColumn("_size", F.size(parts))
    hit = c.select("_row", F.explode(path).alias("p")).distinct().join(nodes.select(F.col("node").alias("_node")), F.col("p.node") == F.col("_node")).groupBy("_row").agg(F.max("p").alias("p"))
    c = c.join(hit, "_row", "left")
    exact = F.col("p.depth") == F.col("_size")
    status = F.when(F.col("_foreign"), "TARGET_NOT_IN_CORPUS").when(F.col("_doc").isNull(), "EXTERNAL_INSTRUMENT_REFERENCE").when(exact & (F.col("_doc") == F.col("document")), "EXACT_INTERNAL").when(exact, "EXACT_CROSS_DOCUMENT").when(F.col("p").isNotNull(), "NEAREST_ANCESTOR").otherwise("DOCUMENT_ONLY")
    c = c.withColumn("target", F.col("p.node")).withColumn("status", status)
    return c.withColumn("confidence", F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))[F.col("status")]).drop("_doc", "_foreign", "_alien", "_row", "_size", "p")

"""Dropping blocks by named rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rules for any domain, first match wins. Fixed values.
UNIVERSAL = [
    ("chrome", r"(?i)^\s*(open or close|back to top|view pdf|download pdf|print this page|skip to (main )?content|expand all|collapse all|toggle navigation|share this page|menu|search|home)\s*$"),
    ("copyright", r"(?i)(©|\(c\))\s*crown copyright|open government licence|nationalarchives\.gov\.uk/doc/open-government-licence"),
    ("cookie", r"(?i)\b(cookies? (on|policy|settings)|accept (all )?cookies|we use cookies)\b"),
    ("contact_block", r"(?is)^\s*(contact|get in touch|how we can help)\b.{0,80}(\+?\d[\d\s]{8,}|@[\w.]+\.\w+)"),
    ("phone_list", r"(?s)(\+44|\+?07)\d[\d\s]{7,}.*(\+44|\+?07)\d[\d\s]{7,}"),
    ("filename_artifact", r"(?i)\.(docx|pdf|xlsx|pptx)\s*$"),
]
SUBSTANCE = r"(?i)\b(must|shall|may|means|applies|require|entitled|prohibit|is to be|are to be|should|will be|provides?|sets? out)\b"
LEAST_CHARS = 45


def drop_reason(text: Column, is_heading: Column, rules=UNIVERSAL, domain_reason: Column | None = None) -> Column:
    """Name of the first rule that drops a block; null keeps it."""
    t = F.trim(F.coalesce(text, F.lit("")))
    out = F.when(t == "", "empty")
    for name, pattern in rules:
        out = out.when(F.regexp_like(t, F.lit(pattern)), name)
    if domain_reason is not None:
        out = out.when(domain_reason.isNotNull(), domain_reason)
    return out.when((F.length(t) < LEAST_CHARS) & ~is_heading & ~F.regexp_like(t, F.lit(SUBSTANCE)), "thin_no_substance")


def by_domain(blocks: DataFrame, rules: DataFrame, domain: str = "domain", text: str = "text") -> DataFrame:
    """Adds ``domain_reason``: the first of the domain's rules (domain, prio, name, pattern) that matches."""
    own = rules.groupBy(F.col("domain").alias("_d")).agg(F.array_sort(F.collect_list(F.struct("prio", "name", "pattern"))).alias("_rules"))
    hit = F.filter("_rules", lambda r: F.regexp_like(F.col(text), r["pattern"]))
    return blocks.join(own, F.col(domain) == F.col("_d"), "left").withColumn("domain_reason", F.when(F.size(hit) > 0, hit[0]["name"])).drop("_d", "_rules")


def adjacent_duplicates(blocks: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Adds ``repeated``: the block's trimmed text is that of the block before it."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    return blocks.withColumn("repeated", F.coalesce(F.lag(t).over(W.partitionBy(key).orderBy(order)) == t, F.lit(False)))


def route(url: Column) -> Column:
    """Lane of a URL: statutory XML to the tree parser, all else to blocks. Fixed pattern."""
    return F.when(F.regexp_like(F.trim(url), F.lit(r"(?i)legislation\.gov\.uk/.*?/data\.(akn|xml)$|legislation\.gov\.uk/[a-z]+/\d{4}/[\w-]+/?$")), "LEGISLATION").otherwise("BLOCKS")


def allowed(column: Column, *excluded: str) -> Column:
    """Whether a regime or jurisdiction is none of those left out; rows without one stay, as do all where nothing is left out."""
    return column.isNull() | ~column.isin(*excluded) if excluded else F.lit(True)

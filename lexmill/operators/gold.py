"""Gold citations to rows of a corpus: all tokens in a row's citation first, a search of its text else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators import retrieve
from lexmill.plans.checkpoint import Workspace
from lexmill.plans.layout import together

# Unit names and their short forms in citations. Fixed values.
UNITS = {"section": "s", "regulation": "reg", "schedule": "sch", "paragraph": "para"}
#: Tokens that must all be in a citation, tokens that are searched else, and the most candidates that are counted.
ALL, ANY, COUNTED = 4, 6, 10
#: Parts of the chunks after which a key with enough matches is done.
SLICES = (1 / 256, 1 / 16)


def tokens(citation: Column) -> Column:
    """Runs of a-z and digits of two characters at least, units shortened."""
    c = F.regexp_replace(F.lower(citation), "[.,;:]", " ")
    for unit, short in UNITS.items():
        c = F.regexp_replace(c, rf"\b{unit}\b", short)
    return F.filter(F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1)


def containing(asked: DataFrame, chunks: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """``(key, x, n)``: the first ``(id, citation)`` and the number of the chunks whose lower-case citation contains each of the key's tokens, of ``asked(key, needles)``.

    A token lies within one word of a citation, so the citations' distinct words are cut to their substrings and meet the tokens by equality. Of a key's tokens the one
    with fewest citations finds its candidates, and the others are looked for in those. Equal citations are one, and only their ids go with their words.
    """
    named = chunks.groupBy(F.lower("citation").alias("low")).agg(F.count("*").alias("rows"), F.min(F.struct("id", "citation")).alias("first")).where("low is not null")
    named = ws.table(named.withColumn("words", F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z0-9]+"), F.lit(0)))), f"citations-{name}")
    each = named.select(F.explode("words").alias("word"), F.col("first.id").alias("of"))  # a citation's first id names it
    word = each.groupBy("word").agg(F.count("*").alias("df"))
    need = asked.select(F.explode("needles").alias("token")).distinct()
    size = F.length("word")
    cut = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda a: F.transform(F.sequence(F.lit(1), size - a + 1), lambda n: F.substring("word", a, n))))
    holds = ws.table(word.select("word", "df", F.explode(F.array_distinct(cut)).alias("token")).join(need, "token").select("token", "word", "df"), f"holds-{name}")
    cost = holds.groupBy("token").agg(F.sum("df").alias("cost"))
    every = asked.select("key", "needles", F.explode("needles").alias("token")).join(cost, "token", "left")
    rare = every.groupBy("key", "needles").agg(F.min_by("token", F.struct(F.coalesce("cost", F.lit(0)), "token")).alias("token"))  # few tokens each
    met = rare.join(holds.select("token", "word"), "token").join(each, "word").select("key", "needles", "of").distinct()
    met = met.join(named.select(F.col("first.id").alias("of"), "low", "rows", "first"), "of").where(F.forall("needles", lambda t: F.contains("low", t)))
    return met.groupBy("key").agg(F.min("first").alias("x"), F.sum("rows").alias("n"))


def first_matches(asked: DataFrame, chunks: DataFrame, ws: Workspace) -> DataFrame:
    """``containing`` with numbers up to ``COUNTED``, for ids that are numbers.

    Chunks are taken in slices of rising ids. A key that has ``COUNTED`` matches in the slices so far is done, as its first match and its number are known, so frequent tokens don't meet the whole corpus; the others go on.
    """
    limits = [float("-inf"), *sorted(set(chunks.approxQuantile("id", list(SLICES), 0.001))), float("inf")]
    so_far = None
    for i, (low, high) in enumerate(zip(limits[:-1], limits[1:], strict=True)):
        left = asked if so_far is None else asked.join(so_far.where(F.col("n") >= COUNTED), "key", "left_anti")
        part = chunks.where((F.col("id") > low) & (F.col("id") <= high)) if i + 2 < len(limits) else chunks.where((F.col("id") > low) | F.col("id").isNull())
        found = containing(left, part, ws, str(i))
        both = found if so_far is None else together([so_far, found]).groupBy("key").agg(F.min("x").alias("x"), F.sum("n").alias("n"))
        so_far = ws.table(both, f"matches-{i}")
    return so_far


def resolve(gold: DataFrame, chunks: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """``(key, status, id, matched_citation, n_candidates)`` of every ``gold(key, citation)`` among ``chunks(id, citation, text)``, which should be the live rows alone, with ids that are numbers.

    MATCHED: the first chunk by id whose citation contains the first ``ALL`` tokens, with the number of such chunks up to ``COUNTED``. Else FUZZY_MATCHED: the best chunk by BM25 of citation and text for
    the first ``ANY`` tokens, ties by id. Else, and for null citations and those without tokens, UNRESOLVED. Equal keys are resolved as one.
    """
    ws = ws or Workspace(gold.sparkSession, "gold")
    asked = ws.table(gold.select("key", tokens(F.coalesce("citation", F.lit(""))).alias("tokens")).dropDuplicates(["key"]), "asked")
    some = asked.where(F.size("tokens") > 0)
    first = first_matches(some.select("key", F.array_distinct(F.slice("tokens", 1, ALL)).alias("needles")), chunks, ws)
    first = first.select("key", F.lit("MATCHED").alias("status"), "x.id", F.col("x.citation").alias("matched_citation"), F.least("n", F.lit(COUNTED)).alias("n_candidates"))
    rest = some.join(first, "key", "left_anti")
    best = retrieve.bm25(rest, chunks, "key", F.slice("tokens", 1, ANY), "id", {"citation": 1.0, "text": 1.0}, 1, ws).select(F.col("query").alias("key"), "id")
    fuzzy = best.join(chunks.select("id", "citation"), "id").select("key", F.lit("FUZZY_MATCHED").alias("status"), "id", F.col("citation").alias("matched_citation"), F.lit(None).cast("long").alias("n_candidates"))
    fuzzy = fuzzy.withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy("matched_citation"))).where("_r = 1").drop("_r")
    return asked.select("key").join(ws.table(first.unionByName(fuzzy), "resolved"), "key", "left").withColumn("status", F.coalesce("status", F.lit("UNRESOLVED")))

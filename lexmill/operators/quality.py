"""Assessment of chunks: defects, advisories, and tables of methods and strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import chunking

# Preferred sizes in tokens, and the least share of a summary's words that its text should have. Fixed values.
BAND, MOST, LEAST, GROUNDED = (200, 800), 1200, 15, 0.15
# Words that a summary shares with any text. Fixed values.
COMMON = (
    "the a an and or of to in for on with by is are be as at that this it from its which may must shall not any all such under where "
    "if when has have was were will can should would there their they been"
).split()
# Ends of sentences and clauses, connectives that leave a condition open, and marks of list items. Fixed values.
SENTENCE_END, CLAUSE_END = r"[.!?\"')\]”’]$", r"[;,]$"
CONNECTIVE = r"(?i)(,\s*(or|and)|\b(unless|provided that|subject to|except where|if))\s*$"
LIST_ITEM = r"(?i)^\s*(\(\s*[a-z0-9ivx]{1,4}\s*\)|[-•*]\s|[a-z]\)\s)"


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def summary_words(c: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z\-]{2,}"), F.lit(0))), F.array(*map(F.lit, COMMON)))


def assess(chunks: DataFrame, text: str = "text", after: str = "after", title: str = "title", summary: str = "summary", topics: str = "topics", concepts: str = "concepts", ordinal: str = "ordinal") -> DataFrame:
    """Adds ``chars``, ``tokens``, ``in_band``, ``grounding``, ``defects`` and ``advisories`` (arrays of names, in a fixed order).

    ``after`` is the text of the next chunk of the segment. Defects are what is wrong for retrieval; advisories may be right, as a short provision is. A sentence is severed only if the next chunk goes on in lower case
    and isn't a list item; otherwise an open end is an advisory. Null texts, titles and summaries count as empty, null or empty arrays as lacking.
    """
    t, following, like = stripped(F.col(text)), stripped(F.col(after)), lambda c, p: F.regexp_like(c, F.lit(p))
    d = chunks.withColumns({"_t": t, "_n": following, "_s": stripped(F.col(summary)), "_h": stripped(F.col(title))})
    d = d.withColumns({"chars": F.length("_t").cast("long"), "tokens": T.tokens_by_length(F.col("_t")), "grounding": F.when((F.col("_s") != "") & (F.col("_t") != ""), T.containment(summary_words(F.col("_s")), summary_words(F.col("_t")))).otherwise(0.0)})
    t, some = F.col("_t"), F.col("_t") != ""
    open_ = some & ~like(t, SENTENCE_END) & ~like(t, CLAUSE_END)
    goes_on = like(F.col("_n"), r"^\p{Ll}") & ~like(F.col("_n"), LIST_ITEM)
    lacks = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    wrong = [
        (~some, "EMPTY_TEXT"), (open_ & goes_on, "SEVERED_SENTENCE"), (some & like(F.right(t, F.lit(40)), CONNECTIVE), "SEVERED_ENUMERATION"), (F.endswith(t, F.lit(":")), "SEVERED_LIST_STEM"),
        (some & like(t, LIST_ITEM) & (F.coalesce(F.col(ordinal), F.lit(1)) > 1), "ORPHAN_LIST_ITEM"), (some & (F.col("tokens") < LEAST), "TOO_SMALL_TO_RETRIEVE"), (F.col("_h") == "", "NO_TITLE"), (F.col("_s") == "", "NO_SUMMARY"),
    ]
    notable = [
        (open_ & ~goes_on, "UNTERMINATED_TAIL"), (some & F.col("tokens").between(LEAST, BAND[0] - 1), "BELOW_PREFERRED_BAND"), (some & (F.col("tokens") > MOST), "ABOVE_PREFERRED_BAND"), (lacks(topics), "NO_TOPICS"),
        (lacks(concepts), "NO_LEGAL_CONCEPTS"), ((F.col("_s") != "") & some & (F.col("grounding") < GROUNDED), "SUMMARY_LOW_GROUNDING"),
    ]
    named = lambda rules: F.filter(F.array(*(F.when(c, name) for c, name in rules)), lambda x: x.isNotNull())
    return d.withColumns({"in_band": F.col("tokens").between(*BAND), "defects": named(wrong), "advisories": named(notable)}).withColumn("grounding", F.round("grounding", 3)).drop("_t", "_n", "_s", "_h")


def table(assessed: DataFrame, by: str) -> DataFrame:
    """``(by, chunks, clean, clean_pct, defects, defects_per_chunk, in_band, mean_tokens, median_tokens)``: methods, domains or strategies side by side; a null name is UNKNOWN."""
    n = F.size("defects")
    g = assessed.groupBy(F.coalesce(F.col(by), F.lit("UNKNOWN")).alias(by)).agg(F.count("*").alias("chunks"), F.sum((n == 0).cast("long")).alias("clean"), F.sum(n).cast("long").alias("defects"), F.sum(F.col("in_band").cast("long")).alias("in_band"), F.avg("tokens").alias("mean"), F.percentile("tokens", F.lit(0.5)).alias("median_tokens"))
    return g.select(by, "chunks", "clean", F.round(100 * F.col("clean") / F.col("chunks"), 1).alias("clean_pct"), "defects", F.round(F.col("defects") / F.col("chunks"), 3).alias("defects_per_chunk"), "in_band", F.round("mean", 1).alias("mean_tokens"), "median_tokens")


def detectors(assessed: DataFrame, by: str, least: int = 10) -> DataFrame:
    """``(by, kind, name, n, share)``: how often each defect and advisory is found in each of the ``by`` with ``least`` chunks."""
    size = assessed.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("all")).where(F.col("all") >= least)
    tag = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    each = assessed.select(by, F.explode(F.concat(tag("defects"), tag("advisories"))).alias("x")).groupBy(by, "x.kind", "x.name").agg(F.count("*").alias("n"))
    return each.join(size, F.col(by).eqNullSafe(F.col("_by"))).select(by, "kind", "name", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def strategies(blocks: DataFrame, key: str, order: str, text: str, budgets: tuple[int, ...] = (400, 800), windows: tuple[int, ...] = (5, 10)) -> DataFrame:
    """``(strategy, key, chunk, text, after)``: the blocks of each document cut by token budgets (a chunk ends once it has them) and into windows of blocks, joined by line ends."""
    held = chunking.ordered(blocks.select(key, order, F.coalesce(F.col(text), F.lit("")).alias("text")), key, order, "text")
    cuts = {f"block_window_{n}": F.transform("blocks", lambda b, i: F.floor(i / n).cast("long")) for n in windows}  # noqa: B023
    out = held.select(key, "blocks", *(v.alias(k) for k, v in cuts.items()))
    for n in budgets:
        start = F.struct(F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("acc"), F.array().cast("array<bigint>").alias("out"))

        def step(a: Column, b: Column) -> Column:
            full = a["acc"] + T.tokens_by_length(b["text"]) >= n  # noqa: B023
            return F.struct((a["g"] + full.cast("long")).alias("g"), F.when(full, F.lit(0).cast("long")).otherwise(a["acc"] + T.tokens_by_length(b["text"])).alias("acc"), F.concat(a["out"], F.array(a["g"])).alias("out"))

        out = out.withColumn(f"fixed_tokens_{n}", F.aggregate("blocks", start, step, lambda a: a["out"]))
    names = [*cuts, *(f"fixed_tokens_{n}" for n in budgets)]
    each = out.select(key, "blocks", F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), F.col(n).alias("g")) for n in names))).alias("s"))
    chunks = F.transform(F.sequence(F.lit(0).cast("long"), F.array_max("s.g")), lambda g: F.array_join(F.transform(F.filter(F.arrays_zip(F.col("blocks").alias("b"), F.col("s.g").alias("g")), lambda x: x["g"] == g), lambda x: x["b"]["text"]), "\n"))
    each = each.select("s.strategy", key, chunks.alias("c"))
    return each.select("strategy", key, "c", F.posexplode("c").alias("chunk", "text")).select("strategy", key, (F.col("chunk") + 1).cast("long").alias("chunk"), "text", F.get("c", F.col("chunk") + 1).alias("after"))

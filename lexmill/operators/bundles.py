"""Evidence bundles: context under a budget, the best coverage attainable, and payloads for judges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAW, OTHER = "legislation", "other"


def assemble(evidence: DataFrame, k: int = 10, budget: int = 18000, two_lanes: bool = True) -> DataFrame:
    """``(query, place, rank)`` of the whole items that a context takes, of ``(query, rank, lane, chars, supports)``.

    First each lane up to its half of ``k`` (the larger half for legislation), then any; at each step the item that adds most
    requirements, then the best rank, among those that still fit. Items are never cut; one that doesn't fit is skipped. With two
    lanes legislation is shown first. Null chars count as 0, null supports as none; a query's candidates are the bound of a row.
    """
    if k < 1 or budget < 1:
        raise ValueError("a context needs room")
    no_names, no_ranks = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    item = F.struct(F.col("rank").cast("long").alias("rank"), (F.col("lane") == LAW).alias("law"), F.coalesce(F.col("chars"), F.lit(0)).cast("long").alias("chars"), F.coalesce("supports", no_names).alias("supports"))
    e = evidence.groupBy("query").agg(F.array_sort(F.collect_list(item)).alias("c"))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("used"), zero.alias("law"), zero.alias("other"), no_names.alias("covered"), no_ranks.alias("law_ranks"), no_ranks.alias("other_ranks"))
    half = {True: (k + 1) // 2, False: k // 2}

    def step(a: Column, phase: Column) -> Column:
        def fits(x: Column) -> Column:
            free = F.when(x["law"], a["law"] < half[True]).otherwise(a["other"] < half[False])
            taken = F.array_contains(a["law_ranks"], x["rank"]) | F.array_contains(a["other_ranks"], x["rank"])
            return ~taken & (a["law"] + a["other"] < k) & (a["used"] + x["chars"] <= budget) & (free | (phase == 1))

        value = lambda x: F.struct(F.size(F.array_except(x["supports"], a["covered"])).alias("new"), (-x["rank"]).alias("back"), x.alias("x"))
        best = F.array_max(F.transform(F.filter("c", fits), value))["x"]
        add = lambda ranks, law: F.when(best["law"] == law, F.concat(ranks, F.array(best["rank"]))).otherwise(ranks)
        after = F.struct(
            (a["used"] + best["chars"]).alias("used"), (a["law"] + best["law"].cast("long")).alias("law"), (a["other"] + (~best["law"]).cast("long")).alias("other"),
            F.array_union(a["covered"], best["supports"]).alias("covered"), add(a["law_ranks"], True).alias("law_ranks"), add(a["other_ranks"], False).alias("other_ranks"),
        )
        return F.when(best.isNull(), a).otherwise(after)

    phases = F.array(*[F.lit(0)] * (k if two_lanes else 0), *[F.lit(1)] * k)
    shown = lambda a: F.concat(a["law_ranks"], a["other_ranks"])
    picked = e.select("query", F.posexplode(F.aggregate(phases, start, step, shown)).alias("place", "rank"))
    if not two_lanes:
        picked = picked.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("rank")) - 1)
    return picked.select("query", (F.col("place") + 1).cast("long").alias("place"), "rank")


def best_cover(items: Iterable[tuple[int, int]], k: int, budget: int) -> tuple[int, int, int]:
    """The most requirements that ``k`` items cover within the budget, with the fewest items and characters: exact.

    Items are ``(bits of requirements, characters)``. Of all choices with the same bits and count only the shortest matters, so
    there are at most 2^requirements * (k + 1) states, however many items there are.
    """
    short = {(0, 0): 0}
    for mask, chars in items:
        for (have, n), used in list(short.items()):
            key, total = (have | mask, n + 1), used + chars
            if n < k and key[0] != have and total <= budget and total < short.get(key, budget + 1):
                short[key] = total
    return min(((-bin(m).count("1"), n, used) for (m, n), used in short.items()))


def coverage_bound(candidates: DataFrame, requirements: DataFrame, k: int = 10, budget: int = 18000, most: int = 16) -> DataFrame:
    """``(query, requirements, covered, coverage, items, chars)``: what a perfect choice of judged candidates would cover.

    Candidates are ``(query, id, chars, supports)``; requirements ``(query, requirement)``, up to ``most`` of a query. Rows of
    a query without candidates have coverage 0. Candidates that cover nothing are left out before the shuffle.
    """
    r = requirements.select("query", "requirement").distinct().groupBy("query").agg(F.array_sort(F.collect_set("requirement")).alias("names"))
    r = r.withColumn("names", F.when(F.size("names") <= most, F.col("names")).otherwise(F.raise_error(F.lit(f"more than {most} requirements"))))
    bits = F.aggregate("supports", F.lit(0).cast("long"), lambda m, s: m.bitwiseOR(F.when(F.array_contains("names", s), F.pow(F.lit(2), F.array_position("names", s) - 1).cast("long")).otherwise(0)))
    rows = r.join(candidates.select("query", "chars", F.coalesce("supports", F.array().cast("array<string>")).alias("supports")), "query").select("query", bits.alias("mask"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))
    rows = rows.where("mask <> 0").groupBy("query", "mask").agg(F.min("chars").alias("chars"))  # of items with the same bits only the shortest counts

    own = rows.groupBy("query").agg(F.collect_list("mask").alias("masks"), F.collect_list("chars").alias("chars"))  # at most 2^requirements each

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [best_cover(zip(m.tolist(), c.tolist(), strict=True), k, budget) for m, c in zip(f["masks"], f["chars"], strict=True)]
            yield pd.DataFrame({"query": f["query"], "covered": [-x[0] for x in found], "items": [x[1] for x in found], "chars": [x[2] for x in found]})

    kind = rows.schema["query"].dataType.simpleString()
    best = own.mapInPandas(solve, f"query {kind}, covered long, items long, chars long")
    out = r.select("query", F.size("names").cast("long").alias("requirements")).join(best, "query", "left").fillna(0, ["covered", "items", "chars"])
    return out.withColumn("coverage", F.round(F.col("covered") / F.col("requirements"), 6))


def blinded(evidence: DataFrame, query: str, text: str, shown: list[str]) -> DataFrame:
    """What a judge sees: only the columns ``shown``, in the order of the texts' digests, under the aliases C1, C2 and so on."""
    e = evidence.withColumn("_digest", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    tie = F.xxhash64(*[F.col(c) for c in shown])
    e = e.withColumn("alias", F.concat(F.lit("C"), F.row_number().over(W.partitionBy(query).orderBy("_digest", tie)).cast("string")))
    return e.select(query, "alias", *[c for c in shown if c != query])

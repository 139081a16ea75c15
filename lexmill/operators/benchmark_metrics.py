"""Metrics of a static benchmark: configurations side by side over scenarios with gold requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.evaluate import gain

#: Rows that are graded, rows of the shorter coverage, the grade of a hit, and the role whose scenarios need a binding first row. Fixed values.
TOP, SHORT, HIT, BINDING_ROLE = 10, 5, 2, "binding_rule"
MEANS = ("ndcg10", "hit10", "mrr", "coverage5", "coverage10", "complete10", "regime_error")


def per_scenario(runs: DataFrame, qrels: DataFrame, needs: DataFrame) -> DataFrame:
    """A row for each configuration and scenario: ``(config, query, results, unjudged, ndcg10, hit10, mrr, coverage5, coverage10, complete10, authority_first, regime_error)``.

    ``runs(config, query, id, rank)``; ``qrels(query, id, grade, supports, binding, applicable)``, one row a query and id; ``needs(query, requirement, threshold, role)``, whose queries are the scenarios. A row without a label or grade counts as 0 and as unjudged.
    The ideal order is that of the run's own grades. A requirement is met by the first row that supports it with its threshold's grade. ``ndcg10`` is null without results; ``authority_first`` is null where the first row has no label, else it must be binding if a
    requirement has the binding role. A regime error is a row of grade 2 or more that doesn't apply.
    """
    scenario = needs.groupBy("query").agg(F.count("*").alias("total"), F.max((F.col("role") == BINDING_ROLE).cast("int")).alias("binds"))
    each = scenario.crossJoin(F.broadcast(runs.select("config").distinct()))  # a few configurations
    judged = runs.join(qrels.withColumn("_held", F.lit(True)), ["query", "id"], "left")
    grade, top = F.coalesce("grade", F.lit(0)), F.col("rank") <= TOP
    ranks = judged.groupBy("config", "query").agg(
        F.count("*").alias("results"), F.sum((top & F.col("grade").isNull()).cast("long")).alias("unjudged"), F.sum(F.when(top, gain(grade, F.col("rank")))).alias("dcg"), F.sort_array(F.collect_list(F.when(top, grade)), asc=False).alias("grades"),
        F.max((top & (grade >= HIT)).cast("int")).alias("hit"), F.max((top & (F.col("applicable") == F.lit(False)) & (grade >= HIT)).cast("int")).alias("wrong"), F.max(F.when((F.col("rank") == 1) & F.col("_held"), F.coalesce("binding", F.lit(False)).cast("int"))).alias("first_binds"),
    )
    ideal = F.aggregate(F.transform("grades", lambda g, i: gain(g, i + 1)), F.lit(0.0), lambda s, x: s + x)
    met = judged.select("config", "query", "rank", "grade", F.explode("supports").alias("requirement")).join(needs, ["query", "requirement"]).where(F.col("grade") >= F.col("threshold"))
    met = met.groupBy("config", "query", "requirement").agg(F.min("rank").alias("first")).groupBy("config", "query").agg(F.min("first").alias("first"), F.sum((F.col("first") <= SHORT).cast("long")).alias("m5"), F.sum((F.col("first") <= TOP).cast("long")).alias("m10"))
    x = each.join(ranks, ["config", "query"], "left").join(met, ["config", "query"], "left")
    share = lambda m: F.coalesce(m, F.lit(0)) / F.col("total")
    return x.select(
        "config", "query", F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("unjudged", F.lit(0)).alias("unjudged"), F.when(F.size("grades") > 0, F.when(ideal > 0, F.round(F.col("dcg") / ideal, 4)).otherwise(0.0)).alias("ndcg10"),
        F.coalesce("hit", F.lit(0)).cast("long").alias("hit10"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr"), F.round(share("m5"), 6).alias("coverage5"), F.round(share("m10"), 6).alias("coverage10"),
        (F.coalesce("m10", F.lit(0)) == F.col("total")).cast("long").alias("complete10"), F.when(F.col("first_binds").isNotNull(), F.when(F.col("binds") == 1, F.col("first_binds")).otherwise(1)).cast("long").alias("authority_first"), F.coalesce("wrong", F.lit(0)).cast("long").alias("regime_error"),
    )


def by_configuration(scenarios: DataFrame) -> DataFrame:
    """``(config, n, ...)``: the means of each metric over the scenarios where it is defined, from exact sums, as a mean may end in a five that is rounded."""
    return scenarios.groupBy("config").agg(F.count("*").alias("n"), *(F.round(F.sum(F.col(m).cast("decimal(18,6)")).cast("double") / F.count(m), 4).alias(m) for m in MEANS))

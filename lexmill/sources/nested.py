"""Text of nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.plans.checkpoint import Workspace

# Keys whose values aren't text. Fixed values.
SKIPPED = ("image", "image_url", "api_url")


def strings(df: DataFrame, key: str, document: Column, ws: Workspace | None = None) -> DataFrame:
    """``(key, text)``: all strings of a JSON document of any depth, joined by blanks; objects in the order of their keys, arrays in their own.

    Values of skipped keys (of any case) and what is below them go; numbers, booleans and nulls aren't text. One level is opened in a round, and what is closed goes to the next, so the rounds are as many as the deepest document's levels.
    Null documents, those that aren't JSON and those without strings give ''. Keys are expected to be unique.
    """
    ws = ws or Workspace(df.sparkSession, "nested")
    level = df.select(F.col(key).alias("key"), F.array().cast("array<int>").alias("path"), F.try_parse_json(document).alias("v"))
    parts, k = [], 0
    while True:
        kind = F.schema_of_variant("v")
        level = ws.table(level.withColumn("kind", F.when(kind.startswith("OBJECT"), 2).when(kind.startswith("ARRAY"), 2).when(kind == "STRING", 1)).where("kind is not null").select("key", "path", "kind", F.when(F.col("kind") == 1, F.variant_get("v", "$", "string")).alias("s"), F.when(F.col("kind") == 2, F.to_json("v")).alias("json")), f"level-{k}")
        parts.append(level.where("kind = 1").select("key", "path", "s"))
        shut = level.where("kind = 2").select("key", "path", F.parse_json("json").alias("v"))
        if not level.where("kind = 2").limit(1).count():
            break
        inner = df.sparkSession.tvf.variant_explode(F.col("v").outer())
        opened = shut.lateralJoin(inner.select(F.col("pos"), F.col("key").alias("name"), F.col("value")))
        level = opened.where(F.col("name").isNull() | ~F.lower("name").isin(*SKIPPED)).select("key", F.concat("path", F.array("pos")).alias("path"), F.col("value").alias("v"))
        k += 1
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    text = ws.table(found, "strings").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "s"))), lambda x: x["s"]), " ").alias("text"))
    return df.select(F.col(key)).join(text, F.col(key) == F.col("key"), "left").select(F.col(key), F.coalesce("text", F.lit("")).alias("text"))

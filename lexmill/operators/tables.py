"""Keyed tables: first or last writer wins, updates, groups of duplicates, ordered picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in an order that must be total."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def insert_or_ignore(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return pick(rows, keys, *order)


def upsert(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    return pick(rows, keys, F.desc(sequence))


def keyed_update(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    new = updates.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    return df.join(new, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


def live(df: DataFrame) -> DataFrame:
    """Rows that are neither superseded nor filtered out."""
    return df.where((F.coalesce(F.col("superseded_by").cast("string"), F.lit("")) == "") & ~F.coalesce(F.col("filtered_out").cast("boolean"), F.lit(False)))


def unique_or_null(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that name one value; ambiguous keys go."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n")).where("_n = 1").drop("_n")


def index_percentile(df: DataFrame, value: str, shares: dict[str, float], key: str | None = None) -> DataFrame:
    """Percentiles as the element at floor(n * share), ties by value."""
    by = [key] if key else []
    w = W.partitionBy(*by)
    r = df.select(*by, value, F.row_number().over(w.orderBy(value)).alias("_r"), F.count("*").over(w).alias("_n"))
    return r.groupBy(*by).agg(*(F.max(F.when(F.col("_r") == F.floor(F.col("_n") * p) + 1, F.col(value))).alias(name) for name, p in shares.items()))

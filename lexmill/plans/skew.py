"""Joins on keys that a large part of the rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so that there are at most 1 / SHARE hot keys, and from LEAST rows on.
SHARE, LEAST = 0.001, 256


def hot_join(left: DataFrame, right: DataFrame, key: str, of: str, rows: str, spread: str) -> DataFrame:
    """Left join of ``left`` with ``right``, which has a row for each ``of`` and the number of ``left`` rows that have it.

    The rows of hot keys are dealt by a hash of ``spread`` instead of the key, as are null keys, and get their match from a broadcast of the at most
    1 / SHARE hot rows of ``right``; all others meet by the key. Adds the columns of ``right`` but ``of`` and ``rows``.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    limit = max(LEAST, SHARE * total)
    cols = [c for c in right.columns if c not in (of, rows)]
    hot = right.where(F.col(rows) > limit).select(F.col(of).alias("_hot"), F.struct(*cols).alias("_mine"))
    rest = right.where(F.col(rows) <= limit).select(F.col(of).alias("_of"), F.lit(0).alias("_at"), F.struct(*cols).alias("_other"))
    d = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    alone = F.col("_hot").isNotNull() | F.col(key).isNull()
    d = d.withColumn("_deal", F.when(alone, 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).otherwise(0).cast("int"))
    d = d.join(rest.hint("merge"), (F.col(key) == F.col("_of")) & (F.col("_deal") == F.col("_at")), "left")
    return d.select(*left.columns, *(F.coalesce(F.col(f"_mine.{c}"), F.col(f"_other.{c}")).alias(c) for c in cols))

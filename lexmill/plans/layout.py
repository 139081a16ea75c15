"""Physical layout of inputs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes for each core up to which an input is dealt out anew.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals a small input, which may be one row group of one file, to all cores before costly expressions.

    The optimiser's size of the plan decides: a large input has as many splits as it needs and isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL else df


def together(parts: Iterable[DataFrame]) -> DataFrame:
    """A union that claims no partitioning, for grouping and joining afterwards.

    Spark 4.1 lets a union keep a partitioning that all its inputs share, groups above it without a shuffle and leaves out a repartition by the same keys; adaptive execution then coalesces the inputs
    apart, now and then, and rows of one key stay apart. An input of no rows and no partitioning keeps the union from claiming one.
    """
    parts = list(parts)
    nobody = parts[0].sparkSession.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in parts[0].schema.fields))
    return reduce(DataFrame.unionByName, [*parts, nobody])

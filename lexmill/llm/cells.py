"""Comparing the members of groups of any size in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.textkit import give_back
from lexmill.plans.skew import hot_join


def in_cells(members: DataFrame, group: str, key: str, weight, limit: int, partitions: int | None = None) -> DataFrame:
    """Deals groups out so that any two members of a group meet: adds ``cell`` and ``side``, sorted by group and cell.

    A group whose weights sum to ``limit`` at most is one cell. A larger one is dealt by a hash of the key into blocks
    of about that weight, and each two blocks are a cell; ``side`` tells them apart. Nothing is left out and no task gathers a
    whole group.
    """
    sums = members.groupBy(group).agg(F.sum(weight).alias("_w"), F.count("*").alias("_n")).where("_n > 1")
    sums = sums.select(F.col(group).alias("_g"), F.ceil(F.col("_w") / limit).cast("int").alias("_blocks"), "_n")
    m = hot_join(members, sums, group, "_g", "_n", key).where("_blocks is not null").withColumn("_b", F.pmod(F.xxhash64(key, F.lit("cell")), F.col("_blocks")).cast("int"))
    m = m.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    m = m.withColumn("cell", F.least("_b", "_x") * F.col("_blocks") + F.greatest("_b", "_x")).withColumn("side", F.when(F.col("_x") == F.col("_b"), 0).when(F.col("_b") < F.col("_x"), 1).otherwise(2)).drop("_b", "_x", "_blocks")
    m = m.repartition(partitions, group, "cell") if partitions else m.repartition(group, "cell")
    return m.sortWithinPartitions(group, "cell")


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(c[a] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    give_back()


class Forest:
    """Union-find over the members of a cell; ``edges`` has the links that joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, a: int, b: int) -> None:
        x, y = self.root[a], self.root[b]
        if x != y:
            self.root[self.root == y] = x
            self.edges.append((a, b))

"""A stored inverted-file index over vectors: cells around centroids, every row posted, several cells probed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.retrieve import nearest, ranked
from lexmill.plans.checkpoint import Workspace

#: Rows that the centroids are fitted on, and rows whose neighbours tell how many cells must be probed. Bounds of what the driver holds.
SAMPLE, TUNED = 20_000, 200
#: Vectors of a stored block, stored blocks and query vectors that one task multiplies.
BLOCK, BLOCKS, ASKED = 2048, 8, 1024
ROUNDS, MOST_CELLS = 12, 4096


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means over the sample's unit vectors, from evenly spaced rows; a cell that loses its rows stays where it was."""
    c = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(ROUNDS):
        near = np.concatenate([(sample[a : a + BLOCK] @ c.T).argmax(1) for a in range(0, len(sample), BLOCK)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.sqrt((total * total).sum(1))
        c = np.where(norm[:, None] > 0, total / np.where(norm > 0, norm, 1)[:, None], c)
    return c


def usable(vectors: DataFrame, key: str) -> DataFrame:
    """``(key, vector)``, the vectors as doubles: no nulls, no NaN or infinity, not all zeros; others are nobody's neighbours."""
    v = vectors.select(F.col(key).cast("long").alias(key), F.col("vector").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col(key).isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def with_cells(vectors: DataFrame, key: str, c: np.ndarray, count: int) -> DataFrame:
    """``(key, vector, cells)``: the ``count`` nearest cells of each vector, nearest first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                near = np.argsort(-(unit(matrix(part.column(1))) @ c.T), 1, kind="stable")[:, :count].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(near), pa.list_(pa.int32()))], names=[key, "vector", "cells"])

    return vectors.mapInArrow(work, f"{key} long, vector array<double>, cells array<int>")


def blocks_of(rows: DataFrame, key: str, groups: list[str], size: int, dtype: type = float) -> DataFrame:
    """Sorted rows packed to ``(groups, keys, matrix)``: vectors of up to ``size`` rows of one group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            m = matrix(t["vector"].combine_chunks()).astype(dtype)
            first = [pa.array([t[g][0].as_py()], pa.int32()) for g in groups]
            held.clear()
            return pa.RecordBatch.from_arrays([*first, pa.array([len(m)], pa.int32()), pa.array([t[key].to_numpy().tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=[*groups, "n", "keys", "matrix"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(batch.schema.get_field_index(g)).to_numpy() for g in groups], 1)
            cuts = np.r_[0, np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1, batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and any(held[0][g][0].as_py() != batch[g][int(a)].as_py() for g in groups):
                    yield flush()
                while a < b:
                    room = size - sum(x.num_rows for x in held)
                    held.append(batch.slice(a, min(room, b - a)))
                    a += min(room, b - a)
                    if sum(x.num_rows for x in held) == size:
                        yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(work, ", ".join(f"{g} int" for g in groups) + ", n int, keys binary, matrix binary")


def write_index(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, k: int = 10, target: float = 0.95, tuned: int = TUNED) -> None:
    """Stores the index of ``(id, vector)`` below ``path``: ``blocks``, every usable row in the cell of its nearest centroid, and ``cells``, a row for each.

    Centroids are fitted on the ``sample`` rows with the least hashes of their ids. There are ``cells`` of them, by default about the root of the number of rows and
    ``MOST_CELLS`` at most. How many cells a search probes is measured: for the ``tuned`` rows with the next hashes, the exact ``k`` neighbours among all rows, and the least number of
    cells that hold ``target`` of them. A cell of any size is dealt to as many tasks and files as it needs.
    """
    spark, ws = vectors.sparkSession, Workspace(vectors.sparkSession, "vectors")
    narrow = vectors.schema["vector"].dataType.simpleString() == "array<float>"  # stored as such; products are of doubles
    rows = ws.table(usable(vectors, "id"), "rows")
    picked = rows.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(sample + tuned).toPandas()
    m = unit(np.array(picked["vector"].tolist(), float)) if len(picked) else np.zeros((0, 1))
    c = centroids(m[:sample], cells or min(MOST_CELLS, max(1, int(rows.count() ** 0.5)))) if len(m) else m
    posted = ws.table(with_cells(rows, "id", c, 1).select("id", "vector", F.element_at("cells", 1).alias("cell")), "posted")
    sizes = posted.groupBy("cell").agg(F.count("*").alias("rows"))
    sizes = ws.table(sizes.withColumn("parts", F.ceil(F.col("rows") / (BLOCK * BLOCKS)).cast("int")), "sizes")  # at most MOST_CELLS rows
    dealt = posted.join(F.broadcast(sizes.drop("rows")), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").select("cell", "part", "id", "vector")
    blocks_of(dealt, "id", ["cell", "part"], BLOCK, np.float32 if narrow else float).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")

    probes = 1
    if len(m):
        own = spark.createDataFrame([(int(i),) for i in picked["id"][-tuned:]], "query long").distinct()
        asked = ws.table(posted.join(F.broadcast(own), F.col("id") == F.col("query")).select("query", "vector").dropDuplicates(["query"]), "asked")
        true = nearest(asked, posted.select("id", "vector"), k).select("query", "id").join(posted.select("id", "cell"), "id")
        order = with_cells(asked, "query", c, len(c)).select("query", F.posexplode("cells").alias("place", "cell"))
        places = sorted(r.place for r in true.join(order, ["query", "cell"]).select("place").collect())  # tuned * k rows
        probes = int(places[int(np.ceil(target * len(places))) - 1]) + 1 if places else 1
    stored = spark.createDataFrame([(i, x.tolist(), probes, narrow) for i, x in enumerate(c)], "cell int, vector array<double>, probes int, narrow boolean")
    stored.join(sizes, "cell", "left").na.fill(0, ["rows", "parts"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def search_index(queries: DataFrame, path: str, k: int, probes: int | None = None) -> DataFrame:
    """Nearest ``k`` by cosine among the rows of the probed cells: ``(query, id, score, rank)``, without the query itself; ``probes`` of 0 probes all, none gives the stored number.

    Queries are dealt to their cells and packed; a cell's blocks meet its packed queries, large cells in parts. Only the best ``k`` of a block and query go on. Folders of cells that nobody asks for aren't
    read. Scores are rounded to five places before ranking, ties go by id.
    """
    spark = queries.sparkSession
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most MOST_CELLS rows
    if not cells:
        return spark.createDataFrame([], "query long, id long, score double, rank long")
    c, stored = np.array([r.vector for r in cells]), np.float32 if cells[0].narrow else float
    count = len(c) if probes == 0 else min(len(c), probes or cells[0].probes)
    asked = with_cells(usable(queries, "query"), "query", c, count).select("query", "vector", F.explode("cells").alias("cell"))
    held = spark.createDataFrame([(r.cell, r.parts) for r in cells if r.parts], "of int, parts int")
    asked = asked.join(F.broadcast(held), F.col("cell") == F.col("of"))
    batch = Workspace(spark, "asked").table(asked.withColumn("batch", F.pmod(F.xxhash64("query"), F.lit(1 << 16)).cast("int")), "asked")
    sizes = batch.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("batches"))
    batch = batch.join(F.broadcast(sizes), "cell").withColumn("batch", F.pmod("batch", "batches").cast("int")).repartition("cell", "batch").sortWithinPartitions("cell", "batch")
    packed = blocks_of(batch.select("cell", "batch", "query", "vector"), "query", ["cell", "batch"], ASKED).select("cell", F.col("keys").alias("asked"), F.col("matrix").alias("wanted"))
    packed = packed.join(F.broadcast(held), F.col("cell") == F.col("of")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("of", "parts")
    rows = spark.read.schema("part int, n int, keys binary, matrix binary, cell int").parquet(f"{path}/blocks")
    rows = rows.join(F.broadcast(sizes.select(F.col("cell").alias("wanted_cell"))), F.col("cell") == F.col("wanted_cell"), "left_semi")  # at most MOST_CELLS rows; prunes folders
    pairs = rows.join(packed, ["cell", "part"]).select("keys", "matrix", "asked", "wanted")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, own, query, wanted = (np.frombuffer(b.column(x)[i].as_py(), t) for x, t in enumerate((np.int64, stored, np.int64, float)))
                score = np.round(unit(wanted.reshape(len(query), -1)) @ unit(own.reshape(len(ids), -1).astype(float)).T, 5)
                score[query[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score))[:, :k]
                value = np.take_along_axis(score, order, 1)
                keep = np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(query[:, None], order.shape)[keep]), pa.array(ids[order][keep]), pa.array(value[keep])], names=["query", "id", "score"])

    found = pairs.mapInArrow(work, "query long, id long, score double")
    return ranked(found.select("query", "id", F.round("score", 5).alias("score")), "score").where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(query, hits, wanted, recall)``: how many of each query's exact neighbours were found; queries without any are left out."""
    both = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    each = both.groupBy("query").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))
    return each.withColumn("recall", F.round(F.col("hits") / F.col("wanted"), 6))

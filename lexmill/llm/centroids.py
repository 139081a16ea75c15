"""Clustering of integer vectors around centroids: float32 screening with rounding-error intervals, exact integers where they overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.plans.checkpoint import Workspace
from lexmill.plans.layout import spread

#: Integers below this size keep every squared distance of up to 64 components below 2^63.
LIMIT = 1 << 27
#: Vectors that a worker compares at once.
BLOCK = 8192


def intervals(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above |c|^2 - 2 x.c for every vector (rows) and centroid (columns), from one float32 matrix product.

    Rounding both factors to float32 and summing d products in any order, fused or not, is off by at most g * sum |x_i c_i| with
    g = (d + 2) u / (1 - (d + 2) u) and u = 2^-24; the sum is at most |x| |c|. Integers neither underflow nor, below ``LIMIT``, overflow there.
    What is done in float64 afterwards is off by less than 2^-48 of the terms' sizes, which the bounds add.
    """
    d = x.shape[1]
    u = (d + 2) * 2.0**-24
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    own = np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None]
    square = (centroids.astype(np.float64) ** 2).sum(1)[None, :]
    reach = own * np.sqrt(square)
    slack = 2 * u / (1 - u) * reach * (1 + 2.0**-40) + 2.0**-48 * (square + 4 * reach)
    middle = square - 2 * product
    return middle - slack, middle + slack


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``(number of the nearest centroid, squared distance, pairs compared as integers beside the nearest)``; ties go to the smaller number.

    A centroid whose interval begins above another's end can't be nearest. Where one is left it is taken; where several are, all of them are compared as
    exact 64-bit integers.
    """
    low, high = intervals(x, centroids)
    open_ = low <= high.min(1, keepdims=True)
    best = np.argmax(open_, 1)
    unsure = np.flatnonzero(open_.sum(1) > 1)
    row, number = np.nonzero(open_[unsure])
    extra = len(row)
    if extra:
        exact = np.concatenate([((x[unsure[row[a : a + BLOCK]]] - centroids[number[a : a + BLOCK]]) ** 2).sum(1) for a in range(0, extra, BLOCK)])
        order = np.lexsort((number, exact, row))
        first = np.r_[True, row[order][1:] != row[order][:-1]]
        best[unsure] = number[order][first]
    return best, ((x - centroids[best]) ** 2).sum(1), extra


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``(id, v)``: integers floor(scale * x) of the vectors that count."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    whole = (F.size(vector_col) == dims) & F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float(LIMIT // scale)))
    return spread(df.select(id_col, vector_col)).where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<int>").alias("v"))


def order_hash(id_: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.lit(""))), 256)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column(0).slice(a, BLOCK), dims)
                best, _, _ = assign(x, centroids)
                order = np.argsort(best, kind="stable")
                cut = np.flatnonzero(np.r_[True, best[order][1:] != best[order][:-1]])
                total[best[order][cut]] += np.add.reduceat(x[order], cut, axis=0)
                count += np.bincount(best, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cluster", "rows", "sums"])

    return work


def _nearest(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                best, distance, _ = assign(_matrix(batch.column(1).slice(a, BLOCK), centroids.shape[1]), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, BLOCK), pa.array(best.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return work


def fit(kept: DataFrame, dims: int, clusters: int, rounds: int, seed: str) -> np.ndarray:
    """Centroids after ``rounds`` rounds over all of ``kept(id, v)``.

    The first are the vectors with the smallest hashes of their ids, equal ids by their components. Every task sums its own vectors by centroid, and Spark sums those;
    the driver gets the centroids' sums alone, ``clusters`` times ``dims`` numbers.
    """
    first = kept.select(order_hash(F.col("id"), seed).alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        part = kept.select("v").mapInArrow(_sums(centroids), "cluster int, rows long, sums array<long>")
        each = part.select("cluster", "rows", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("rows").alias("rows"), F.sum("s").alias("s"))
        moved = centroids.copy()
        for r in each.collect():  # clusters * dims rows
            moved[r.cluster, r.i] = r.s // r.rows
        if (moved == centroids).all():
            break  # further rounds would change nothing
        centroids = moved
    return centroids


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, clusters: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2:", ws: Workspace | None = None) -> DataFrame:
    """Nearest centroid of every vector after Lloyd rounds in exact integers: ``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``.

    Vectors of ``dims`` components, none null, NaN or infinite, count, as integers floor(scale * x); all others, also null and empty ones, get no row. Neither do
    vectors with a component of 2^27 / scale or more, whose squared distances need not fit a long (at most 64 ``dims`` are taken). The first
    centroids are the vectors with the least SHA-256 of ``seed`` and their id (a null id counts as no text, equal ids go by their components); with fewer vectors there are fewer centroids.
    Each round gives every vector to the nearest centroid, the smaller number of equally near ones, and moves centroids to their vectors' floored means; those without
    vectors stay. Rows that repeat count as often as they occur and get a row each; an empty table gives an empty one; further columns are ignored. ``id`` keeps the name ``id_col``.
    Sums of distances beyond a long are null.
    """
    if not 0 < dims <= 64:
        raise ValueError("1 to 64 components")
    ws = ws or Workspace(df.sparkSession, "centroids")
    kept = ws.table(kept_vectors(df, id_col, vector_col, dims, scale), "kept")
    centroids = fit(kept, dims, clusters, rounds, seed)
    if not len(centroids):
        centroids = np.zeros((1, dims), np.int64)  # no vector will ask for it
    near = ws.table(kept.mapInArrow(_nearest(centroids), "id long, cluster int, distance long"), "near")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    each = near.groupBy("cluster").agg(wide.alias("own"))
    names = df.sparkSession.createDataFrame([(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)], "number int, components string")
    each = each.crossJoin(each.agg(F.sum("own").alias("all"))).join(F.broadcast(names), F.col("cluster") == F.col("number"))  # one row; a row a centroid
    each = each.select(F.col("cluster").alias("_c"), F.col("own").try_cast("long").alias("cluster_inertia"), F.col("all").try_cast("long").alias("inertia"), F.sha2("components", 256).alias("centroid_sha256"))
    return near.join(F.broadcast(each), F.col("cluster") == F.col("_c")).select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

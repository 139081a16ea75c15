"""Exact duplicates through a log-structured merge index of content digests."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.cells import groups
from lexmill.llm.textkit import SPACES, ordered_id, own_id
from lexmill.plans.checkpoint import Workspace
from lexmill.plans.skew import hot_join

RUN_SCHEMA = "run long, digest string, rank long, id long, n long"
#: Digests that a task's memtable holds before it is flushed as a sorted run.
MEMTABLE = 50_000
#: Runs that one merge takes together.
FANOUT = 64
#: Digests of one part of the index, which has a filter of its own; bits of a filter for each digest, places that a digest sets.
PART, BITS, PLACES = 100_000, 12, 6
#: Bytes of all filters up to which they are sent to every task; beyond, rows meet the index without them, with the same result.
FILTERS = 32 << 20
#: Copies of one row that one task compares with it, about.
SALT_ROWS = 256


def normal(text: str = "text"):
    """Texts are equal when these are: white space is deleted, null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")


def flush_runs(entries: DataFrame, memtable: int = MEMTABLE) -> DataFrame:
    """Each task fills memtables and flushes them as runs sorted by digest.

    An entry of a run is a digest with its best row (lowest ``rank``, then lowest id) and the number of
    rows met; the memtable's bound is its memory bound, and copies met in one memtable become one entry.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, tuple[int, int, int]] = {}
        number = (TaskContext.get().partitionId() << 32) - 1

        def flushed():
            nonlocal number
            number += 1
            keys = sorted(table)
            rows = [table[k] for k in keys]
            table.clear()
            return pa.RecordBatch.from_arrays([pa.array([number] * len(keys), pa.int64()), pa.array(keys, pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], names=["run", "digest", "rank", "id", "n"])

        for batch in batches:
            for digest, rank, row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                best = table.get(digest)
                if best is None:
                    if len(table) >= memtable:
                        yield flushed()
                    table[digest] = (rank, row, 1)
                else:
                    table[digest] = (*min(best[:2], (rank, row)), best[2] + 1)
        if table:
            yield flushed()

    return entries.select("digest", "rank", "id").mapInArrow(work, RUN_SCHEMA)


def merge_level(runs: DataFrame, fanout: int) -> DataFrame:
    """One level: each ``fanout`` runs become one, merged by digest; the smallest (rank, id) of a digest stays, counts add up."""
    of = runs.select("run").distinct().withColumn("to", F.floor((F.row_number().over(W.orderBy("run")) - 1) / fanout))
    merged = runs.join(F.broadcast(of), "run").groupBy("to", "digest").agg(F.min(F.struct("rank", "id")).alias("best"), F.sum("n").alias("n"))
    return merged.select(F.col("to").alias("run"), "digest", "best.rank", "best.id", "n").sortWithinPartitions("run", "digest")


def compact(runs: DataFrame, ws: Workspace, fanout: int = FANOUT) -> DataFrame:
    """Merges runs level by level, each a written table, until one run holds every digest once, with its smallest (rank, id). The number of runs is rows by memtable."""
    level = 0
    while runs.select("run").distinct().count() > 1:
        level += 1
        merged = ws.table(merge_level(runs, fanout), f"level-{level}")
        ws.drop(f"level-{level - 1}" if level > 1 else "runs")
        runs = merged
    return runs.drop("run")


def _places(digests: list[str], bits: int) -> np.ndarray:
    """The places of each digest in a filter of so many bits: steps of one half of its text by the other."""
    h = np.array([zlib.crc32(x.encode()) | zlib.crc32(x[::-1].encode()) << 32 for x in digests], np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(PLACES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


def part_of(digest: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(parts)).cast("int")


def filters(index: DataFrame, parts: int) -> DataFrame:
    """``(part, bits)``: a Bloom filter of each part of the index."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ("part",)):
            bits = np.zeros(8 * -(-g.num_rows * BITS // 8), np.uint8)
            bits[_places(g["digest"].to_pylist(), len(bits)).ravel()] = 1
            yield pa.RecordBatch.from_arrays([pa.array([g["part"][0].as_py()], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])

    return index.select(part_of("digest", parts).alias("part"), "digest").repartition("part").sortWithinPartitions("part").mapInArrow(work, "part int, bits binary")


def probe(entries: DataFrame, held: DataFrame, parts: int) -> DataFrame:
    """Adds ``maybe``: false where the filters say that the index lacks the digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = np.zeros(batch.num_rows, bool)
            own = batch.column(batch.schema.get_field_index("bits"))
            part = np.array(batch.column(batch.schema.get_field_index("part")))
            digest = batch.column(batch.schema.get_field_index("digest"))
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                if own[int(rows[0])].as_py() is None:
                    continue
                bits = np.unpackbits(np.frombuffer(own[int(rows[0])].as_py(), np.uint8))
                maybe[rows] = bits[_places(digest.take(pa.array(rows)).to_pylist(), len(bits))].all(1)
            keep = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] not in ("part", "bits")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(maybe)], names=[*(n for n in batch.schema.names if n not in ("part", "bits")), "maybe"])

    d = entries.withColumn("part", part_of("digest", parts)).join(F.broadcast(held), "part", "left")
    return d.mapInArrow(work, T.StructType([*entries.schema.fields, T.StructField("maybe", T.BooleanType())]))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None, memtable: int = MEMTABLE, fanout: int = FANOUT, ws: Workspace | None = None) -> DataFrame:
    """Which row of equal texts stays: ``(id, keep_id, group_size, kept, text_sha256)``, one row per row.

    Equal: identical after deleting white space; null text counts as empty, and all empty texts are one
    group. The row with most code points stays, then the smallest id. Memtables flush sorted runs, which are
    merged level by level; the entries of several rows are the index, whose parts have Bloom filters. Rows that pass the filters
    probe the index, and every hit's bytes are compared with those of the row that stays, copies of one row in salted parts. Texts of one
    ``digest`` with other bytes are then told apart by the bytes. Null ids count as larger than any other. An empty table gives an empty result;
    further columns are ignored; rows that repeat an id each give a row and count in the group.
    """
    ws = ws or Workspace(docs.sparkSession, "exact")
    text = F.coalesce(F.col(text_col), F.lit(""))
    make = digest or (lambda c: F.sha2(c, 256))
    base = docs.select(ordered_id(id_col).alias("id"), text.alias("text"))
    entries = ws.table(base.select(make(normal()).alias("digest"), (-F.length("text").cast("long")).alias("rank"), "id", F.sha2(normal(), 256).alias("sha")), "entries")
    runs = ws.table(flush_runs(entries, memtable), "runs")
    index = ws.table(compact(runs, ws, fanout).where("n > 1"), "index").select("digest", F.col("id").alias("keep_id"), "n")
    held = index.count()
    parts = max(1, -(-held // PART))
    if held * BITS // 8 <= FILTERS:
        entries = ws.table(probe(entries, ws.table(filters(index, parts), "filters"), parts), "probed")
    else:
        entries = entries.withColumn("maybe", F.lit(True))
    found = hot_join(entries.where("maybe").select("id", "digest", "sha"), index.withColumnsRenamed({"digest": "of"}).withColumn("rows", F.col("n")), "digest", "of", "rows", "id")
    alone = entries.where("not maybe").select("id", "digest", "sha", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("n"))
    found = found.select("id", "digest", "sha", "keep_id", "n").unionByName(alone)
    found = ws.table(found.select("id", "digest", "sha", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), F.col("n").isNotNull().alias("hit")), "found")
    # every hit but the row that stays against that row, which is sent to as many tasks as its copies need
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    copies = found.where("hit and id <> keep_id").select("id", "keep_id", "digest", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt")).distinct()
    keepers = index.select(F.col("keep_id").alias("id"), salts.alias("salts")).groupBy("id").agg(F.max("salts").alias("salts"))
    left = base.join(copies, "id").select("keep_id", "salt", "digest", normal().alias("x"))
    right = base.join(keepers, "id").dropDuplicates(["id"]).select(F.col("id").alias("keep_id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), normal().alias("y"))
    bad = ws.table(left.join(right, ["keep_id", "salt"]).where("x <> y").select("digest").distinct(), "bad")
    if not bad.isEmpty():
        # a digest's rows with unlike bytes are grouped by the bytes
        again = base.select(make(normal()).alias("digest"), "*").join(bad, "digest", "left_semi").select("id", normal().alias("x"), (-F.length("text").cast("long")).alias("rank"))
        groups_ = again.groupBy("x").agg(F.min(F.struct("rank", "id")).alias("best"), F.count("*").alias("n"))
        sure = again.join(groups_, "x").select("id", F.sha2("x", 256).alias("sha"), F.col("best.id").alias("keep_id"), "n")
        found = found.join(bad, "digest", "left_anti").select("id", "sha", "keep_id", "n").unionByName(sure)
    return found.select(own_id("id").alias(id_col), own_id("keep_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("id") == F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))

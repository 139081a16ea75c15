"""Readers and writers: JSON lines in three strictnesses, seeds, file manifests, qrels text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) not in (None, [])


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "tolerant") -> DataFrame:
    """``strict`` fails on a bad line, ``tolerant`` reads a missing file as empty and bad lines as nulls, ``skip`` leaves bad lines out."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if mode == "strict":
        return spark.read.schema(kind).option("mode", "FAILFAST").json(path)
    if not exists(spark, path):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("mode", "DROPMALFORMED" if mode == "skip" else "PERMISSIVE").json(path)


def canonical_json(df: DataFrame) -> DataFrame:
    """One ``value`` per row: compact JSON with sorted keys."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def seeds(df: DataFrame) -> DataFrame:
    """``groups: array<struct<id, sources>>`` to a row per source."""
    return df.select(F.explode("groups").alias("g")).select(F.col("g.id").alias("group_id"), F.explode("g.sources").alias("source"))


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, bytes, sha256)`` of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def source_kind(files: DataFrame) -> DataFrame:
    """Kind of each folder of ``(folder, name)`` by the files that it holds, first rule first."""
    has = lambda pattern: F.max(F.col("name").rlike(pattern).cast("int")) == 1
    kind = F.when(has(r"\.(xml|akn)$"), "LEGISLATION").when(has("^blocks"), "BLOCKS").when(has(r"\.html?$"), "HTML").when(has(r"\.pdf$"), "PDF").otherwise("NONE")
    return files.groupBy("folder").agg(kind.alias("kind"))


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels.select(F.concat_ws(" ", "query", F.lit("0"), "id", "grade").alias("value")).write.text(path)

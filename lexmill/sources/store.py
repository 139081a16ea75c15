"""Tables that change by manifests: appends that happen once, reloads that readers see whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from lexmill.sources.readers import exists

END = "END"


class ChangedMeanwhile(RuntimeError):
    """Another writer has published a version in between; nothing was changed."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number of the last whole manifest, and the folders that it names; 0 and none for a new table. A manifest that a lost writer left without its end doesn't count."""
    if not exists(spark, f"{path}/_manifest"):
        return 0, []
    fs, p = _fs(spark, f"{path}/_manifest")
    for n in sorted((int(x.getPath().getName()) for x in fs.listStatus(p)), reverse=True):
        stream = fs.open(_fs(spark, f"{path}/_manifest/{n}")[1])
        try:
            lines = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()
        if lines[-1] == END:
            return n, lines[:-1]
    return 0, []


def publish(spark: SparkSession, path: str, after: int, folders: list[str]) -> int:
    """Makes ``folders`` the table's contents, if no manifest has followed ``after``; a manifest is created, never written over, so of two writers one fails."""
    fs, p = _fs(spark, f"{path}/_manifest")
    n = max([after, *(int(x.getPath().getName()) for x in (fs.listStatus(p) if exists(spark, f"{path}/_manifest") else []))]) + 1
    if current(spark, path)[0] != after:
        raise ChangedMeanwhile(path)
    try:
        out = fs.create(_fs(spark, f"{path}/_manifest/{n}")[1], False)
    except Exception as e:
        raise ChangedMeanwhile(path) from e
    out.write(bytearray("\n".join([*folders, END]).encode()))
    out.close()
    return n


def append(df: DataFrame, path: str, name: str) -> bool:
    """Adds the rows under a name that is used once: a name that is published already adds nothing (false). Rows of an earlier try that wasn't published are replaced."""
    spark = df.sparkSession
    n, folders = current(spark, path)
    if name in folders:
        return False
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    publish(spark, path, n, [*folders, name])
    return True


def replace(df: DataFrame, path: str) -> None:
    """Truncate and insert as one step: the rows are written beside the old ones, then the manifest names them alone. Readers that have begun keep the old rows."""
    n, _ = current(df.sparkSession, path)
    name = f"all-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    publish(df.sparkSession, path, n, [name])


def read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The published rows; a table that nothing was published to is empty."""
    _, folders = current(spark, path)
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.schema(kind).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], kind)


def sink(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends every micro-batch once, whenever it is killed and started again: batches are named by their numbers, which the checkpoint repeats."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: append(batch, path, f"batch-{n}"))

"""Partitioned Parquet tables on a shared file system."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from clickfold.schemas import RAW_EVENTS

EVENT_DATE = T.StructField("event_date", T.DateType())


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _filesystem(spark, path)
    return fs.exists(hadoop_path)


def table_bytes(spark: SparkSession, path: str) -> int:
    fs, hadoop_path = _filesystem(spark, path)
    return fs.getContentSummary(hadoop_path).getLength()


def require_table(spark: SparkSession, path: str) -> None:
    """Precondition of the daily jobs."""
    if not table_exists(spark, path):
        raise FileNotFoundError(f"no table at {path}")


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    partitions: Sequence[T.StructField] = (),
    only: Sequence[object] | None = None,
) -> DataFrame:
    """Read with a fixed schema; a table nobody wrote yet is empty.

    ``only`` names values of the first partition column: just their folders are listed,
    where a filter would list the whole table before pruning it.
    """
    full = T.StructType([*schema.fields, *[p for p in partitions if p.name not in schema.names]])
    paths = [path]
    if only is not None:
        paths = [f"{path}/{partitions[0].name}={value}" for value in sorted(set(only))]
    paths = [p for p in paths if table_exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(*paths)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _filesystem(spark, path)
    fs.mkdirs(hadoop_path)


def drop_path(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _filesystem(spark, path)
    fs.delete(hadoop_path, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder; the target's parent is made, an existing target is refused."""
    fs, hadoop_path = _filesystem(spark, source)
    hadoop_target = _filesystem(spark, target)[1]
    fs.mkdirs(hadoop_target.getParent())
    if fs.exists(hadoop_target) or not fs.rename(hadoop_path, hadoop_target):
        raise OSError(f"cannot move {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text file in place in one step: readers see the old, the new or none."""
    fs, hadoop_path = _filesystem(spark, path)
    unfinished = _filesystem(spark, f"{hadoop_path.getParent().toString()}/_{hadoop_path.getName()}")[1]
    stream = fs.create(unfinished, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(hadoop_path, False)
    if not fs.rename(unfinished, hadoop_path):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, read by the driver."""
    fs, hadoop_path = _filesystem(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_marker(spark: SparkSession, folder: str, number: int) -> None:
    """Record a number as the name of an empty file, then forget the smaller ones."""
    fs, path = _filesystem(spark, f"{folder}/{number}")
    fs.create(path, True).close()
    for old, location in marked(spark, folder):
        if old < number:
            drop_path(spark, location)


def marker(spark: SparkSession, folder: str) -> int | None:
    """The newest number recorded in a folder."""
    return max((number for number, _ in marked(spark, folder)), default=None)


def marked(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, path) of the files in a folder that are named by numbers."""
    if not table_exists(spark, folder):
        return []
    fs, path = _filesystem(spark, folder)
    paths = [status.getPath() for status in fs.listStatus(path)]
    return [(int(p.getName()), p.toString()) for p in paths if p.getName().isdigit()]


def read_raw(spark: SparkSession, path: str, day: dt.date | None = None) -> DataFrame:
    """Raw events, or one day of them."""
    only = None if day is None else [day]
    return read_table(spark, path, RAW_EVENTS, [EVENT_DATE], only)


def ensure_table(
    spark: SparkSession,
    name: str,
    schema: T.StructType,
    partitions: Sequence[str] = (),
    path: str | None = None,
) -> None:
    """Create a catalog table over Parquet unless it is there."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    partitioned = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    location = f" LOCATION '{path}'" if path else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{partitioned}{location}"
    )


def write_partitions(
    df: DataFrame, path: str, *partitions: str, rebalance: bool = False
) -> None:
    """Overwrite just the partitions present in ``df``, so repeating a write is harmless.

    ``rebalance`` shuffles by partition first, for rows not yet sized by a shuffle: small
    files merge, and a partition that holds most of the rows is split over several tasks.
    """
    if rebalance:
        df = df.hint("rebalance", *partitions)
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def partition_values(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(value, path) of the first-level partitions, from a directory listing."""
    if not table_exists(spark, path):
        return []
    fs, hadoop_path = _filesystem(spark, path)
    found = []
    for status in fs.listStatus(hadoop_path):
        name = status.getPath().getName()
        if status.isDirectory() and "=" in name and not name.startswith((".", "_")):
            found.append((name.split("=", 1)[1], status.getPath().toString()))
    return sorted(found)


def drop_partitions(spark: SparkSession, path: str, unwanted: Callable[[str], bool]) -> list[str]:
    """Delete first-level partitions whose value is unwanted; returns the values."""
    dropped = []
    for value, location in partition_values(spark, path):
        if unwanted(value):
            fs, hadoop_path = _filesystem(spark, location)
            fs.delete(hadoop_path, True)
            dropped.append(value)
    return dropped

"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickfold.session import scratch_dir


class Scratch:
    """Named Parquet tables under one fresh folder of the shared scratch space."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_dir(spark, name)

    def put(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Write ``df`` and read it back: it is computed once, and survives lost executors."""
        df.write.parquet(f"{self.root}/{name}", compression=compression)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that no later read needs."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

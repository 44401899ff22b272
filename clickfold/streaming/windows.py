"""Arrivals per window as a table that batches add to.

A streaming aggregation keeps a row of state per open window, and to count every late arrival
no window may ever close. Here each batch writes what it counted, late arrivals under their old
windows, and reading adds the batches up: the stream holds no state, and nothing is dropped.
``fold`` turns the batches of a day into one table, so that neither files nor reading time
grow with the number of batches.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfold.operators.ingest import accepted, parse_events, tag_rejects
from clickfold.operators.serving import merge_windows, window_counts, window_rates
from clickfold.schemas import MAIN_TOPIC, WINDOW_COUNTS
from clickfold.session import BATCH_CONF, session_conf
from clickfold.sources.tables import (
    drop_partitions,
    drop_path,
    marker,
    partition_values,
    put_marker,
    read_table,
    write_partitions,
)

_DATE = T.StructField("window_date", T.DateType())
_BATCH = T.StructField("batch_id", T.LongType())
_AS_OF = T.StructField("as_of", T.LongType())


class WindowTable:
    """Window counts under ``root``: ``log`` by (window_date, batch_id), ``folded`` by
    (window_date, as_of)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.log_path = f"{root}/log"
        self.folded_path = f"{root}/folded"
        self.committed_path = f"{root}/committed"

    def last_counted(self) -> int | None:
        return marker(self.spark, self.committed_path)

    def count_batch(self, messages: DataFrame, number: int, seconds: int = 10) -> None:
        """Count a batch's arrivals on the main topic, which carries every event once.

        What an earlier attempt of the batch wrote goes first, whatever its dates.
        """
        last = self.last_counted()
        if last is not None and number < last:
            raise ValueError(f"batch {number} comes before batch {last}, which is counted")
        for _, day_path in partition_values(self.spark, self.log_path):
            drop_path(self.spark, f"{day_path}/batch_id={number}")
        main = messages.filter(F.col("topic") == MAIN_TOPIC)
        counts = window_counts(accepted(tag_rejects(parse_events(main))), seconds)
        dated = counts.withColumns(
            {"window_date": F.to_date("window_start"), "batch_id": F.lit(number).cast("long")}
        )
        with session_conf(self.spark, BATCH_CONF):
            write_partitions(dated, self.log_path, "window_date", "batch_id")
        put_marker(self.spark, self.committed_path, number)

    def counts(self, days: Sequence[dt.date] | None = None) -> DataFrame:
        """Counts per (seconds, window_start) of all counted batches, or of some days."""
        last = self.last_counted()
        if last is None:
            return self.spark.createDataFrame([], WINDOW_COUNTS)
        return merge_windows(self._parts(days, last))

    def rates(self, days: Sequence[dt.date] | None = None) -> DataFrame:
        return window_rates(self.counts(days))

    def _folded(self, days: Sequence[dt.date] | None) -> dict[str, int]:
        """Each day's newest fold: the batch up to which it holds all counts."""
        wanted = None if days is None else {str(day) for day in days}
        found = {}
        for day, path in partition_values(self.spark, self.folded_path):
            if wanted is None or day in wanted:
                numbers = [int(v) for v, _ in partition_values(self.spark, path)]
                if numbers:
                    found[day] = max(numbers)
        return found

    def _parts(self, days: Sequence[dt.date] | None, until: int) -> DataFrame:
        """The newest folds and the log rows after them, up to a batch."""
        folded = self._folded(days)
        log = read_table(self.spark, self.log_path, WINDOW_COUNTS, [_DATE, _BATCH], days)
        log = log.filter(F.col("batch_id") <= until)
        if not folded:
            return log.select(*WINDOW_COUNTS.names)
        paths = [f"{self.folded_path}/window_date={d}/as_of={n}" for d, n in folded.items()]
        schema = T.StructType([*WINDOW_COUNTS.fields, _DATE, _AS_OF])
        base = self.spark.read.schema(schema).option("basePath", self.folded_path).parquet(*paths)
        # One row per folded day.
        newest = self.spark.createDataFrame(
            [(dt.date.fromisoformat(d), n) for d, n in folded.items()], "window_date date, as_of long"
        )
        pending = log.join(newest, "window_date", "left").filter(
            F.col("as_of").isNull() | (F.col("batch_id") > F.col("as_of"))
        )
        parts = [base, pending]
        return reduce(DataFrame.unionByName, [p.select(*WINDOW_COUNTS.names) for p in parts])

    def fold(self) -> int:
        """Fold each day's batches but the newest, which may be repeated; returns the number
        of days folded. Only days with such batches are read."""
        last = self.last_counted()
        if last is None:
            return 0
        pending = [
            day
            for day, path in partition_values(self.spark, self.log_path)
            if any(int(n) < last for n, _ in partition_values(self.spark, path))
        ]
        if not pending:
            return 0
        days = [dt.date.fromisoformat(day) for day in pending]
        merged = merge_windows(self._parts(days, last - 1)).withColumns(
            {"window_date": F.to_date("window_start"), "as_of": F.lit(last - 1).cast("long")}
        )
        with session_conf(self.spark, BATCH_CONF):
            write_partitions(merged, self.folded_path, "window_date", "as_of")
        for day in pending:
            log_path = f"{self.log_path}/window_date={day}"
            drop_partitions(self.spark, log_path, lambda v: int(v) < last)
            if not partition_values(self.spark, log_path):
                drop_path(self.spark, log_path)
            folds = f"{self.folded_path}/window_date={day}"
            drop_partitions(self.spark, folds, lambda v: int(v) < last - 1)
        return len(pending)

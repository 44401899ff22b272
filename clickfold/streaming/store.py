"""The event store: partitioned Parquet tables under one root.

=============  =========================  ==============================================
table          partitions                 rows
=============  =========================  ==============================================
landing        batch_id                   valid events, one per id within a batch
late           batch_id                   the same, older than the horizon
rejected       rejected_on, batch_id      messages set aside, with the reason
raw_events     event_date, batch_id       events, one per id over all batches
raw_merged     event_date, merged         the same after compaction, with their batch numbers
manifests      event_date                 which merged folder and which batches of it count
metric_log     metric_date, batch_id      what one batch adds to (date, product)
snapshots      metric_date, as_of, run    a day's metrics, complete up to batch as_of
funnel         metric_date                one funnel row per day
job_runs       run_date                   one row per attempt of a batch or job
topic_log      batch_id                   messages per topic partition in one batch
topic_counts   as_of                      messages per topic partition up to a batch
topic_stats    run_date                   recorded totals per topic
month_totals   month, version             all measures of a month, see ``rollups``
all_totals     version                    the same of several months together
=============  =========================  ==============================================

A batch first deletes whatever an earlier attempt with its number wrote and then writes its
own rows, so that repeating it, with other files or dates, leaves one attempt's rows. Its
number is recorded when all its tables are written; readers see recorded batches only.
Nothing updates a metric row in place: a day's metrics are its newest snapshot plus the log
rows of later batches, summed.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfold.functions.clock import ntz, utc_now
from clickfold.operators.audit import SUCCESS, run_record
from clickfold.operators.funnels import funnel_day
from clickfold.operators.ingest import accepted, dedup, parse_events, rejected, tag_rejects
from clickfold.operators.merging import fold_metrics, merge_replace
from clickfold.operators.products import product_metrics
from clickfold.operators.routing import merge_topic_counts, topic_counts, topic_totals
from clickfold.operators.serving import latest_events
from clickfold.operators.staging import of_type
from clickfold.schemas import (
    FUNNEL_METRICS,
    JOB_RUNS,
    PRODUCT_METRICS,
    RAW_EVENTS,
    REJECTED_EVENTS,
    TOPIC_COUNTS,
    TOPIC_STATS,
)
from clickfold.session import BATCH_CONF, FILES_CONF, batch_conf, session_conf
from clickfold.sources.tables import (
    EVENT_DATE,
    drop_partitions,
    drop_path,
    marked,
    marker,
    partition_values,
    put_marker,
    read_table,
    read_text,
    rename,
    table_bytes,
    table_exists,
    write_partitions,
    write_text,
)
from clickfold.streaming.manifests import (
    Manifest,
    read_manifest,
    read_manifests,
    write_manifest,
)
from clickfold.streaming.rollups import TotalsTable

PUBLISH = "publish"
#: Numbers from here on belong to replays of rejected messages, smaller ones to the stream.
REPLAYS = 1 << 62
#: How far ahead of the clock an event may be where a horizon bounds the state.
AHEAD = dt.timedelta(days=1)

_BATCH = T.StructField("batch_id", T.LongType())
_METRIC_DATE = T.StructField("metric_date", T.DateType())
_RUN_DATE = T.StructField("run_date", T.DateType())
_REJECTED_ON = T.StructField("rejected_on", T.DateType())
_VERSION = (T.StructField("as_of", T.LongType()), T.StructField("run", T.LongType()))


@contextmanager
def _kept(df: DataFrame) -> Iterator[DataFrame]:
    """Hold a batch for its several outputs; it spills to disk and can be recomputed."""
    with session_conf(df.sparkSession, BATCH_CONF):
        held = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield held
        finally:
            held.unpersist()


class EventStore:
    """Reads and writes the tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.landing_path = f"{self.root}/landing"
        self.rejected_path = f"{self.root}/rejected"
        self.raw_path = f"{self.root}/raw_events"
        self.merged_path = f"{self.root}/raw_merged"
        self.manifest_path = f"{self.root}/manifests"
        self.log_path = f"{self.root}/metric_log"
        self.snapshot_path = f"{self.root}/snapshots"
        self.funnel_path = f"{self.root}/funnel"
        self.runs_path = f"{self.root}/job_runs"
        self.topic_log_path = f"{self.root}/topic_log"
        self.topic_counts_path = f"{self.root}/topic_counts"
        self.topic_path = f"{self.root}/topic_stats"
        self.late_path = f"{self.root}/late"
        self.taken_path = f"{self.root}/late_taken"
        self.committed_path = f"{self.root}/committed"
        self.vacuumed_path = f"{self.root}/vacuumed"
        self.compacting_path = f"{self.root}/compacting"
        self.replays_path = f"{self.root}/replays"
        self.replaying_path = f"{self.root}/replaying"
        self.checked_path = f"{self.root}/checked"
        self.totals = TotalsTable(spark, self.root)

    # --- reads -------------------------------------------------------------------

    def rejected_events(self, days: Sequence[dt.date | str] | None = None) -> DataFrame:
        """Messages set aside, by the day on which that happened."""
        return read_table(
            self.spark, self.rejected_path, REJECTED_EVENTS, [_REJECTED_ON, _BATCH], days
        )

    def raw_events(
        self, up_to: int | None = None, days: Sequence[dt.date | str] | None = None
    ) -> DataFrame:
        """Events of the batches up to a number, by default of all committed batches, whether
        their days were compacted or not."""
        schema = T.StructType([*RAW_EVENTS.fields, EVENT_DATE, _BATCH])
        up_to = self.last_committed() if up_to is None else up_to
        if up_to is None:
            return self.spark.createDataFrame([], schema)
        until = F.col("batch_id") <= up_to
        manifests = self._manifests(days)
        if not manifests:
            raw = read_table(self.spark, self.raw_path, RAW_EVENTS, [EVENT_DATE, _BATCH], days)
            return raw.filter(until)
        parts = [self._merged_rows(manifests)]
        folders = self._unmerged(manifests, days)
        if folders:
            reader = self.spark.read.schema(schema).option("basePath", self.raw_path)
            parts.append(reader.parquet(*folders))
        return reduce(DataFrame.unionByName, parts).filter(until)

    def raw_days(self) -> list[str]:
        """Days that may hold events, oldest first."""
        paths = (self.raw_path, self.merged_path)
        return sorted({day for path in paths for day, _ in partition_values(self.spark, path)})

    def _manifests(self, days: Sequence[dt.date | str] | None = None) -> dict[str, Manifest]:
        if days is None:
            found = read_manifests(self.spark, self.manifest_path)
        else:
            names = sorted({str(day) for day in days})
            found = (read_manifest(self.spark, self.manifest_path, day) for day in names)
        return {manifest.day: manifest for manifest in found if manifest is not None}

    def _merged_rows(self, manifests: dict[str, Manifest]) -> DataFrame:
        """Rows of the days' merged folders, without those of withdrawn batches."""
        merged = T.StructField("merged", T.LongType())
        schema = T.StructType([*RAW_EVENTS.fields, _BATCH, EVENT_DATE, merged])
        reader = self.spark.read.schema(schema).option("basePath", self.merged_path)
        rows = reader.parquet(*[f"{self.merged_path}/{m.folder}" for m in manifests.values()])
        # Only repeated batches are withdrawn, and those until the next compaction.
        for manifest in manifests.values():
            if manifest.withdrawn:
                day = F.lit(manifest.day).cast("date")
                gone = F.col("batch_id").isin(*manifest.withdrawn)
                rows = rows.filter(~((F.col("event_date") == day) & gone))
        return rows.drop("merged").select(*RAW_EVENTS.names, "event_date", "batch_id")

    def _unmerged(
        self, manifests: dict[str, Manifest], days: Sequence[dt.date | str] | None
    ) -> list[str]:
        """Folders with rows that no manifest covers: whole days, or batches of a merged day."""
        wanted = None if days is None else {str(day) for day in days}
        found = []
        for day, path in partition_values(self.spark, self.raw_path):
            if wanted is not None and day not in wanted:
                continue
            if day in manifests:
                covered = manifests[day].batches
                batches = partition_values(self.spark, path)
                found += [folder for n, folder in batches if int(n) not in covered]
            else:
                found.append(path)
        return found

    def job_runs(self, days: Sequence[dt.date | str] | None = None) -> DataFrame:
        return read_table(self.spark, self.runs_path, JOB_RUNS, [_RUN_DATE], days)

    def funnel_metrics(self) -> DataFrame:
        return read_table(self.spark, self.funnel_path, FUNNEL_METRICS, [_METRIC_DATE])

    def topic_history(self) -> DataFrame:
        return read_table(self.spark, self.topic_path, TOPIC_STATS, [_RUN_DATE])

    def last_committed(self) -> int | None:
        """Number of the newest batch whose events and metrics are both written."""
        return marker(self.spark, self.committed_path)

    def last_landed(self) -> int | None:
        """Number of the newest batch that was landed."""
        paths = [
            self.landing_path,
            self.late_path,
            self.topic_log_path,
            self.topic_counts_path,
            *[path for _, path in partition_values(self.spark, self.rejected_path)],
        ]
        numbers = [int(v) for path in paths for v, _ in partition_values(self.spark, path)]
        return max((n for n in numbers if 0 <= n < REPLAYS), default=None)

    def next_offsets(self) -> dict[str, dict[str, int]]:
        """Per topic and partition the offset after the last one landed.

        One entry per topic partition; what Kafka calls the starting offsets, for a landing
        stream whose checkpoint was lost.
        """
        counts = read_table(self.spark, self.topic_counts_path, TOPIC_COUNTS, [_VERSION[0]])
        log = read_table(self.spark, self.topic_log_path, TOPIC_COUNTS, [_BATCH])
        merged = merge_topic_counts(counts.drop("as_of").unionByName(log.drop("batch_id")))
        offsets: dict[str, dict[str, int]] = {}
        for row in merged.collect():
            of_topic = offsets.setdefault(row.kafka_topic, {})
            of_topic[str(row.kafka_partition)] = row.last_offset + 1
        return offsets

    def product_metrics(
        self, days: Sequence[dt.date] | None = None, up_to: int | None = None
    ) -> DataFrame:
        """Metrics per (date, product) as of a committed batch, the newest by default.

        A batch before the last :meth:`vacuum` is refused: its rows are gone.
        """
        vacuumed = marker(self.spark, self.vacuumed_path)
        if up_to is not None and vacuumed is not None and up_to < vacuumed:
            raise ValueError(f"metrics before batch {vacuumed} were vacuumed")
        up_to = self.last_committed() if up_to is None else up_to
        if up_to is None:
            return self.spark.createDataFrame([], PRODUCT_METRICS)
        versions = self._versions(days, up_to)
        columns = PRODUCT_METRICS.names
        log = read_table(self.spark, self.log_path, PRODUCT_METRICS, [_METRIC_DATE, _BATCH], days)
        log = log.filter(F.col("batch_id") <= up_to)
        if not versions:
            return fold_metrics(log.select(*columns))
        paths = [f"{self.snapshot_path}/{path}" for _, _, path in versions]
        schema = T.StructType([*PRODUCT_METRICS.fields, *_VERSION])
        reader = self.spark.read.schema(schema).option("basePath", self.snapshot_path)
        base = reader.parquet(*paths)
        # One row per stored day.
        newest = self.spark.createDataFrame(
            [(day, as_of) for day, as_of, _ in versions], "metric_date date, as_of long"
        )
        pending = log.join(newest, "metric_date", "left").filter(
            F.col("as_of").isNull() | (F.col("batch_id") > F.col("as_of"))
        )
        return fold_metrics(base.select(*columns).unionByName(pending.select(*columns)))

    def measures(self, days: Sequence[dt.date] | None = None) -> DataFrame:
        """The metrics as a measure table: totals, funnels, rankings and categories read
        this instead of the events. It outlives pruned events, and counts a product under
        its newest name of the day."""
        metrics = self.product_metrics(days)
        return metrics.withColumnsRenamed(
            {"metric_date": "event_date", "category": "product_category"}
        )

    def latest_events(self, limit: int = 50, event_type: str = "ALL") -> DataFrame:
        """The newest events, reading only as many of the newest days as hold ``limit``."""
        days = self.raw_days()[::-1]
        span = 1
        while span < len(days):
            recent = of_type(self.raw_events(days=days[:span]), event_type)
            if recent.limit(limit).count() >= limit:
                return latest_events(recent, limit)
            span *= 2
        return latest_events(self.raw_events(), limit, event_type)

    def _versions(
        self, days: Sequence[dt.date] | None, up_to: int
    ) -> list[tuple[dt.date, int, str]]:
        """(day, as_of, folder) of each day's newest snapshot, from folder listings alone."""
        wanted = None if days is None else {str(day) for day in days}
        found = []
        for day, day_path in partition_values(self.spark, self.snapshot_path):
            if wanted is not None and day not in wanted:
                continue
            numbers = [int(v) for v, _ in partition_values(self.spark, day_path)]
            as_of = max((n for n in numbers if n <= up_to), default=None)
            if as_of is not None:
                runs = partition_values(self.spark, f"{day_path}/as_of={as_of}")
                run = max(int(v) for v, _ in runs)
                folder = f"metric_date={day}/as_of={as_of}/run={run}"
                found.append((dt.date.fromisoformat(day), as_of, folder))
        return found

    # --- stream batches ----------------------------------------------------------

    def land_batch(
        self,
        messages: DataFrame,
        number: int,
        horizon: dt.timedelta | None = None,
        now: dt.datetime | None = None,
    ) -> None:
        """Decode a batch, set rejects aside and keep one copy per id.

        Copies within the batch go here, at most one per id and task reaching the
        shuffle; what the stateful step sees later holds no large group of copies. With a
        horizon, events older than it are set apart as late and events more than
        :data:`AHEAD` in the future are rejected: they would move event time on for all.
        """
        for path in (self.landing_path, self.late_path, self.topic_log_path):
            drop_path(self.spark, f"{path}/batch_id={number}")
        for _, day_path in partition_values(self.spark, self.rejected_path):
            drop_path(self.spark, f"{day_path}/batch_id={number}")
        parsed = parse_events(messages)
        now = now or utc_now()
        latest = None if horizon is None else now + AHEAD
        tagged = tag_rejects(parsed, latest).withColumn("batch_id", F.lit(number))
        with _kept(tagged):
            # One row per topic partition.
            seen = topic_counts(tagged, F.count("reject_reason").alias("bad")).collect()
            if not seen:
                return
            if number < REPLAYS:
                counts = self.spark.createDataFrame([r[:-1] for r in seen], TOPIC_COUNTS)
                counts = counts.withColumn("batch_id", F.lit(number)).coalesce(1)
                write_partitions(counts, self.topic_log_path, "batch_id")
            total = sum(r.messages for r in seen)
            session = messages.sparkSession
            with session_conf(session, batch_conf(session, messages=total)):
                self._write_landed(tagged, number, horizon, now, total - sum(r.bad for r in seen))
            if sum(r.bad for r in seen):
                bad = rejected(tagged).withColumns(
                    {"rejected_on": F.lit(now.date()), "batch_id": F.lit(number)}
                )
                write_partitions(
                    bad, self.rejected_path, "rejected_on", "batch_id", rebalance=True
                )

    def _write_landed(
        self,
        tagged: DataFrame,
        number: int,
        horizon: dt.timedelta | None,
        now: dt.datetime,
        n_good: int,
    ) -> None:
        good = accepted(tagged)
        if horizon is not None:
            is_late = F.col("created_at") < ntz(now - horizon)
            old = dedup(good.filter(is_late)).withColumn("batch_id", F.lit(number))
            write_partitions(old, self.late_path, "batch_id")
            good = good.filter(~is_late)
        if n_good:
            unique = dedup(good).withColumn("batch_id", F.lit(number))
            write_partitions(unique, self.landing_path, "batch_id")
        if self._only_late(number):
            # An empty file starts a published batch, which takes the late events.
            empty = self.spark.createDataFrame([], RAW_EVENTS)
            empty.write.parquet(f"{self.landing_path}/batch_id={number}")

    def _only_late(self, number: int) -> bool:
        """Whether a landed batch has late events and no others."""
        late, landed = (
            table_exists(self.spark, f"{path}/batch_id={number}")
            for path in (self.late_path, self.landing_path)
        )
        return late and not landed

    def take_late(self, number: int) -> DataFrame | None:
        """The late events that batch ``number`` publishes, if any.

        Their folders move under its number, so that a repeated batch finds the same ones;
        those of earlier batches, which are done, are deleted.
        """
        drop_partitions(self.spark, self.taken_path, lambda v: int(v) < number)
        for batch, path in partition_values(self.spark, self.late_path):
            target = f"{self.taken_path}/number={number}/batch_id={batch}"
            drop_path(self.spark, target)
            rename(self.spark, path, target)
        taken = partition_values(self.spark, f"{self.taken_path}/number={number}")
        if not taken:
            return None
        return dedup(self.spark.read.schema(RAW_EVENTS).parquet(*[path for _, path in taken]))

    def new_late(self, late: DataFrame, number: int) -> DataFrame:
        """Late events whose ids are not stored on their days yet."""
        # Calendar days, from one column of a few rows.
        days = [r[0] for r in late.select(F.to_date("created_at")).distinct().collect()]
        stored = self.raw_events(number - 1, days)
        return dedup(late, stored)

    def publish_batch(
        self, events: DataFrame, number: int, late: DataFrame | None = None
    ) -> None:
        """Write a batch of new events, then what they add to the metrics.

        Whatever an earlier attempt of the batch wrote is deleted first. The metrics are
        computed from the rows as they were written.
        """
        last = self.last_committed()
        if last is not None and number < last:
            raise ValueError(f"batch {number} comes before batch {last}, which is committed")
        started = utc_now()
        if number == last:
            self._withdraw(number)
        for path in (self.raw_path, self.log_path):
            for _, day_path in partition_values(self.spark, path):
                drop_path(self.spark, f"{day_path}/batch_id={number}")
        session, taken = events.sparkSession, f"{self.taken_path}/number={number}"
        late_bytes = table_bytes(self.spark, taken) if table_exists(self.spark, taken) else 0
        records, months = 0, []
        with session_conf(session, batch_conf(session, late_bytes)):
            if late is not None:
                # A late copy may come beside the first one.
                fresh = self.new_late(late, number).select(*RAW_EVENTS.names)
                events = dedup(events.select(*RAW_EVENTS.names).unionByName(fresh))
            dated = events.select(
                *RAW_EVENTS.names,
                F.to_date("created_at").alias("event_date"),
                F.lit(number).cast("long").alias("batch_id"),
            )
            write_partitions(dated, self.raw_path, "event_date", "batch_id", rebalance=True)
            written = [
                (day, f"{path}/batch_id={number}")
                for day, path in partition_values(self.spark, self.raw_path)
                if table_exists(self.spark, f"{path}/batch_id={number}")
            ]
            if written:
                schema = T.StructType([*RAW_EVENTS.fields, EVENT_DATE, _BATCH])
                reader = self.spark.read.schema(schema).option("basePath", self.raw_path)
                batch = reader.parquet(*[path for _, path in written])
                records = batch.count()
                added = product_metrics(batch).withColumn("batch_id", F.lit(number))
                # Marked before and after: totals made in between do not count as current.
                months = sorted({day[:7] for day, _ in written})
                self.totals.mark_changed(months)
                write_partitions(added, self.log_path, "metric_date", "batch_id")
        self.record_run(
            run_id=f"{PUBLISH}-{number}",
            dag_id=PUBLISH,
            status=SUCCESS,
            started_at=started,
            finished_at=utc_now(),
            records_processed=records,
            batch_id=number,
        )
        put_marker(self.spark, self.committed_path, number)
        self.totals.mark_changed(months)

    def _withdraw(self, number: int) -> None:
        """Take a batch that is repeated out of the merged days; the rest of them stays."""
        for manifest in read_manifests(self.spark, self.manifest_path):
            if number in manifest.batches:
                write_manifest(self.spark, self.manifest_path, manifest.without(number))

    def clean_landing(self, below: int) -> int:
        """Delete landed batches with smaller numbers; returns how many there were."""
        drop = drop_partitions(self.spark, self.landing_path, lambda v: int(v) < below)
        return len(drop)

    # --- jobs --------------------------------------------------------------------

    def record_run(self, **fields) -> None:
        row = run_record(self.spark, **fields).withColumn("run_date", F.to_date("started_at"))
        row.write.mode("append").partitionBy("run_date").parquet(self.runs_path)

    def record_topic_stats(self, recorded_at: dt.datetime) -> None:
        """Record how many messages each topic has delivered so far, copies and rejects
        included. The counts of landed batches are folded into one table as of the
        newest, which replaces them."""
        logged = [int(v) for v, _ in partition_values(self.spark, self.topic_log_path)]
        folded = [int(v) for v, _ in partition_values(self.spark, self.topic_counts_path)]
        base = max(folded, default=-1)
        newest = max([base, *logged])
        if newest < 0:
            return
        if newest > base:
            new = [b for b in logged if b > base]
            log = read_table(self.spark, self.topic_log_path, TOPIC_COUNTS, [_BATCH], new)
            merged = merge_topic_counts(
                self._topic_counts(base).drop("as_of").unionByName(log.drop("batch_id"))
            )
            as_of = merged.withColumn("as_of", F.lit(newest))
            write_partitions(as_of, self.topic_counts_path, "as_of")
        totals = topic_totals(self._topic_counts(newest), recorded_at)
        dated = totals.withColumn("run_date", F.to_date("recorded_at"))
        dated.write.mode("append").partitionBy("run_date").parquet(self.topic_path)
        drop_partitions(self.spark, self.topic_log_path, lambda v: int(v) <= newest)
        drop_partitions(self.spark, self.topic_counts_path, lambda v: int(v) < newest)

    def _topic_counts(self, as_of: int) -> DataFrame:
        return read_table(self.spark, self.topic_counts_path, TOPIC_COUNTS, [_VERSION[0]], [as_of])

    def replace_day(
        self, day: dt.date, oldest_kept: dt.date | None = None, run: int | None = None
    ) -> bool:
        """Recompute a day's metrics from its events; False when it has none.

        Products without events that day keep what the log says. A day that retention
        may have cut is refused, since recomputing would shrink it.
        """
        if oldest_kept is not None and day < oldest_kept:
            raise ValueError(f"{day} is before {oldest_kept}, the oldest day kept in full")
        as_of = self.last_committed()
        if as_of is None:
            return False
        events = self.raw_events(as_of, [day])
        if events.isEmpty():
            return False
        current = self.product_metrics([day], as_of)
        self.totals.mark_changed([str(day)[:7]])
        self._write_snapshot(merge_replace(current, product_metrics(events)), as_of, run)
        self.totals.mark_changed([str(day)[:7]])
        return True

    def compact(self, days: Sequence[dt.date], run: int | None = None) -> None:
        """Turn the log rows of the given days into one snapshot each."""
        as_of = self.last_committed()
        if as_of is not None:
            self._write_snapshot(self.product_metrics(days, as_of), as_of, run)

    def _write_snapshot(self, metrics: DataFrame, as_of: int, run: int | None) -> None:
        run = time.time_ns() if run is None else run
        versioned = metrics.withColumns(
            {"as_of": F.lit(as_of).cast("long"), "run": F.lit(run).cast("long")}
        )
        write_partitions(versioned, self.snapshot_path, "metric_date", "as_of", "run")

    def vacuum(self) -> int:
        """Delete log rows and snapshots a newer snapshot covers; returns the partitions
        deleted. Run it while no reader started before the newest snapshot is active."""
        removed = 0
        for day, day_path in partition_values(self.spark, self.snapshot_path):
            newest = max(int(v) for v, _ in partition_values(self.spark, day_path))
            # Recorded first: a read as of an earlier batch fails rather than misses rows.
            put_marker(
                self.spark,
                self.vacuumed_path,
                max(newest, marker(self.spark, self.vacuumed_path) or 0),
            )
            removed += len(drop_partitions(self.spark, day_path, lambda v: int(v) < newest))
            runs_path = f"{day_path}/as_of={newest}"
            last = max(int(v) for v, _ in partition_values(self.spark, runs_path))
            removed += len(drop_partitions(self.spark, runs_path, lambda v: int(v) < last))
            log_path = f"{self.log_path}/metric_date={day}"
            removed += len(drop_partitions(self.spark, log_path, lambda v: int(v) <= newest))
        return removed

    def upsert_funnel_day(
        self, day: dt.date, updated_at: dt.datetime, oldest_kept: dt.date | None = None
    ) -> None:
        """Replace the day's funnel row. An empty day gives a row of zeros, so a day that
        retention may have cut is refused."""
        if oldest_kept is not None and day < oldest_kept:
            raise ValueError(f"{day} is before {oldest_kept}, the oldest day kept in full")
        row = funnel_day(self.raw_events(days=[day]), day, updated_at)
        write_partitions(row, self.funnel_path, "metric_date")

    def prune(self, oldest_kept: dt.date) -> int:
        """Drop whole days of raw events before ``oldest_kept``; returns the row count."""
        old = [day for day in self.raw_days() if dt.date.fromisoformat(day) < oldest_kept]
        rows = self.raw_events(days=old).count()
        for path in (self.manifest_path, self.merged_path, self.raw_path):
            drop_partitions(self.spark, path, lambda day: day in old)
        return rows

    def metric_days(self) -> list[str]:
        """Days that have metrics, oldest first."""
        paths = (self.snapshot_path, self.log_path)
        return sorted({day for path in paths for day, _ in partition_values(self.spark, path)})

    def roll_up(self) -> int:
        """Bring the month and all-time totals up to date; returns the months computed."""
        return self.totals.roll_up(self._month_measures, self.metric_days())

    def product_totals(self) -> DataFrame:
        """All-time measures per (product_id, product_name, product_category).

        Equal to adding up :meth:`measures`, but read from the totals: days are folded only in
        months that changed since :meth:`roll_up`.
        """
        return self.totals.read(self._month_measures, self.metric_days())

    def _month_measures(self, days: Sequence[str]) -> DataFrame:
        return self.measures([dt.date.fromisoformat(day) for day in days])

    def prune_rejected(self, oldest_kept: dt.date) -> int:
        """Drop the messages rejected before a day; returns the row count."""
        days = [day for day, _ in partition_values(self.spark, self.rejected_path)]
        old = [day for day in days if dt.date.fromisoformat(day) < oldest_kept]
        rows = self.rejected_events(old).count()
        drop_partitions(self.spark, self.rejected_path, lambda day: day in old)
        return rows

    def replay_rejected(
        self,
        fix: Callable[[DataFrame], DataFrame] | None = None,
        days: Sequence[dt.date | str] | None = None,
        horizon: dt.timedelta | None = None,
        now: dt.datetime | None = None,
    ) -> tuple[int, int]:
        """Land rejected messages again, as after a change of schema or limits; returns how
        many were taken and how many of them are rejected still.

        ``fix`` may change the messages (columns of KAFKA_SCHEMA) first. The replay is a landing
        batch with a number of its own, so the publishing stream takes it like any other and
        drops ids it knows; messages that fail again are rejected under the new number, today.
        The old rows go last. A replay that was cut off is repeated, with the rows and the number
        it had, before a new one starts.
        """
        plan = self._replay_plan(days)
        if plan is None:
            return 0, 0
        number, folders = plan["number"], plan["folders"]
        taken = still = 0
        if not plan["landed"]:
            schema = T.StructType([*REJECTED_EVENTS.fields, _REJECTED_ON, _BATCH])
            reader = self.spark.read.schema(schema).option("basePath", self.rejected_path)
            rows = reader.parquet(*folders)
            messages = rows.select(
                F.lit(None).cast("string").alias("key"),
                F.col("raw_value").alias("value"),
                F.col("kafka_topic").alias("topic"),
                F.col("kafka_partition").alias("partition"),
                F.col("kafka_offset").alias("offset"),
            )
            taken = rows.count()
            self.land_batch(messages if fix is None else fix(messages), number, horizon, now)
            still = self.rejected_events().filter(F.col("batch_id") == number).count()
            write_text(self.spark, self.replaying_path, json.dumps({**plan, "landed": True}))
        for folder in folders:
            drop_path(self.spark, folder)
        put_marker(self.spark, self.replays_path, number)
        drop_path(self.spark, self.replaying_path)
        return taken, still

    def _replay_plan(self, days: Sequence[dt.date | str] | None) -> dict | None:
        """Number and folders of the replay that was cut off, or else of a new one."""
        if table_exists(self.spark, self.replaying_path):
            return json.loads(read_text(self.spark, self.replaying_path))
        wanted = None if days is None else {str(day) for day in days}
        folders = [
            folder
            for day, path in partition_values(self.spark, self.rejected_path)
            if wanted is None or day in wanted
            for _, folder in partition_values(self.spark, path)
        ]
        if not folders:
            return None
        last = marker(self.spark, self.replays_path)
        number = REPLAYS if last is None else last + 1
        plan = {"number": number, "folders": folders, "landed": False}
        write_text(self.spark, self.replaying_path, json.dumps(plan))
        return plan

    def checked_up_to(self) -> dict[str, int] | None:
        """Batch and snapshot run up to which :meth:`mark_checked` was called."""
        if not table_exists(self.spark, self.checked_path):
            return None
        return json.loads(read_text(self.spark, self.checked_path))

    def mark_checked(self, batch: int, run: int) -> None:
        write_text(self.spark, self.checked_path, json.dumps({"batch": batch, "run": run}))

    def last_run(self) -> int:
        """Number of the newest snapshot run."""
        return max(self._runs().values(), default=0)

    def _runs(self) -> dict[str, int]:
        found = {}
        for day, path in partition_values(self.spark, self.snapshot_path):
            for _, version in partition_values(self.spark, path):
                runs = [int(run) for run, _ in partition_values(self.spark, version)]
                found[day] = max([found.get(day, 0), *runs])
        return found

    def changed_days(self, batch: int, run: int) -> list[str]:
        """Days with events of a batch after ``batch``, or with metrics that a later batch or
        snapshot run wrote, from listings and manifests alone."""
        days = {day for day, newest in self._runs().items() if newest > run}
        for root in (self.raw_path, self.log_path):
            for day, path in partition_values(self.spark, root):
                if any(int(n) > batch for n, _ in partition_values(self.spark, path)):
                    days.add(day)
        days |= {m.day for m in self._manifests().values() if max(m.batches, default=-1) > batch}
        return sorted(days)

    def compact_files(self, before: dt.date) -> int:
        """Merge the folders and files of each day before ``before``: the committed batches of
        its events into one, and its job runs; returns the number of days merged.

        Merged events keep their batch numbers. A day changes over with its manifest, after
        which the folders it covers go; a run that was cut off is finished by the next. Run it
        while nothing else reads those days.
        """
        self.finish_compaction()
        merged, last = 0, self.last_committed()
        with session_conf(self.spark, FILES_CONF):
            for day, path in partition_values(self.spark, self.raw_path):
                if last is None or dt.date.fromisoformat(day) >= before:
                    continue
                merged += self._compact_day(day, path, last)
            for day, path in partition_values(self.spark, self.runs_path):
                rows = self.spark.read.schema(JOB_RUNS).parquet(path)
                if dt.date.fromisoformat(day) < before and len(rows.inputFiles()) > 1:
                    staged = f"{self.compacting_path}/job_runs/run_date={day}"
                    rows.hint("rebalance").write.mode("overwrite").parquet(staged)
                    self.finish_compaction()
                    merged += 1
        return merged

    def _compact_day(self, day: str, path: str, last: int) -> bool:
        old = read_manifest(self.spark, self.manifest_path, day)
        covered = () if old is None else old.batches
        fresh = [int(n) for n, _ in partition_values(self.spark, path) if int(n) <= last]
        fresh = [n for n in fresh if n not in covered]
        if not fresh or (old is None and len(fresh) == 1):
            return False
        generation = 1 if old is None else old.generation + 1
        new = Manifest(day, generation, generation, tuple(sorted({*covered, *fresh})))
        rows = self.raw_events(last, [day]).drop("event_date")
        folder = f"{self.merged_path}/{new.folder}"
        rows.hint("rebalance").write.mode("overwrite").parquet(folder)
        # Another run may have cleaned up meanwhile.
        if not table_exists(self.spark, f"{folder}/_SUCCESS"):
            raise OSError(f"{folder} was deleted while it was written")
        write_manifest(self.spark, self.manifest_path, new)
        self._drop_covered(new)
        return True

    def _drop_covered(self, manifest: Manifest) -> None:
        """Delete what a day's manifest replaces: batch folders, merged folders, manifests."""
        day = f"event_date={manifest.day}"
        covered = set(manifest.batches)
        drop_partitions(self.spark, f"{self.raw_path}/{day}", lambda v: int(v) in covered)
        drop_partitions(
            self.spark, f"{self.merged_path}/{day}", lambda v: int(v) != manifest.merged
        )
        for generation, path in marked(self.spark, f"{self.manifest_path}/{day}"):
            if generation < manifest.generation:
                drop_path(self.spark, path)

    def finish_compaction(self) -> None:
        """Delete what merged days replace and merged folders that were never finished; put
        merged job runs in place."""
        finished = self._manifests()
        for manifest in finished.values():
            self._drop_covered(manifest)
        drop_partitions(self.spark, self.merged_path, lambda day: day not in finished)
        for day, staged in partition_values(self.spark, f"{self.compacting_path}/job_runs"):
            if table_exists(self.spark, f"{staged}/_SUCCESS"):
                place = f"{self.runs_path}/run_date={day}"
                drop_path(self.spark, place)
                rename(self.spark, staged, place)
        drop_path(self.spark, self.compacting_path)

"""The two streaming queries: land messages, then publish new events.

Landing is stateless. Publishing reads the landed files and keeps one key per event id
as state, so finding out whether an id was seen costs one lookup, not a scan of history.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clickfold.functions.clock import ntz, utc_now
from clickfold.operators.ingest import accepted, dedup, parse_events, tag_rejects
from clickfold.operators.serving import throughput
from clickfold.schemas import MAIN_TOPIC, RAW_EVENTS
from clickfold.session import STATE_STORE_CONF, session_conf
from clickfold.sources.tables import (
    drop_path,
    make_folder,
    marked,
    marker,
    partition_values,
    put_marker,
    table_exists,
)
from clickfold.streaming.store import AHEAD, REPLAYS, EventStore
from clickfold.streaming.windows import WindowTable

EVERY = "10 seconds"
LANDED = "landed"
LANDING = T.StructType([*RAW_EVENTS.fields, T.StructField("batch_id", T.LongType())])
BYTES_PER_STATE_PARTITION = 8 * 1024**3
FIRST_BATCH = "first_batch"
SEEDED = "seeded"
#: The landing batch of ids that were published before.
SEED = -1
#: Batches between two folds of the window counts.
FOLD_EVERY = 100
#: Batches of one publishing checkpoint, about six days at one every ten seconds.
RENEW_AFTER = 50_000


def _start(stream: DataFrame, on_batch, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    if every is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def _first_number(
    spark: SparkSession, checkpoint: str, last: int | None, first_batch: int | None
) -> int:
    """The number of the checkpoint's first batch, which is kept with the checkpoint.

    Batch ids start over without a checkpoint, so that the first number must then lie above
    all stored ones. A later start takes the kept number; another one is refused.
    """
    folder = f"{checkpoint}/{FIRST_BATCH}"
    kept = marker(spark, folder)
    if kept is None and table_exists(spark, f"{checkpoint}/offsets"):
        kept = 0
    if kept is not None:
        if first_batch not in (None, kept):
            raise ValueError(f"the batches of {checkpoint} start at {kept}, not {first_batch}")
        return kept
    first = first_batch or 0
    if last is not None and last >= first:
        raise ValueError(
            f"batch {last} is already stored but there is no checkpoint at {checkpoint}; "
            "set first_batch above it"
        )
    put_marker(spark, folder, first)
    return first


def start_landing(
    messages: DataFrame,
    store: EventStore,
    checkpoint: str,
    every: str | None = EVERY,
    first_batch: int | None = None,
    horizon: dt.timedelta | None = None,
) -> StreamingQuery:
    """Decode messages into the landing and rejected tables.

    ``every=None`` takes what is there and stops. ``first_batch`` numbers the batches of
    a new checkpoint and stays with it: 0 by default, after a lost checkpoint a number above
    ``store.last_landed()``. With a ``horizon`` (the one publishing has) events older than it
    land apart, and events far in the future are rejected.
    """
    first = _first_number(store.spark, checkpoint, store.last_landed(), first_batch)

    def land(batch: DataFrame, batch_id: int) -> None:
        store.land_batch(batch, first + batch_id, horizon)

    return _start(messages, land, checkpoint, every)


def unique_events(events: DataFrame, horizon: dt.timedelta | None = None) -> DataFrame:
    """Keep the first event of each id on a stream.

    Without a horizon ids are remembered for good. With one, an id is forgotten once event
    time has moved on so far. Landed events are never that late: when they landed they were
    younger than the horizon, and event time is at most :data:`AHEAD` ahead of the clock.
    """
    if horizon is None:
        return events.dropDuplicates(["event_id"])
    delay = f"{int((horizon + AHEAD).total_seconds()) + 1} seconds"
    timed = events.withColumn("_at", F.col("created_at").cast("timestamp"))
    unique = timed.withWatermark("_at", delay).dropDuplicatesWithinWatermark(["event_id"])
    return unique.drop("_at")


def refuse_drops(query: StreamingQuery) -> None:
    """Fail when the watermark dropped rows, which it never should."""
    for progress in query.recentProgress:
        for state in progress.stateOperators:
            if state.numRowsDroppedByWatermark:
                query.stop()
                raise RuntimeError(
                    f"batch {progress.batchId} dropped {state.numRowsDroppedByWatermark} events"
                )


def state_partitions_for(total_bytes: int) -> int:
    """State partitions for that much event data within the horizon, or over the life of the
    stream without one: a partition's ids stay a few gigabytes, and even a small stream uses
    several cores."""
    return max(8, total_bytes // BYTES_PER_STATE_PARTITION)


def start_publishing(
    store: EventStore,
    checkpoint: str,
    every: str | None = EVERY,
    horizon: dt.timedelta | None = None,
    recheck_stored: bool = False,
    source_options: dict[str, str] | None = None,
    state_partitions: int | None = None,
    first_batch: int | None = None,
) -> StreamingQuery:
    """Publish landed events to ``raw_events`` and the metric log.

    With a ``horizon`` (the one landing has) the state is bounded: events that landed apart
    as late are compared with the stored ids of their days instead, and join the next batch.

    ``state_partitions`` (by default the session's shuffle partitions) is fixed at the
    first start and stays with the checkpoint; size it for all ids to be remembered, see
    :func:`state_partitions_for`. ``source_options`` go to the file source:
    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` bound a batch.

    After a lost checkpoint the state is empty: start with ``first_batch`` above
    ``store.last_committed()`` and ``recheck_stored=True``, which first feeds the stored ids
    through the stream, see :func:`_seed`. That scans the id column once; all later batches
    look ids up in the state alone.
    """
    spark = store.spark
    first = _first_number(spark, checkpoint, store.last_committed(), first_batch)
    conf = dict(STATE_STORE_CONF)
    if state_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(state_partitions)

    def start(every: str | None, options: dict[str, str], stored: int | None) -> StreamingQuery:
        def publish(events: DataFrame, batch_id: int) -> None:
            new = events.filter(F.col("batch_id") != SEED).drop("batch_id")
            if stored is not None:
                new = dedup(new, store.raw_events(stored))
            number = first + batch_id
            store.publish_batch(new, number, store.take_late(number))

        with session_conf(spark, conf):
            landed = unique_events(_landed(store, options), horizon)
            return _start(landed, publish, checkpoint, every)

    # The file source insists on an existing folder.
    make_folder(spark, store.landing_path)
    if recheck_stored and marker(spark, f"{checkpoint}/{SEEDED}") is None:
        _seed(store, first, horizon)
        # While seeds and events meet in a batch, either may come first: compare once more.
        seeding = start(None, {}, first - 1)
        seeding.awaitTermination()
        drop_path(spark, f"{store.landing_path}/batch_id={SEED}")
        put_marker(spark, f"{checkpoint}/{SEEDED}", first)
    return start(every, source_options or {}, None)


def published_batches(spark: SparkSession, checkpoint: str) -> int:
    """Batches a checkpoint has begun."""
    return max((number for number, _ in marked(spark, f"{checkpoint}/offsets")), default=-1) + 1


def start_renewed(
    store: EventStore,
    root: str,
    every: str | None = EVERY,
    horizon: dt.timedelta | None = None,
    renew_after: int = RENEW_AFTER,
    first_batch: int | None = None,
    recheck_stored: bool = False,
    **options,
) -> StreamingQuery:
    """:func:`start_publishing` with a checkpoint that does not grow for ever.

    The file source keeps a log of every file it has read. Checkpoints therefore lie in folders
    ``epoch=0``, ``epoch=1``, … under ``root``; when the newest has begun ``renew_after`` batches,
    the next start opens another one, whose batches are numbered on and whose state is filled
    with the stored ids, one scan of them per epoch. An unfinished batch of the old epoch is
    repeated under its number, and older epochs are deleted once the new one is filled.
    """
    spark = store.spark
    epochs = sorted(int(value) for value, _ in partition_values(spark, root))
    if not epochs and table_exists(spark, f"{root}/offsets"):
        # A checkpoint from before there were epochs.
        newest, folder = -1, root
    else:
        newest = epochs[-1] if epochs else 0
        folder = f"{root}/epoch={newest}"
    if published_batches(spark, folder) >= renew_after:
        newest += 1
        folder = f"{root}/epoch={newest}"
    renewed = newest > 0 or (newest == 0 and table_exists(spark, f"{root}/offsets"))
    if renewed and marker(spark, f"{folder}/{FIRST_BATCH}") is None:
        last = store.last_committed()
        first_batch = 0 if last is None else last + 1
    query = start_publishing(
        store,
        folder,
        every,
        horizon,
        recheck_stored or renewed,
        first_batch=first_batch,
        **options,
    )
    for value, path in partition_values(spark, root):
        if int(value) < newest:
            drop_path(spark, path)
    return query


def _landed(store: EventStore, options: dict[str, str]) -> DataFrame:
    """The landed files as a stream, which reports the newest batch it saw."""
    own = F.when(F.col("batch_id") < REPLAYS, F.col("batch_id"))
    files = store.spark.readStream.schema(LANDING).options(**options).parquet(store.landing_path)
    return files.observe(LANDED, F.max(own).alias("newest"))


def _seed(store: EventStore, first: int, horizon: dt.timedelta | None) -> None:
    """Land the ids stored before batch ``first`` as rows that only fill the state.

    One pass over two columns, in place of one per batch. With a horizon, events that it
    would have forgotten stay out: a copy of those lands apart and is looked up on its day.
    """
    ids = store.raw_events(first - 1).select("event_id", "created_at")
    if horizon is not None:
        ids = ids.filter(F.col("created_at") >= ntz(utc_now() - horizon - AHEAD))
    empty = [
        F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_EVENTS if f.name not in ids.columns
    ]
    seeds = ids.select("*", *empty).select(*RAW_EVENTS.names)
    seeds.write.mode("overwrite").parquet(f"{store.landing_path}/batch_id={SEED}")


def clean_landing(store: EventStore, publishing: StreamingQuery) -> int:
    """Delete landed batches that were published, so that the source has few folders to
    list; returns how many.

    Batches are published in the order they land, so once a committed batch held files
    of landing batch ``n`` all earlier ones are done.
    """
    for progress in reversed(publishing.recentProgress):
        newest = progress.observedMetrics.get(LANDED)
        if newest is not None and newest.newest is not None:
            return store.clean_landing(newest.newest)
    return 0


def run_available(
    messages: DataFrame,
    store: EventStore,
    checkpoint: str,
    source_options: dict[str, str] | None = None,
    state_partitions: int | None = None,
    horizon: dt.timedelta | None = None,
) -> None:
    """Land and publish everything available, then return."""
    landing = start_landing(messages, store, f"{checkpoint}/land", None, horizon=horizon)
    landing.awaitTermination()
    publishing = start_publishing(
        store,
        f"{checkpoint}/publish",
        None,
        horizon,
        source_options=source_options,
        state_partitions=state_partitions,
    )
    publishing.awaitTermination()
    refuse_drops(publishing)


def live_throughput(messages: DataFrame, seconds: int = 10) -> DataFrame:
    """Arrivals per window as a streaming table, for an update sink.

    Reads the main topic alone, which carries every event once. Windows stay open, so that
    late arrivals count; the state is one row per window of the stream's life. For a stream
    that runs for long use :func:`start_throughput`, which needs no state.
    """
    main = messages.filter(F.col("topic") == MAIN_TOPIC)
    events = accepted(tag_rejects(parse_events(main)))
    timed = events.withColumn("event_at", F.col("created_at").cast("timestamp"))
    return throughput(timed, seconds, time="event_at")


def start_throughput(
    messages: DataFrame,
    windows: WindowTable,
    checkpoint: str,
    every: str | None = EVERY,
    seconds: int = 10,
    first_batch: int | None = None,
    fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Add each batch's arrivals per window to ``windows``; folded every so many batches.

    The stream is stateless, and late arrivals add to their old windows, however old.
    ``first_batch`` as in :func:`start_landing`.
    """
    spark = windows.spark
    first = _first_number(spark, checkpoint, windows.last_counted(), first_batch)

    def count(batch: DataFrame, batch_id: int) -> None:
        windows.count_batch(batch, first + batch_id, seconds)
        if batch_id % fold_every == fold_every - 1:
            windows.fold()

    return _start(messages, count, checkpoint, every)

"""The checked queries: every operator run over the whole star-schema tables.

Each callable takes (spark, sf_dir). Results carry doubles for decimals and text for
dates and times, so that any two engines compare them alike.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfold.functions.clock import iso_utc
from clickfold.operators import (
    funnels,
    merging,
    products,
    quality,
    retention,
    routing,
    serving,
)
from clickfold.operators.audit import FAILED, SUCCESS, run_summary
from clickfold.operators.ingest import accepted, dedup, parse_events, rejected, tag_rejects
from clickfold.operators.measures import measure
from clickfold.operators.staging import on_day, stage
from clickfold.plans.marts import FUNNEL_MART, PRODUCT_MART, build_marts, read_mart
from clickfold.schemas import KAFKA_SCHEMA, MAIN_TOPIC, METRIC_KEYS, RAW_EVENTS
from clickfold.session import batch_conf, scratch_dir, session_conf
from clickfold.sources.kafka import read_event_stream
from clickfold.sources.star_events import (
    bare_events,
    log_position,
    raw_events,
    with_locations,
    with_products,
)
from clickfold.sources.tables import partition_values, read_table, table_bytes
from clickfold.streaming.live import (
    start_landing,
    start_publishing,
    start_throughput,
    state_partitions_for,
)
from clickfold.streaming.store import REPLAYS, EventStore
from clickfold.streaming.windows import WindowTable

Query = Callable[[SparkSession, str], DataFrame]

DAY = dt.date(2024, 1, 5)
EMPTY_DAY = dt.date(2023, 12, 25)
SEEN_BEFORE = dt.date(2024, 1, 4)
REPLACE_FROM = dt.date(2024, 1, 10)
CUTOFF = dt.datetime(2024, 1, 15)
NARROW_LIMITS = {"event_type": 5, "product_name": 10, "product_price": T.DecimalType(4, 2)}

# A streaming check takes about four micro-batches.
MICRO_BATCHES = 4


def plain(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = iso_utc(column)
        columns.append(column.alias(field.name))
    return df.select(*columns)


# --- inputs ----------------------------------------------------------------------


def _by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-time measures per product, named after the aggregation."""
    return with_products(measure(bare_events(spark, sf_dir), "product_id"), spark, sf_dir)


def _named(metrics: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_products(metrics, spark, sf_dir, category="category")


def _morning(events: DataFrame) -> DataFrame:
    return events.filter(F.hour("created_at") < 12)


def _afternoon(events: DataFrame) -> DataFrame:
    return events.filter(F.hour("created_at") >= 12)


def _messages(events: DataFrame) -> DataFrame:
    """The events fanned out to their topics, as a log would hold them."""
    return log_position(routing.route_to_topics(events, "event_id")).select(*KAFKA_SCHEMA.names)


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid events as read back from the log, copies included."""
    return accepted(tag_rejects(parse_events(_messages(bare_events(spark, sf_dir)))))


# --- staging, marts, day metrics ---------------------------------------------------


def stg_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(raw_events(spark, sf_dir)).drop("session_id")


def product_metrics_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = on_day(bare_events(spark, sf_dir), DAY)
    return _named(products.product_metrics(day), spark, sf_dir)


def product_metrics_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = measure(stage(bare_events(spark, sf_dir)), "event_date", "product_id")
    return products.product_metrics_daily(with_products(daily, spark, sf_dir))


def funnel_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnels.funnel_analysis(stage(bare_events(spark, sf_dir)))


def _mart(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = scratch_dir(spark, "marts")
        events = bare_events(spark, sf_dir)
        # Names are looked up for the aggregated rows only.
        build_marts(spark, events, out, name=lambda d: with_products(d, spark, sf_dir))
        return read_mart(spark, out, name)

    return query


def _funnel_on(day: dt.date) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return funnels.funnel_day(bare_events(spark, sf_dir), day).drop("updated_at")

    return query


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.batch_summary(
        products.product_metrics(on_day(bare_events(spark, sf_dir), DAY))
    )


def batch_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = products.product_metrics(on_day(bare_events(spark, sf_dir), DAY))
    return _named(products.batch_top(day), spark, sf_dir)


# --- serving -----------------------------------------------------------------------


def kpi_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.kpi_totals(bare_events(spark, sf_dir))


def events_per_sec(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An hour rather than ten seconds, so that a sparse table has something to count.
    events = bare_events(spark, sf_dir)
    # One value; as a literal the bound reaches the scan.
    newest = events.agg(F.max("created_at")).first()[0]
    last_10s = serving.events_per_sec(events, newest)
    last_hours = serving.events_per_sec(events, newest, seconds=3600)
    return last_10s.select(F.lit(10).alias("seconds"), "events_per_sec").unionByName(
        last_hours.select(F.lit(3600).alias("seconds"), "events_per_sec")
    )


def _latest(event_type: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        latest = serving.latest_events(bare_events(spark, sf_dir), 50, event_type)
        named = with_locations(with_products(latest, spark, sf_dir), spark, sf_dir)
        return named.drop("session_id")

    return query


def top_products_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.top_products(_by_product(spark, sf_dir))


def top_products_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.top_products_revenue(_by_product(spark, sf_dir))


def revenue_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.revenue_on(bare_events(spark, sf_dir), DAY)


def funnel_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnels.funnel_overall(bare_events(spark, sf_dir))


def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.category_breakdown(_by_product(spark, sf_dir))


def throughput_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.throughput(bare_events(spark, sf_dir))


# --- upserts -----------------------------------------------------------------------


def merge_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mornings, then afternoons added: together the whole days."""
    events = bare_events(spark, sf_dir)
    current = products.product_metrics(_morning(events))
    merged = merging.merge_add(current, products.product_metrics(_afternoon(events)))
    return _named(merged, spark, sf_dir)


def merge_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morning figures everywhere, replaced by whole days from a date on."""
    events = bare_events(spark, sf_dir)
    from_start = dt.datetime.combine(REPLACE_FROM, dt.time())
    recent = events.filter(F.col("created_at") >= F.lit(from_start).cast("timestamp_ntz"))
    merged = merging.merge_replace(
        products.product_metrics(_morning(events)), products.product_metrics(recent)
    )
    return _named(merged, spark, sf_dir)


def upsert_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morning funnels of all days, one of them replaced by the whole day's."""
    events = bare_events(spark, sf_dir)
    current = funnels.funnel_analysis(stage(_morning(events))).select(
        F.col("event_date").alias("metric_date"),
        "total_views",
        "total_clicks",
        "total_purchases",
        F.col("view_to_click_rate").alias("view_to_click_pct"),
        F.col("click_to_purchase_rate").alias("click_to_purchase_pct"),
        F.col("overall_conversion_rate").alias("overall_conversion_pct"),
    )
    return merging.upsert_funnel(current, funnels.funnel_day(events, DAY).drop("updated_at"))


# --- messages ----------------------------------------------------------------------


def route_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_to_topics(bare_events(spark, sf_dir)).select(
        "topic", "key", F.get_json_object("value", "$.event_id").alias("event_id")
    )


def parse_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON and read back."""
    events = with_products(bare_events(spark, sf_dir), spark, sf_dir)
    return parse_events(_messages(events)).drop("raw_value", "location", "session_id")


def rejected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages broken on purpose, one of seven in each of six ways, on all topics."""
    messages = _messages(bare_events(spark, sf_dir))
    kind = F.col("offset") % 7
    value = F.col("value")
    cut = F.substring(value, F.lit(1), F.length(value) - 5)
    ways = [
        cut,
        F.regexp_replace(value, r'"timestamp":"[^"]*"', '"timestamp":"soon"'),
        F.regexp_replace(value, r'"timestamp":"[^"]*"', '"timestamp":"12:30:00"'),
        F.regexp_replace(value, r'"event_id":"[^"]*"', '"event_id":null'),
        F.regexp_replace(value, r'"event_type":"[^"]*"', f'"event_type":"{"X" * 21}"'),
        F.regexp_replace(value, r'"product_price":[^,}]*', '"product_price":1e9'),
    ]
    broken = value
    for number, way in enumerate(ways):
        broken = F.when(kind == number, way).otherwise(broken)
    bad = rejected(tag_rejects(parse_events(messages.withColumn("value", broken))))
    return bad.select("kafka_topic", "kafka_partition", "kafka_offset", "reject_reason")


def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per id of the log, without the ids of the first days, seen before."""
    events = bare_events(spark, sf_dir)
    start = dt.datetime.combine(SEEN_BEFORE, dt.time())
    before = events.filter(F.col("created_at") < F.lit(start).cast("timestamp_ntz"))
    seen = before.select(F.col("event_id").cast("string").alias("event_id"))
    return dedup(_delivered(spark, sf_dir), seen).select(
        "event_id", "event_type", "product_price", "created_at", "kafka_topic", "kafka_offset"
    )


def topic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.topic_stats(_delivered(spark, sf_dir)).drop("recorded_at")


# --- retention, checks, audit --------------------------------------------------------


def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.retain(bare_events(spark, sf_dir), CUTOFF).select(
        "event_id", "event_type", "created_at"
    )


def retention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.retention_counts(bare_events(spark, sf_dir), CUTOFF)


def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_unique(_delivered(spark, sf_dir), ["event_id"])


def dq_unique_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per (date, product) beyond the first: the key is not unique on events."""
    dated = bare_events(spark, sf_dir).withColumn("metric_date", F.to_date("created_at"))
    return quality.check_unique(dated, ["metric_date", "product_id"])


def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls per column; those of the looked-up name from counts per product."""
    events = bare_events(spark, sf_dir)
    own = quality.check_not_null(events, ["event_id", "event_type", "created_at", "session_id"])
    counted = events.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    unnamed = F.when(F.col("product_name").isNull(), F.col("n"))
    looked_up = with_products(counted, spark, sf_dir).select(
        F.lit("product_name").alias("column_name"),
        F.coalesce(F.sum(unnamed), F.lit(0)).alias("null_rows"),
    )
    return own.unionByName(looked_up)


def dq_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over each limit; those of the looked-up name from counts per product."""
    events = bare_events(spark, sf_dir)
    own = {k: v for k, v in NARROW_LIMITS.items() if k != "product_name"}
    counted = events.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    wide = F.when(F.length("product_name") > NARROW_LIMITS["product_name"], F.col("n"))
    looked_up = with_products(counted, spark, sf_dir).select(
        F.lit("product_name").alias("column_name"),
        F.coalesce(F.sum(wide), F.lit(0)).alias("failing_rows"),
    )
    return quality.limit_counts(events, own).unionByName(looked_up)


def dq_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = with_products(bare_events(spark, sf_dir), spark, sf_dir)
    broken = quality.check_limits(events, NARROW_LIMITS)
    return broken.select("event_id", F.array_join("violations", "; ").alias("violations"))


def run_summary_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's events of a type taken as one job run."""
    failed = F.col("event_type") == "ERROR"
    runs = (
        bare_events(spark, sf_dir)
        .groupBy("event_type", F.to_date("created_at").alias("day"))
        .agg(
            F.min("created_at").alias("started_at"),
            F.max("created_at").alias("finished_at"),
            F.count(F.lit(1)).alias("records_processed"),
        )
        .select(
            F.lower("event_type").alias("dag_id"),
            F.when(failed, FAILED).otherwise(SUCCESS).alias("status"),
            "started_at",
            "finished_at",
            "records_processed",
            F.when(failed, F.concat(F.lit("failed on "), F.col("day"))).alias("error_message"),
        )
    )
    return run_summary(runs)


# --- streams -----------------------------------------------------------------------


class _ReplayingStore(EventStore):
    """Runs every batch twice, as after a crash just before the batch was committed."""

    def land_batch(self, *args, **options) -> None:
        super().land_batch(*args, **options)
        super().land_batch(*args, **options)

    def publish_batch(self, *args, **options) -> None:
        super().publish_batch(*args, **options)
        super().publish_batch(*args, **options)


def _quarters(spark: SparkSession, path: str) -> dict[str, str]:
    quarter = max(1, table_bytes(spark, path) // MICRO_BATCHES)
    return {"maxBytesPerTrigger": str(quarter)}


def _streamed(
    spark: SparkSession, sf_dir: str, store_type: type[EventStore] = EventStore
) -> EventStore:
    """Send the events through files, the landing and the publishing stream."""
    root = scratch_dir(spark, "stream")
    log = f"{root}/log"
    events = with_products(bare_events(spark, sf_dir), spark, sf_dir)
    # One folder per topic, so the copies of an event are delivered apart.
    _messages(events).write.partitionBy("topic").parquet(log)
    store = store_type(spark, f"{root}/store")
    messages = read_event_stream(spark, _quarters(spark, log), log)
    start_landing(messages, store, f"{root}/land", None).awaitTermination()
    start_publishing(
        store,
        f"{root}/publish",
        None,
        source_options=_quarters(spark, store.landing_path),
        state_partitions=max(
            state_partitions_for(table_bytes(spark, store.landing_path)),
            spark.sparkContext.defaultParallelism,
        ),
    ).awaitTermination()
    return store


_STORED: dict[tuple[str, str], EventStore] = {}
STORE_BATCHES = 3
STORE_NOW = dt.datetime(2024, 1, 31)
STORE_HORIZON = dt.timedelta(days=14)


def _publish_part(store: EventStore, messages: DataFrame, number: int) -> None:
    """Land and publish the messages that belong to a batch, the copies of an event being in
    different ones."""
    part = F.pmod(F.col("offset") + (F.col("topic") != MAIN_TOPIC).cast("int"), F.lit(STORE_BATCHES))
    store.land_batch(messages.filter(part == number), number, STORE_HORIZON, STORE_NOW)
    events = dedup(_landed(store, number), store.raw_events(number - 1))
    # What landed so far covers the batch and the stored ids it is compared with.
    landed = table_bytes(store.spark, store.landing_path)
    with session_conf(store.spark, batch_conf(store.spark, landed)):
        store.publish_batch(events, number, store.take_late(number))


def _landed(store: EventStore, number: int) -> DataFrame:
    batch = T.StructField("batch_id", T.LongType())
    return read_table(store.spark, store.landing_path, RAW_EVENTS, [batch], [number])


def _stored(spark: SparkSession, sf_dir: str) -> EventStore:
    """A store filled by batches, half of the days late, then compacted: what production reads.
    Built once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _STORED:
        return _STORED[key]
    store = EventStore(spark, scratch_dir(spark, "store"))
    messages = _messages(raw_events(spark, sf_dir))
    for number in range(STORE_BATCHES):
        _publish_part(store, messages, number)
    metrics = [day for day, _ in partition_values(spark, store.log_path)]
    store.compact([dt.date.fromisoformat(day) for day in metrics])
    store.vacuum()
    store.compact_files(dt.date(9999, 12, 31))
    store.roll_up()
    _STORED[key] = store
    return store


def store_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after a compaction and a repeat of the last batch by a new process, as after a
    crash between the store's commit and Spark's."""
    root = scratch_dir(spark, "repeated")
    messages = _messages(raw_events(spark, sf_dir))
    store = EventStore(spark, root)
    for number in range(STORE_BATCHES):
        _publish_part(store, messages, number)
    store.compact_files(dt.date(9999, 12, 31))
    restarted = EventStore(spark, root)
    _publish_part(restarted, messages, STORE_BATCHES - 1)
    return _stored_events(restarted)


def store_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as of each batch, read from compacted days."""
    store = _stored(spark, sf_dir)
    versions = [
        store.raw_events(number).select(
            F.lit(number).alias("as_of"), "event_id", "event_type", "event_date"
        )
        for number in range(STORE_BATCHES)
    ]
    return reduce(DataFrame.unionByName, versions)


def store_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_events(_stored(spark, sf_dir))


def store_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).product_metrics()


def store_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.kpi_totals(_stored(spark, sf_dir).measures())


def store_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.top_products(_stored(spark, sf_dir).measures())


def store_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnels.funnel_overall(_stored(spark, sf_dir).measures())


def store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = _stored(spark, sf_dir).latest_events(50).drop("session_id")
    return latest.withColumns(
        {
            "event_id": F.col("event_id").cast("long"),
            "product_id": F.col("product_id").cast("int"),
            "user_id": F.col("user_id").cast("long"),
        }
    )


def store_unique_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, product) of the metrics, one day of them given twice, so that there is something
    to find."""
    store = _stored(spark, sf_dir)
    twice = store.product_metrics().unionByName(store.product_metrics([DAY]))
    return quality.check_unique(twice, METRIC_KEYS)


def store_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals per window as a stream adds them up, late ones included."""
    root = scratch_dir(spark, "throughput")
    _messages(bare_events(spark, sf_dir)).write.parquet(f"{root}/log")
    messages = read_event_stream(spark, _quarters(spark, f"{root}/log"), f"{root}/log")
    windows = WindowTable(spark, f"{root}/windows")
    start_throughput(
        messages, windows, f"{root}/checkpoint", None, fold_every=2
    ).awaitTermination()
    return windows.rates()


def store_total_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.kpi_totals(_stored(spark, sf_dir).product_totals())


def store_total_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.top_products(_stored(spark, sf_dir).product_totals())


def store_total_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.category_breakdown(_stored(spark, sf_dir).product_totals())


def store_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which two in seven are rejected; a fix of one kind, then a replay. Stored
    events, and messages that are rejected still."""
    store = EventStore(spark, scratch_dir(spark, "replayed"))
    messages = _messages(bare_events(spark, sf_dir))
    kind, value = F.col("offset") % 7, F.col("value")
    marked = F.regexp_replace(value, r'"timestamp":"', '"timestamp":"!')
    wide = F.regexp_replace(value, r'"event_type":"[^"]*"', f'"event_type":"{"X" * 21}"')
    broken = F.when(kind == 2, marked).when(kind == 5, wide).otherwise(value)
    store.land_batch(messages.withColumn("value", broken), 0)
    store.publish_batch(_landed(store, 0), 0)
    unmarked = F.regexp_replace("value", r'"timestamp":"!', '"timestamp":"')
    store.replay_rejected(lambda m: m.withColumn("value", unmarked))
    store.publish_batch(dedup(_landed(store, REPLAYS), store.raw_events(0)), 1)
    events = store.raw_events().select("event_id", F.lit("stored").alias("state"))
    rejects = store.rejected_events().select(
        F.get_json_object("raw_value", "$.event_id").alias("event_id"),
        F.concat_ws(" on ", F.lit("rejected"), "kafka_topic").alias("state"),
    )
    return events.unionByName(rejects)


def _stored_events(store: EventStore) -> DataFrame:
    return store.raw_events().select(
        "event_id",
        "event_type",
        "product_id",
        "product_name",
        "product_category",
        "product_price",
        "user_id",
        "created_at",
        "event_date",
    )


def stream_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_events(_streamed(spark, sf_dir))


def stream_product_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics from the log, one day of them recomputed from its events."""
    store = _streamed(spark, sf_dir)
    store.replace_day(DAY)
    return store.product_metrics()


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, _ReplayingStore).product_metrics()


QUERIES: dict[str, Query] = {
    "stg_events": stg_events,
    "product_metrics_day": product_metrics_day,
    "product_metrics_daily": product_metrics_daily,
    "funnel_analysis": funnel_analysis,
    "mart_product_metrics_daily": _mart(PRODUCT_MART),
    "mart_funnel_analysis": _mart(FUNNEL_MART),
    "funnel_day": _funnel_on(DAY),
    "funnel_empty_day": _funnel_on(EMPTY_DAY),
    "kpi_totals": kpi_totals,
    "events_per_sec": events_per_sec,
    "latest_events": _latest("ALL"),
    "latest_purchases": _latest("PURCHASE"),
    "top_products_8": top_products_8,
    "batch_top5": batch_top5,
    "funnel_overall": funnel_overall,
    "category_breakdown": category_breakdown,
    "top_products_revenue": top_products_revenue,
    "revenue_on_day": revenue_on_day,
    "batch_summary": batch_summary,
    "merge_add": merge_add,
    "merge_replace": merge_replace,
    "upsert_funnel": upsert_funnel,
    "route_topics": route_topics,
    "parse_events": parse_messages,
    "rejected_events": rejected_events,
    "dedup_events": dedup_events,
    "topic_stats": topic_stats,
    "throughput_10s": throughput_10s,
    "retention_keep": retention_keep,
    "retention_counts": retention_counts,
    "dq_unique": dq_unique,
    "dq_unique_metrics": dq_unique_metrics,
    "dq_not_null": dq_not_null,
    "dq_widths": dq_widths,
    "dq_violations": dq_violations,
    "run_summary": run_summary_by_type,
    "stream_raw": stream_raw,
    "stream_product_metrics": stream_product_metrics,
    "stream_replay": stream_replay,
    "store_raw": store_raw,
    "store_repeated": store_repeated,
    "store_as_of": store_as_of,
    "store_metrics": store_metrics,
    "store_kpis": store_kpis,
    "store_top_products": store_top_products,
    "store_funnel": store_funnel,
    "store_latest": store_latest,
    "store_unique_metrics": store_unique_metrics,
    "store_throughput": store_throughput,
    "store_total_kpis": store_total_kpis,
    "store_total_products": store_total_products,
    "store_total_categories": store_total_categories,
    "store_replayed": store_replayed,
}


def _in_plain_types(query: Query) -> Query:
    return lambda spark, sf_dir: plain(query(spark, sf_dir))


def checked_queries() -> dict[str, Query]:
    return {name: _in_plain_types(query) for name, query in QUERIES.items()}

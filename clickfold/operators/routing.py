"""Topic fan-out and topic statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.functions.clock import iso_utc, ntz
from clickfold.schemas import (
    CLICK,
    CLICK_TOPIC,
    MAIN_TOPIC,
    PURCHASE,
    PURCHASE_TOPIC,
    TOPIC_STATS,
    WIRE_SCHEMA,
)


def topics_of(event_type: Column) -> Column:
    """Every event goes to the main topic, clicks and purchases to one more."""
    main = F.lit(MAIN_TOPIC)
    return (
        F.when(event_type == CLICK, F.array(main, F.lit(CLICK_TOPIC)))
        .when(event_type == PURCHASE, F.array(main, F.lit(PURCHASE_TOPIC)))
        .otherwise(F.array(main))
    )


def wire_json(event_time: str = "created_at") -> Column:
    """The event as a JSON message; null fields are left out."""
    fields = []
    for field in WIRE_SCHEMA:
        is_time = field.name == "timestamp"
        value = iso_utc(F.col(event_time)) if is_time else F.col(field.name).cast(field.dataType)
        fields += [F.lit(field.name), value]
    return F.to_json(F.named_struct(*fields))


def route_to_topics(events: DataFrame, *carry: Column | str) -> DataFrame:
    """Messages ready for a Kafka sink: topic, key (product id) and JSON value."""
    return events.select(
        F.explode(topics_of(F.col("event_type"))).alias("topic"),
        F.col("product_id").cast("string").alias("key"),
        wire_json().alias("value"),
        *carry,
    )


def topic_counts(messages: DataFrame, *extra: Column) -> DataFrame:
    """Messages and offset range per topic partition."""
    return messages.groupBy("kafka_topic", "kafka_partition").agg(
        F.count(F.lit(1)).alias("messages"),
        F.min("kafka_offset").alias("first_offset"),
        F.max("kafka_offset").alias("last_offset"),
        *extra,
    )


def merge_topic_counts(counts: DataFrame) -> DataFrame:
    """Counts of several batches as one."""
    return counts.groupBy("kafka_topic", "kafka_partition").agg(
        F.sum("messages").alias("messages"),
        F.min("first_offset").alias("first_offset"),
        F.max("last_offset").alias("last_offset"),
    )


def topic_totals(
    counts: DataFrame, recorded_at: dt.datetime | Column | None = None
) -> DataFrame:
    """Messages and last offset per topic; ``offset_span`` adds up the offset ranges of
    the partitions and so also covers messages that were not received."""
    stamp = F.lit(None).cast("timestamp_ntz") if recorded_at is None else ntz(recorded_at)
    return (
        counts.groupBy(F.col("kafka_topic").alias("topic_name"))
        .agg(
            F.sum("messages").alias("message_count"),
            F.max("last_offset").alias("last_offset"),
            F.sum(F.col("last_offset") - F.col("first_offset") + 1).alias("offset_span"),
        )
        .withColumn("recorded_at", stamp)
        .select(*TOPIC_STATS.names)
    )


def topic_stats(messages: DataFrame, recorded_at: dt.datetime | Column | None = None) -> DataFrame:
    return topic_totals(topic_counts(messages), recorded_at)

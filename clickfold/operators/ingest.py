"""From log messages to clean, unique events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickfold.functions.clock import ntz, parse_instant
from clickfold.operators.quality import any_of, over_limits, violations
from clickfold.schemas import (
    MAIN_TOPIC,
    PRICE,
    RAW_EVENTS,
    REJECTED_EVENTS,
    REQUIRED,
    TEXT_LIMITS,
    WIRE_SCHEMA,
)

_REASON = "reject_reason"


def parse_events(messages: DataFrame) -> DataFrame:
    """Decode the JSON value by the fixed schema and flatten it.

    Fields that do not fit their type, and all fields of a text that is not JSON,
    come out null. The price keeps its wire type until :func:`split_valid`.
    """
    texts = messages.select(
        F.col("value").cast("string").alias("raw_value"),
        F.col("offset").alias("kafka_offset"),
        F.col("partition").alias("kafka_partition"),
        F.col("topic").alias("kafka_topic"),
    )
    # Decode each text exactly once. The stated mode keeps the optimizer from splitting
    # the parse into one per field, and the one-element explode keeps later filters from
    # being pushed below the parse and repeating it.
    event = F.from_json("raw_value", WIRE_SCHEMA, {"mode": "PERMISSIVE"})
    decoded = texts.select("*", F.explode(F.array(event)).alias("e"))
    fields = [f"e.{name}" for name in WIRE_SCHEMA.names if name != "timestamp"]
    return decoded.select(
        *fields,
        parse_instant(F.col("e.timestamp")).alias("created_at"),
        "kafka_offset",
        "kafka_partition",
        "kafka_topic",
        "raw_value",
    )


def _reason(latest: dt.datetime | None) -> Column:
    """What is wrong with a message; null, at the cost of the conditions only, if nothing."""
    checks = [(F.col(c).isNull(), f"{c} missing") for c in REQUIRED]
    if latest is not None:
        checks.append((F.col("created_at") > ntz(latest), "created_at ahead"))
    checks += over_limits({**TEXT_LIMITS, "product_price": PRICE})
    return F.when(any_of(checks), F.concat_ws("; ", *violations(checks)))


def tag_rejects(parsed: DataFrame, latest: dt.datetime | None = None) -> DataFrame:
    """Add ``reject_reason`` (null for a good event); only rejects keep their text. An event
    after ``latest``, where given, is a reject."""
    tagged = parsed.withColumn(_REASON, _reason(latest))
    return tagged.withColumns(
        {
            "raw_value": F.when(F.col(_REASON).isNotNull(), F.col("raw_value")),
            "product_price": F.col("product_price").try_cast(PRICE),
        }
    )


def accepted(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col(_REASON).isNull()).select(*RAW_EVENTS.names)


def rejected(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col(_REASON).isNotNull()).select(*REJECTED_EVENTS.names)


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events in stored types, and rejected messages with their reasons."""
    tagged = tag_rejects(parsed)
    return accepted(tagged), rejected(tagged)


def dedup(batch: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One row per ``event_id``, and none whose id is in ``seen``.

    The copy on the main topic wins, then the lowest log position, so a replay keeps
    the same rows. The ``= 1`` rank limit also runs before the shuffle: each task
    sends at most one copy of an id, however many there are. The anti-join reuses
    the shuffle on ``event_id``; narrow ``seen`` before passing it in.
    """
    position = [c for c in ("kafka_topic", "kafka_partition", "kafka_offset") if c in batch.columns]
    preferred = [F.desc(F.col("kafka_topic") == MAIN_TOPIC)] if position else []
    order = [*preferred, *position, "created_at"]
    copies = Window.partitionBy("event_id").orderBy(*order)
    unique = batch.withColumn("_copy", F.row_number().over(copies)).filter("_copy = 1").drop("_copy")
    if seen is None:
        return unique
    return unique.join(seen.select("event_id"), "event_id", "left_anti")

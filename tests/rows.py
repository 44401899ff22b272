"""Small hand-made event tables."""

import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import functions as F

from clickfold.schemas import KAFKA_SCHEMA, MAIN_TOPIC, RAW_EVENTS

T0 = dt.datetime(2026, 3, 1, 10, 0, 0)


def event(event_id, event_type="VIEW", at=T0, price="10.00", product="p1", **other):
    row = {
        "event_id": event_id,
        "event_type": event_type,
        "product_id": product,
        "product_name": f"name {product}",
        "product_category": "cat",
        "product_price": None if price is None else Decimal(price),
        "user_id": "u1",
        "location": "Berlin, DE",
        "session_id": "s1",
        "created_at": at,
        "kafka_offset": 0,
        "kafka_partition": 0,
        "kafka_topic": MAIN_TOPIC,
    }
    row.update(other)
    return row


def events_df(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in RAW_EVENTS.names) for r in rows], RAW_EVENTS)


def many(prefix, event_type, n, **kw):
    return [event(f"{prefix}{i}", event_type, **kw) for i in range(n)]


def wire(event_id, event_type="VIEW", timestamp="2026-03-01T10:00:00.000001Z", **other):
    message = {
        "event_id": event_id,
        "event_type": event_type,
        "product_id": "p1",
        "product_name": "name p1",
        "product_category": "cat",
        "product_price": 10.0,
        "user_id": "u1",
        "location": "Berlin, DE",
        "session_id": "s1",
        "timestamp": timestamp,
    }
    message.update(other)
    return json.dumps(message)


def messages_df(spark, values, topic=MAIN_TOPIC, first_offset=0):
    rows = [("p1", v, topic, 0, first_offset + i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, KAFKA_SCHEMA)


def repeat(df, times):
    return df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_i")

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clickfold.functions.clock import parse_instant
from clickfold.operators import quality, retention, routing
from clickfold.operators.ingest import dedup, parse_events, split_valid
from clickfold.schemas import (
    CLICK_TOPIC,
    MAIN_TOPIC,
    PURCHASE_TOPIC,
    RAW_EVENTS,
    TEXT_LIMITS,
)
from clickfold.sources.star_events import log_position
from tests.rows import T0, event, events_df, messages_df, repeat, wire


def split(spark, *values):
    good, bad = split_valid(parse_events(messages_df(spark, values)))
    assert good.columns == RAW_EVENTS.names
    return good.collect(), {r.raw_value: r.reject_reason for r in bad.collect()}


def test_fields_and_utc_time(spark):
    good, bad = split(spark, wire("a", extra="dropped", timestamp="2026-03-01T12:00:00.5+02:00"))
    assert not bad
    assert good[0].created_at == dt.datetime(2026, 3, 1, 10, 0, 0, 500_000)
    assert good[0].product_price == Decimal("10.00")
    assert (good[0].kafka_topic, good[0].kafka_partition, good[0].kafka_offset) == (MAIN_TOPIC, 0, 0)


def test_time_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        good, _ = split(spark, wire("a", timestamp="2026-03-08T02:30:00Z"))
        assert good[0].created_at == dt.datetime(2026, 3, 8, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rejects_keep_text_and_reason(spark):
    junk, no_id, no_time = "not json", wire(None), wire("b", timestamp="2026-13-01T00:00:00Z")
    no_type = wire("c", event_type=None)
    good, bad = split(spark, wire("a"), junk, no_id, no_time, no_type)
    assert [r.event_id for r in good] == ["a"]
    assert bad[junk] == "event_id missing; event_type missing; created_at missing"
    assert bad[no_id] == "event_id missing"
    assert bad[no_time] == "created_at missing"
    assert bad[no_type] == "event_type missing"


def test_null_value_is_rejected(spark):
    good, bad = split(spark, None, "", "[]", "null", "42")
    assert not good and set(bad) == {None, "", "[]", "null", "42"}


def test_wrong_typed_fields_are_null(spark):
    good, bad = split(spark, wire("a", product_price="12.50"))
    assert not bad and good[0].product_price is None


def test_widths_and_price_range(spark):
    long_name = wire("a", product_name="x" * 201)
    at_limit = wire("i" * 36, product_name="x" * 200)
    too_dear = wire("c", product_price=1e8)
    dear = wire("d", product_price=99999999.99)
    good, bad = split(spark, long_name, at_limit, too_dear, dear)
    assert {r.event_id for r in good} == {"i" * 36, "d"}
    assert bad == {
        long_name: "product_name longer than 200",
        too_dear: "product_price out of range",
    }


def test_price_is_rounded_to_cents(spark):
    good, _ = split(spark, wire("a", product_price=0.285), wire("b", product_price=2.675))
    assert [r.product_price for r in good] == [Decimal("0.29"), Decimal("2.68")]


def test_dedup_keeps_the_main_topic_copy(spark):
    rows = [
        event("a", "CLICK", kafka_topic=CLICK_TOPIC, kafka_offset=1),
        event("a", "CLICK", kafka_topic=MAIN_TOPIC, kafka_offset=9),
        event("b", kafka_offset=5),
        event("b", kafka_offset=4),
    ]
    kept = {r.event_id: r for r in dedup(events_df(spark, rows)).collect()}
    assert kept["a"].kafka_topic == MAIN_TOPIC
    assert kept["b"].kafka_offset == 4
    assert len(kept) == 2


def test_dedup_against_seen(spark):
    batch = events_df(spark, [event("a"), event("b"), event("b")])
    seen = events_df(spark, [event("a", at=T0 - dt.timedelta(days=40))])
    assert [r.event_id for r in dedup(batch, seen).collect()] == ["b"]


def test_dedup_of_one_hot_id(spark):
    df = repeat(events_df(spark, [event("hot")]), 20_000)
    assert dedup(df.repartition(8)).count() == 1


def test_fan_out_then_dedup_is_the_original(spark):
    rows = [event(str(i), t) for i, t in enumerate(["VIEW", "CLICK", "PURCHASE", "OTHER"])]
    df = events_df(spark, rows).withColumn("product_id", F.col("event_id"))
    routed = routing.route_to_topics(df, "event_id")
    topics = sorted((r.topic, r.event_id) for r in routed.collect())
    assert topics == [
        (CLICK_TOPIC, "1"),
        (MAIN_TOPIC, "0"),
        (MAIN_TOPIC, "1"),
        (MAIN_TOPIC, "2"),
        (MAIN_TOPIC, "3"),
        (PURCHASE_TOPIC, "2"),
    ]
    good, bad = split_valid(parse_events(log_position(routed)))
    assert bad.isEmpty()
    unique = dedup(good).drop("kafka_offset", "kafka_partition", "kafka_topic")
    expected = df.select(*unique.columns)
    assert sorted(unique.collect()) == sorted(expected.collect())


def test_null_product_has_null_key(spark):
    routed = routing.route_to_topics(events_df(spark, [event("a", product=None)])).collect()
    assert routed[0].key is None and '"product_id"' not in routed[0].value


def test_topic_stats(spark):
    rows = [
        event("a", kafka_offset=3, kafka_partition=0),
        event("b", kafka_offset=7, kafka_partition=0),
        event("c", kafka_offset=1, kafka_partition=1),
    ]
    row = routing.topic_stats(events_df(spark, rows), T0).collect()[0]
    assert tuple(row) == (MAIN_TOPIC, 3, 7, 6, T0)


def test_unique_and_not_null(spark):
    df = events_df(spark, [event("a"), event("a"), event("b"), event(None), event(None)])
    assert sorted(map(tuple, quality.check_unique(df, ["event_id"]).collect()), key=str) == sorted(
        [("a", 2), (None, 2)], key=str
    )
    nulls = dict(map(tuple, quality.check_not_null(df, ["event_id", "event_type"]).collect()))
    assert nulls == {"event_id": 2, "event_type": 0}


def test_limits(spark):
    df = events_df(spark, [event("a" * 40, location=None), event("b", "X" * 21), event("c")])
    broken = {r.event_id: r.violations for r in quality.check_limits(df, TEXT_LIMITS).collect()}
    assert broken == {
        "a" * 40: ["event_id longer than 36"],
        "b": ["event_type longer than 20"],
    }
    counts = dict(map(tuple, quality.limit_counts(df, TEXT_LIMITS).collect()))
    assert counts["event_id"] == counts["event_type"] == 1 and sum(counts.values()) == 2


def test_retention_boundary(spark):
    cutoff = T0
    rows = [
        event("before", at=T0 - dt.timedelta(microseconds=1)),
        event("at", at=T0),
        event("after", at=T0 + dt.timedelta(days=1)),
        event("timeless", at=None),
    ]
    df = events_df(spark, rows)
    assert {r.event_id for r in retention.retain(df, cutoff).collect()} == {"at", "after", "timeless"}
    assert tuple(retention.retention_counts(df, cutoff).first()) == (1, 3)
    assert retention.default_cutoff(T0) == dt.datetime(2025, 12, 1)


@pytest.mark.parametrize(
    ("text", "at"),
    [
        ("2026-03-01T12:30:00Z", "2026-03-01 12:30:00"),
        ("2026-03-01 12:30:00.25", "2026-03-01 12:30:00.25"),
        ("2026-03-01T12:30:00+02:00", "2026-03-01 10:30:00"),
        ("0001-01-01T00:00:00Z", "0001-01-01 00:00:00"),
        ("9999-12-31T23:59:59.999999Z", "9999-12-31 23:59:59.999999"),
        ("9999-12-31T23:59:59-02:00", None),
        ("0000-01-01T00:00:00Z", None),
        ("+12345-01-01T00:00:00Z", None),
        ("12345-01-01T00:00:00Z", None),
        ("12:30:00", None),
        ("2026", None),
        ("2026-03", None),
        ("2026-03-01", None),
        ("2026-02-30T00:00:00Z", None),
        ("2026-03-01T25:00:00Z", None),
        ("2026-03-01T12:30:00 Europe/Berlin", None),
        ("now", None),
        ("", None),
        (None, None),
    ],
)
def test_only_whole_times_are_times(spark, text, at):
    got = spark.createDataFrame([(text,)], "t string").select(parse_instant(F.col("t")).alias("at"))
    if at is not None:
        assert got.first().at == dt.datetime.fromisoformat(at)
    else:
        assert got.first().at is None

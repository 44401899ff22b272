"""Plan shapes the operators rely on at scale."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clickfold.operators import funnels, products, serving
from clickfold.operators.ingest import dedup, parse_events, split_valid
from clickfold.operators.measures import measure
from clickfold.operators.staging import on_day, stage
from clickfold.plans import catalog
from clickfold.plans.catalog import QUERIES
from clickfold.sources.star_events import bare_events, read, with_products
from tests.conftest import SF_DIR
from tests.rows import event, events_df, messages_df


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_day_filter_and_columns_reach_the_scan(spark):
    day = on_day(bare_events(spark, SF_DIR), dt.date(2024, 1, 5))
    text = plan(products.product_metrics(day))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-05" in text
    assert "LessThan(ts,2024-01-06" in text
    assert "user_id" not in text.split("ReadSchema")[1]


def test_stored_days_prune_partitions(spark, tmp_path):
    day = dt.date(2026, 3, 1)
    path = str(tmp_path / "raw")
    dated = events_df(spark, [event("a")]).withColumn("event_date", F.to_date("created_at"))
    dated.write.partitionBy("event_date").parquet(path)
    raw = spark.read.parquet(path)
    for df in (
        products.product_metrics(on_day(raw, day)),
        funnels.funnel_analysis(stage(raw).filter(F.col("event_date") == F.lit(day))),
    ):
        filters = plan(df).split("PartitionFilters: [")[1].split("]")[0]
        assert "event_date" in filters and "2026-03-01" in filters


def test_time_window_reaches_the_scan(spark):
    as_of = dt.datetime(2024, 1, 30)
    text = plan(serving.events_per_sec(bare_events(spark, SF_DIR), as_of))
    assert "GreaterThanOrEqual(ts,2024-01-29T23:59:50)" in text
    assert "ReadSchema: struct<ts:timestamp_ntz>" in text


def test_funnel_reads_three_columns(spark):
    text = plan(funnels.funnel_analysis(stage(bare_events(spark, SF_DIR))))
    assert "props" not in text.split("ReadSchema")[1]
    assert text.count("Exchange") == 1


def test_measures_are_hash_aggregated_before_the_shuffle(spark):
    text = plan(measure(bare_events(spark, SF_DIR), "product_id"))
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2
    assert text.index("Exchange") < text.rindex("HashAggregate")


def test_metrics_sort_only_aggregated_rows(spark):
    text = plan(products.product_metrics(bare_events(spark, SF_DIR)))
    scan_side = text[text.rindex("Exchange") :]
    assert "HashAggregate" in scan_side and "Sort" not in scan_side


def test_topk_does_not_sort_everything(spark):
    events = bare_events(spark, SF_DIR)
    for df in (serving.latest_events(events), serving.top_products(events)):
        assert "TakeOrderedAndProject" in plan(df)


def test_dedup_limits_copies_before_the_shuffle(spark):
    text = plan(dedup(events_df(spark, [])))
    partial = text[text.index("Exchange") :]
    assert "WindowGroupLimit" in partial and "Partial" in partial
    seen = read(spark, SF_DIR, "events").selectExpr("cast(event_id as string) as event_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # The batch side of the anti-join is not shuffled a second time.
        assert plan(dedup(events_df(spark, []), seen)).count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_messages_are_decoded_once(spark):
    good, bad = split_valid(parse_events(messages_df(spark, [])))
    assert plan(good).count("from_json") == 1
    assert plan(bad).count("from_json") == 1


def test_marts_look_names_up_after_aggregating(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog, "with_products", lambda df, *a: seen.append(df) or with_products(df, *a))
    QUERIES["mart_product_metrics_daily"](spark, SF_DIR)
    (aggregated,) = seen
    events = read(spark, SF_DIR, "events").count()
    assert "HashAggregate" in plan(aggregated) and aggregated.count() < events / 2


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_and_no_unkeyed_joins(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text

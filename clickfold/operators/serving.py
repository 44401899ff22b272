"""Queries behind the dashboard: totals, rankings, latest events, rates of arrival.

The totals and rankings accept raw events or any measure table that keeps their keys.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.functions.clock import iso_utc
from clickfold.functions.rates import at_least_one, percent
from clickfold.operators.measures import measures_of
from clickfold.operators.staging import of_type, on_day, within
from clickfold.schemas import CLICK, PURCHASE, VIEW

WINDOW_MEASURES = ("total_events", "views", "clicks", "purchases")


def _money(column: Column | str) -> Column:
    return F.coalesce(column, F.lit(0).cast("decimal(20,2)"))


def kpi_totals(df: DataFrame) -> DataFrame:
    """All-time counters and revenue; zeros on an empty table."""
    return measures_of(df).select(
        "total_events",
        "total_views",
        "total_clicks",
        "total_purchases",
        _money("total_revenue").alias("total_revenue"),
    )


def events_per_sec(raw: DataFrame, as_of: dt.datetime | Column, seconds: int = 10) -> DataFrame:
    """Whole events per second over the last ``seconds`` before ``as_of``."""
    recent = within(raw, as_of, seconds).agg(F.count(F.lit(1)).alias("n"))
    return recent.select(
        F.call_function("div", F.col("n"), F.lit(int(seconds)).cast("long")).alias("events_per_sec")
    )


def top_products(df: DataFrame, k: int = 8) -> DataFrame:
    """Best sellers by name and category; a missing revenue ranks first, as 0."""
    ranked = (
        measures_of(df, "product_name", "product_category")
        .orderBy(F.desc_nulls_first("total_revenue"), "product_name", "product_category")
        .limit(k)
    )
    return ranked.select(
        F.col("product_name").alias("name"),
        F.col("product_category").alias("category"),
        F.col("total_events").alias("events"),
        _money("total_revenue").alias("revenue"),
        F.col("total_clicks").alias("clicks"),
        F.col("total_purchases").alias("purchases"),
        percent("total_clicks", at_least_one("total_views")).alias("ctr"),
    )


def top_products_revenue(df: DataFrame, k: int = 8) -> DataFrame:
    """Revenue of the ``k`` best sellers together, over all time."""
    return top_products(df, k).agg(
        _money(F.sum("revenue").cast("decimal(20,2)")).alias("top_products_revenue")
    )


def revenue_on(raw: DataFrame, day: dt.date) -> DataFrame:
    """Revenue of one calendar day."""
    return measures_of(on_day(raw, day)).select(
        F.lit(day).alias("event_date"), _money("total_revenue").alias("revenue")
    )


def category_breakdown(df: DataFrame) -> DataFrame:
    return measures_of(df, "product_category").select(
        F.col("product_category").alias("category"),
        F.col("total_views").alias("views"),
        F.col("total_purchases").alias("purchases"),
    )


def latest_events(raw: DataFrame, limit: int = 50, event_type: str = "ALL") -> DataFrame:
    """Newest events by event time, then id; each task keeps only ``limit`` rows."""
    newest = (
        of_type(raw, event_type)
        .orderBy(F.desc_nulls_last("created_at"), F.desc("event_id"))
        .limit(limit)
    )
    return newest.select(
        "event_id",
        "event_type",
        "product_id",
        "product_name",
        "product_category",
        F.coalesce("product_price", F.lit(0).cast("decimal(10,2)")).alias("product_price"),
        "user_id",
        "location",
        "session_id",
        iso_utc(F.col("created_at")).alias("timestamp"),
    )


def window_counts(events: DataFrame, seconds: int = 10, time: str = "created_at") -> DataFrame:
    """Arrivals per tumbling window and type, as counts that add up. Works on a batch or a
    watermarked stream."""

    def count(event_type: str) -> Column:
        return F.count_if(F.col("event_type") == event_type)

    windows = events.groupBy(F.window(time, f"{int(seconds)} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("total_events"),
        count(VIEW).alias("views"),
        count(CLICK).alias("clicks"),
        count(PURCHASE).alias("purchases"),
    )
    return windows.select(
        F.lit(int(seconds)).alias("seconds"),
        F.col("w.start").alias("window_start"),
        *WINDOW_MEASURES,
    )


def merge_windows(parts: DataFrame) -> DataFrame:
    """Counts of the same window from several batches, added up."""
    sums = [F.sum(c).alias(c) for c in WINDOW_MEASURES]
    return parts.groupBy("seconds", "window_start").agg(*sums)


def window_rates(counts: DataFrame) -> DataFrame:
    """Window counts with the end of the window and the rate of arrival."""
    return counts.select(
        "window_start",
        (F.col("window_start") + F.make_dt_interval(secs=F.col("seconds"))).alias("window_end"),
        *WINDOW_MEASURES,
        (F.col("total_events") / F.col("seconds")).alias("events_per_sec"),
    )


def throughput(events: DataFrame, seconds: int = 10, time: str = "created_at") -> DataFrame:
    """Arrivals per tumbling window and type. Works on a batch or a watermarked stream."""
    return window_rates(window_counts(events, seconds, time))

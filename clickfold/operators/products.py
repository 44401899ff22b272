"""Per-product metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.functions.clock import ntz
from clickfold.functions.rates import fraction, percent
from clickfold.operators.measures import measure, measures_of, rollup
from clickfold.operators.staging import event_day
from clickfold.schemas import COUNTERS, METRIC_KEYS, PRODUCT_METRICS


def with_rates(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns(
        {
            "click_through_rate": fraction("total_clicks", "total_views"),
            "conversion_rate": fraction("total_purchases", "total_views"),
        }
    )


def latest_names(parts: DataFrame, keys: tuple[str, ...], seen: str) -> DataFrame:
    """Collapse measure rows to ``keys``, naming each product as last seen.

    A product renamed within the group takes the name with the newest ``seen`` time,
    the greatest name on a tie. ``parts`` is first hash-aggregated with the names in
    the key: taking the newest name straight from its rows would sort all of them.
    """
    fine = rollup(parts, *keys, "product_name", "category", extra=(F.max(seen).alias(seen),))
    return _pick_name(fine, keys, seen)


def _pick_name(fine: DataFrame, keys: tuple[str, ...], seen: str) -> DataFrame:
    newest = F.max(F.struct(seen, "product_name", "category")).alias("newest")
    return rollup(fine, *keys, extra=(newest,)).select(
        *keys,
        F.col("newest.product_name").alias("product_name"),
        F.col("newest.category").alias("category"),
        *COUNTERS,
        "total_revenue",
        F.col(f"newest.{seen}").alias(seen),
    )


def product_metrics(
    raw: DataFrame, by_date: bool = True, updated_at: dt.datetime | Column | None = None
) -> DataFrame:
    """One row per (date, product), or per product over all given rows."""
    keys = METRIC_KEYS if by_date else METRIC_KEYS[1:]
    dated = [event_day(raw).alias("metric_date")] if by_date else []
    fine = measure(
        raw,
        *dated,
        "product_id",
        "product_name",
        F.col("product_category").alias("category"),
        extra=(F.max("created_at").alias("last_seen"),),
    )
    stamp = F.col("last_seen") if updated_at is None else ntz(updated_at)
    metrics = with_rates(_pick_name(fine, keys, "last_seen"))
    columns = [f.name for f in PRODUCT_METRICS if by_date or f.name != "metric_date"]
    return metrics.withColumn("updated_at", stamp).select(*columns)


DAILY_KEYS = ("event_date", "product_id", "product_name", "product_category")


def product_metrics_daily(staged: DataFrame) -> DataFrame:
    """The daily product mart, keyed by date, product, name and category."""
    return as_daily_mart(measures_of(staged, *DAILY_KEYS))


def as_daily_mart(measured: DataFrame) -> DataFrame:
    """The mart's columns from measures at its keys."""
    return with_rates(measured).select(
        "event_date",
        "product_id",
        "product_name",
        F.col("product_category").alias("category"),
        *COUNTERS[1:],
        "total_revenue",
        "click_through_rate",
        "conversion_rate",
    )


def daily_report_order(mart: DataFrame) -> DataFrame:
    """Newest day first, best sellers first. For reading; never sort before a write."""
    return mart.orderBy(
        F.desc("event_date"),
        F.desc_nulls_first("total_revenue"),
        "product_id",
        "product_name",
        "category",
    )


def batch_summary(metrics: DataFrame) -> DataFrame:
    """Totals over a day's product metrics, for the run log."""
    totals = rollup(metrics)
    return totals.select(
        F.col("total_events").alias("records_processed"),
        "total_views",
        "total_purchases",
        F.coalesce("total_revenue", F.lit(0).cast("decimal(20,2)")).alias("total_revenue"),
        percent("total_purchases", "total_views").alias("conversion_pct"),
    )


def batch_top(metrics: DataFrame, k: int = 5) -> DataFrame:
    """The day's best sellers; products without revenue rank last."""
    return (
        metrics.orderBy(F.desc_nulls_last("total_revenue"), F.asc_nulls_last("product_id"))
        .limit(k)
        .select("product_id", "product_name", "category", "total_revenue")
    )

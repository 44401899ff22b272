"""View, click, purchase funnels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.functions.clock import ntz
from clickfold.functions.rates import at_least_one, percent
from clickfold.operators.measures import measures_of
from clickfold.operators.staging import on_day
from clickfold.schemas import FUNNEL_METRICS


def funnel_analysis(staged: DataFrame) -> DataFrame:
    """The daily funnel mart; a day without events has no row."""
    return measures_of(staged, "event_date").withColumns(
        {
            "view_to_click_rate": percent("total_clicks", "total_views"),
            "click_to_purchase_rate": percent("total_purchases", "total_clicks"),
            "overall_conversion_rate": percent("total_purchases", "total_views"),
        }
    )


def funnel_report_order(mart: DataFrame) -> DataFrame:
    """Newest day first. For reading; never sort before a write."""
    return mart.orderBy(F.desc("event_date"))


def funnel_day(
    raw: DataFrame, day: dt.date, updated_at: dt.datetime | Column | None = None
) -> DataFrame:
    """One funnel row for a day, all zeros when the day has no events."""
    stamp = F.lit(None).cast("timestamp_ntz") if updated_at is None else ntz(updated_at)
    return (
        measures_of(on_day(raw, day))
        .withColumns(
            {
                "metric_date": F.lit(day),
                "view_to_click_pct": percent("total_clicks", "total_views"),
                "click_to_purchase_pct": percent("total_purchases", "total_clicks"),
                "overall_conversion_pct": percent("total_purchases", "total_views"),
                "updated_at": stamp,
            }
        )
        .select(*FUNNEL_METRICS.names)
    )


def funnel_overall(df: DataFrame) -> DataFrame:
    """The all-time funnel as served: no views are shown as 1 view."""
    return measures_of(df).select(
        at_least_one("total_views").alias("views"),
        F.col("total_clicks").alias("clicks"),
        F.col("total_purchases").alias("purchases"),
        percent("total_clicks", at_least_one("total_views")).alias("view_to_click_rate"),
        percent("total_purchases", at_least_one("total_clicks")).alias("click_to_purchase_rate"),
    )

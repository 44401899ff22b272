"""Row-level projections and filters over raw events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.functions.clock import ntz
from clickfold.schemas import CLICK, PURCHASE, VIEW

STAGED_COLUMNS = (
    "event_id",
    "event_type",
    "product_id",
    "product_name",
    "product_category",
    "product_price",
    "user_id",
    "location",
    "session_id",
)


def _flag(event_type: str) -> Column:
    return F.when(F.col("event_type") == event_type, 1).otherwise(0)


def event_day(df: DataFrame) -> Column:
    """The event's date: the stored partition column where there is one, so that filters
    on it prune partitions."""
    return F.col("event_date") if "event_date" in df.columns else F.to_date("created_at")


def stage(raw: DataFrame) -> DataFrame:
    """Identified events with calendar columns and 0/1 type flags."""
    return raw.filter(F.col("event_id").isNotNull()).select(
        *STAGED_COLUMNS,
        F.col("created_at").alias("event_timestamp"),
        event_day(raw).alias("event_date"),
        F.hour("created_at").alias("event_hour"),
        _flag(VIEW).alias("is_view"),
        _flag(CLICK).alias("is_click"),
        _flag(PURCHASE).alias("is_purchase"),
    )


def on_days(df: DataFrame, days: Sequence[dt.date]) -> DataFrame:
    """Some calendar days. A stored table is pruned to their partitions; on plain files
    the span of the days reaches the Parquet scan."""
    if "event_date" in df.columns:
        return df.filter(F.col("event_date").isin(*days))
    start = dt.datetime.combine(min(days), dt.time())
    end = dt.datetime.combine(max(days), dt.time()) + dt.timedelta(days=1)
    at = F.col("created_at")
    spanned = df.filter((at >= ntz(start)) & (at < ntz(end)))
    return spanned if len(set(days)) == 1 else spanned.filter(F.to_date(at).isin(*days))


def on_day(df: DataFrame, day: dt.date) -> DataFrame:
    return on_days(df, [day])


def of_type(df: DataFrame, event_type: str = "ALL") -> DataFrame:
    return df if event_type == "ALL" else df.filter(F.col("event_type") == event_type)


def within(df: DataFrame, as_of: dt.datetime | Column, seconds: int) -> DataFrame:
    """Events from ``seconds`` before ``as_of`` on; later ones are not cut off."""
    return df.filter(F.col("created_at") >= ntz(as_of) - F.expr(f"INTERVAL {int(seconds)} SECONDS"))

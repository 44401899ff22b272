"""The five additive measures, from raw events or from a finer measure table.

Every report is a roll-up of these, so a report accepts either events or a table
that was measured before at a finer grain. At scale the events are scanned once and
the serving queries read the small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.schemas import CLICK, COUNTERS, PURCHASE, REVENUE, VIEW


def _count(event_type: str) -> Column:
    return F.count_if(F.col("event_type") == event_type)


def _from_cents(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") * F.lit(0.01).cast("decimal(3,2)")).cast(REVENUE)


def _revenue() -> Column:
    # Summed as long cents: a decimal(20,2) buffer would leave the primitive
    # aggregation path. Exact up to 9e16 units of money; ANSI mode raises beyond.
    # A purchase without a price is skipped; a group of nothing else sums to null.
    cents = (F.col("product_price").cast("decimal(10,2)") * 100).cast("long")
    paid = F.when(F.col("event_type") == PURCHASE, cents).otherwise(F.lit(0))
    return _from_cents(F.sum(paid))


def measure(events: DataFrame, *keys: Column | str, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Aggregate events to ``keys``; buffers are primitive, so partial hash aggregation
    collapses a hot key before the shuffle."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_events"),
        _count(VIEW).alias("total_views"),
        _count(CLICK).alias("total_clicks"),
        _count(PURCHASE).alias("total_purchases"),
        _revenue().alias("total_revenue"),
        *extra,
    )


def rollup(measures: DataFrame, *keys: Column | str, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Aggregate a measure table to coarser ``keys``."""
    counters = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS]
    revenue = F.sum("total_revenue").cast(REVENUE).alias("total_revenue")
    return measures.groupBy(*keys).agg(*counters, revenue, *extra)


def is_measured(df: DataFrame) -> bool:
    return "total_events" in df.columns


def measures_of(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Measures at ``keys`` from events or from a finer measure table."""
    return rollup(df, *keys) if is_measured(df) else measure(df, *keys)

"""The staging view and the two marts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from clickfold.operators.funnels import funnel_analysis
from clickfold.operators.measures import measure
from clickfold.operators.products import DAILY_KEYS, as_daily_mart
from clickfold.operators.staging import on_days, stage
from clickfold.sources.tables import drop_partitions, write_partitions

STAGING_VIEW = "stg_events"
PRODUCT_MART = "product_metrics_daily"
FUNNEL_MART = "funnel_analysis"


def build_marts(
    spark: SparkSession,
    raw: DataFrame,
    out: str,
    days: list[dt.date] | None = None,
    name: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, str]:
    """Register the staging view and write both marts, from one scan of the events.

    All days are rebuilt, or only the given ones: the others' partitions stay. A day's
    partition is replaced when its new rows are written, and days that are gone are dropped
    last, so that an interrupted rebuild leaves old days rather than none. ``name`` looks
    product names up for events that carry ids only; it runs on aggregated rows. Returns the
    mart paths.
    """
    staged = stage(raw)
    staged.createOrReplaceTempView(STAGING_VIEW)
    wanted = staged if days is None else stage(on_days(raw, days))
    daily = measure(wanted, *DAILY_KEYS)
    daily = (daily if name is None else name(daily)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        marts = {PRODUCT_MART: as_daily_mart(daily), FUNNEL_MART: funnel_analysis(daily)}
        paths = {name: f"{out.rstrip('/')}/{name}" for name in marts}
        for mart_name, mart in marts.items():
            write_partitions(mart, paths[mart_name], "event_date", rebalance=True)
        if days is None:
            # One row per calendar day.
            present = {str(r[0]) for r in daily.select("event_date").distinct().collect()}
            for path in paths.values():
                drop_partitions(
                    spark, path, lambda day: day not in present and not day.startswith("__")
                )
    finally:
        daily.unpersist()
    return paths


def read_mart(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out.rstrip('/')}/{name}")

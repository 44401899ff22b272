"""Keyed upserts as pure functions of the current table and a delta."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.operators.products import latest_names, with_rates
from clickfold.schemas import METRIC_KEYS, PRODUCT_METRICS


def fold_metrics(parts: DataFrame) -> DataFrame:
    """Sum metric rows to one row per (date, product) and derive the rates again.

    ``groupBy`` treats null product ids as one key. The names follow the row that was
    updated last.
    """
    folded = latest_names(parts, METRIC_KEYS, "updated_at")
    return with_rates(folded).select(*PRODUCT_METRICS.names)


def merge_add(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Additive upsert: counters and revenue add up, rates follow from the sums."""
    return fold_metrics(current.unionByName(delta, allowMissingColumns=True))


def merge_replace(
    current: DataFrame, delta: DataFrame, keys: Sequence[str] = METRIC_KEYS
) -> DataFrame:
    """Replacing upsert: the delta's rows win, keys it does not mention stay."""
    same_key = reduce(
        lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    )
    kept = current.alias("c").join(delta.select(*keys).alias("d"), same_key, "left_anti")
    return kept.unionByName(delta)


def upsert_funnel(current: DataFrame, day_row: DataFrame) -> DataFrame:
    """Replace one day's funnel row."""
    return merge_replace(current, day_row, ["metric_date"])

"""Retention cut on event time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.functions.clock import ntz

RETENTION_DAYS = 90


def default_cutoff(as_of: dt.datetime, days: int = RETENTION_DAYS) -> dt.datetime:
    """Start of the oldest day kept, so no day is kept in part."""
    return dt.datetime.combine(as_of.date() - dt.timedelta(days=days), dt.time())


def _expired(cutoff: dt.datetime | Column) -> Column:
    return F.coalesce(F.col("created_at") < ntz(cutoff), F.lit(False))


def retain(raw: DataFrame, cutoff: dt.datetime | Column) -> DataFrame:
    """Events at or after the cutoff; an event without a time is kept."""
    at = F.col("created_at")
    return raw.filter((at >= ntz(cutoff)) | at.isNull())


def retention_counts(raw: DataFrame, cutoff: dt.datetime | Column) -> DataFrame:
    """How many rows a prune drops and keeps, from one scan of the time column."""
    return raw.agg(
        F.count_if(_expired(cutoff)).alias("pruned"),
        F.count_if(~_expired(cutoff)).alias("kept"),
    )

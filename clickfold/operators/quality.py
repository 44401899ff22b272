"""Data checks: each returns the failing rows or counts them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once. Copies are counted before the shuffle."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return counts.filter(F.col("copies") > 1)


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count per column, from one scan."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "null_rows")


def over_limits(limits: Mapping[str, int | T.DecimalType]) -> list[tuple[Column, str]]:
    """A condition and its message per limit.

    An int is the longest text allowed; a decimal type is the range allowed.
    """
    checks = []
    for name, limit in limits.items():
        if isinstance(limit, T.DecimalType):
            outside = F.col(name).isNotNull() & F.col(name).try_cast(limit).isNull()
            checks.append((outside, f"{name} out of range"))
        else:
            checks.append((F.length(name) > limit, f"{name} longer than {limit}"))
    return checks


def violations(checks: Sequence[tuple[Column, str]]) -> list[Column]:
    """For each check its message where it fails, else null."""
    return [F.when(condition, F.lit(message)) for condition, message in checks]


def any_of(checks: Sequence[tuple[Column, str]]) -> Column:
    failing = reduce(lambda a, b: a | b, [condition for condition, _ in checks])
    return F.coalesce(failing, F.lit(False))


def check_limits(df: DataFrame, limits: Mapping[str, int | T.DecimalType]) -> DataFrame:
    """Rows over a limit, with the list of limits they break."""
    checks = over_limits(limits)
    broken = F.array_compact(F.array(*violations(checks)))
    return df.filter(any_of(checks)).withColumn("violations", broken)


def limit_counts(df: DataFrame, limits: Mapping[str, int | T.DecimalType]) -> DataFrame:
    """Number of rows over each limit, from one scan."""
    counts = df.agg(
        *[
            F.count_if(condition).alias(name)
            for name, (condition, _) in zip(limits, over_limits(limits), strict=True)
        ]
    )
    return counts.unpivot([], list(limits), "column_name", "failing_rows")

"""Guarded ratios, exact to the last digit.

The quotient is rounded half-up in integer arithmetic, so ties do not depend on
binary floating point and the expression stays on primitive longs in codegen.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(num: Column | str, den: Column | str, scale: int, percent: bool = False) -> Column:
    """``num / den`` (times 100 for a percentage), 0 where ``den`` is 0 or null."""
    num, den = _column(num).cast("long"), _column(den).cast("long")
    steps = 10**scale * (100 if percent else 1)
    half_up = F.call_function("div", num * F.lit(2 * steps) + den, den * F.lit(2))
    units = F.when(den > 0, half_up).otherwise(F.lit(0))
    step = F.lit(Decimal(1).scaleb(-scale))
    return (units.cast("decimal(20,0)") * step).cast(f"decimal(18,{scale})")


def fraction(num: Column | str, den: Column | str) -> Column:
    """Four-digit share, as in click-through and conversion rates."""
    return ratio(num, den, 4)


def percent(num: Column | str, den: Column | str) -> Column:
    """Two-digit percentage, as in the funnel steps."""
    return ratio(num, den, 2, percent=True)


def at_least_one(count: Column | str) -> Column:
    """The serving views report an empty denominator as 1."""
    return F.greatest(F.coalesce(_column(count), F.lit(0)), F.lit(1)).cast("long")

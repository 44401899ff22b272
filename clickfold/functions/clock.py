"""Time helpers. Event times are TIMESTAMP_NTZ columns holding UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def utc_wall_clock(instant: Column) -> Column:
    """TIMESTAMP to TIMESTAMP_NTZ in UTC, whatever the session time zone is."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


#: A date of years 0001 to 9999, then a time, then an offset or none (UTC).
ISO_TIME = (
    r"^(?!0000)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
    r"(Z|[+-]\d{2}(:?\d{2})?)?$"
)


def parse_instant(text: Column) -> Column:
    """ISO-8601 text to UTC wall-clock time; null when it is not a whole time.

    A cast alone would complete a time of day with today's date and a year with 1 January,
    and take years of five digits. An offset may move the time out of the years; such a
    time is null as well.
    """
    at = utc_wall_clock(F.when(text.rlike(ISO_TIME), text.try_cast("timestamp")))
    return F.when(F.year(at).between(1, 9999), at)


def iso_utc(time: Column) -> Column:
    return F.date_format(time, ISO_UTC)


def ntz(value: dt.datetime | Column) -> Column:
    if isinstance(value, Column):
        return value
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def utc_now() -> dt.datetime:
    """For job entry points only; operators take their times as arguments."""
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def parse_day(text: str | None, now: dt.datetime | None = None) -> dt.date:
    """A ``YYYY-MM-DD`` argument; yesterday (UTC) when absent."""
    if text is None:
        return (now or utc_now()).date() - dt.timedelta(days=1)
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError as error:
        raise ValueError(f"not a YYYY-MM-DD date: {text!r}") from error

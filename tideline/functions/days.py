"""Calendar days in a business time zone, cutoffs and growth windows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_date_type(data_type: T.DataType) -> bool:
    """Only typed date columns can define a day; text dates cannot."""
    return isinstance(data_type, TEMPORAL_TYPES)


def as_day(day: str | date | Column) -> Column:
    return day if isinstance(day, Column) else F.lit(str(day)).cast("date")


def local_day(column: Column, data_type: T.DataType, time_zone: str, ntz_is_utc: bool = False) -> Column:
    """Local calendar day of a date, zone-less timestamp or instant.

    A zone-less timestamp already is local time unless ``ntz_is_utc`` says the file stored instants
    without their zone.
    """
    if isinstance(data_type, T.DateType):
        return column
    if isinstance(data_type, T.TimestampNTZType):
        if not ntz_is_utc:
            return column.cast("date")
        return F.convert_timezone(F.lit("UTC"), F.lit(time_zone), column).cast("date")
    if isinstance(data_type, T.TimestampType):
        return F.convert_timezone(None, F.lit(time_zone), column).cast("date")
    raise TypeError(f"not a date or timestamp column: {data_type.simpleString()}")


def day_start(
    day: str | date | Column, data_type: T.DataType, time_zone: str, ntz_is_utc: bool = False
) -> Column:
    """First moment of a local day, in the type of the column it will be compared with.

    For a literal day the result folds to a constant, so a comparison with the raw column reaches the
    Parquet scan.
    """
    day = as_day(day)
    if isinstance(data_type, T.DateType):
        return day
    midnight = day.cast("timestamp_ntz")
    if isinstance(data_type, T.TimestampNTZType):
        return F.convert_timezone(F.lit(time_zone), F.lit("UTC"), midnight) if ntz_is_utc else midnight
    if isinstance(data_type, T.TimestampType):
        return F.convert_timezone(F.lit(time_zone), F.current_timezone(), midnight).cast("timestamp")
    raise TypeError(f"not a date or timestamp column: {data_type.simpleString()}")


def before_day(
    column: Column, data_type: T.DataType, end_day: str | date | Column, time_zone: str, ntz_is_utc: bool = False
) -> Column:
    """Rows whose local day is earlier than ``end_day``, tested on the raw column. NULL never matches."""
    return column.isNotNull() & (column < day_start(end_day, data_type, time_zone, ntz_is_utc))


def months_back(day: Column, months: int | Column) -> Column:
    """The same day of the month, ``months`` earlier; a day that month lacks runs over into the next one."""
    months = F.lit(months) if isinstance(months, int) else months
    first = F.add_months(F.trunc(day, "MM"), -months)
    return F.date_add(first, F.day(day) - 1)


def eligibility_cutoff(today: str | date | Column, protected_months: int | Column, grace_days: int | Column) -> Column:
    """First protected day: today minus the protected months minus the grace days."""
    grace_days = F.lit(grace_days) if isinstance(grace_days, int) else grace_days
    return F.date_sub(months_back(as_day(today), protected_months), grace_days)


def local_today(time_zone: str, now: Column | None = None) -> Column:
    """Today in a zone; ``now`` is an instant and defaults to the query's start."""
    now = F.current_timestamp() if now is None else now
    return F.convert_timezone(None, F.lit(time_zone), now).cast("date")


def growth_window(today: str | date | Column, months: int = 6) -> tuple[Column, Column]:
    """The last complete local months before ``today``: first day, and the day after the last."""
    month_start = F.trunc(as_day(today), "MM")
    return F.add_months(month_start, -months).cast("date"), month_start.cast("date")


def within_window(instant: Column, start: Column, end: Column, time_zone: Column) -> Column:
    """Is the local wall clock inside ``start`` to ``end`` ('HH:mm')? A window may wrap past midnight."""
    clock = F.date_format(F.convert_timezone(None, time_zone, instant), "HH:mm")
    start, end = F.substring(start, 1, 5), F.substring(end, 1, 5)
    return F.when(start <= end, (clock >= start) & (clock < end)).otherwise((clock >= start) | (clock < end))

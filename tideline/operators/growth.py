"""Growth over the last complete months, spikes, and net growth from snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions.days import column_type, day_start, growth_window, local_day
from tideline.functions.severity import round_half_up

SPIKE_FACTOR = 5
SPIKE_MIN_DAYS = 7


def growth_daily(
    df: DataFrame, column: str, time_zone: str, today: str | date, by: Sequence[str] = (), ntz_is_utc: bool = False,
    months: int = 6,
) -> DataFrame:
    """``(by, day, n)``: rows inserted per local day inside the window; the bounds reach the scan."""
    start, end = growth_window(today, months)
    kind, value = column_type(df, column), F.col(column)
    inside = (value >= day_start(start, kind, time_zone, ntz_is_utc)) & (
        value < day_start(end, kind, time_zone, ntz_is_utc)
    )
    day = local_day(value, kind, time_zone, ntz_is_utc).alias("day")
    return df.where(inside).groupBy(*by, day).agg(F.count(F.lit(1)).alias("n"))


def month_spine(subjects: DataFrame, today: str | date, months: int = 6) -> DataFrame:
    """One row per subject and month of the window, so months without rows appear as zero."""
    start, end = growth_window(today, months)
    last = F.add_months(end, -1)
    return subjects.select(
        "*", F.explode(F.sequence(start, last.cast("date"), F.expr("interval 1 month"))).alias("month")
    )


def growth_monthly(
    daily: DataFrame, subjects: DataFrame, today: str | date, by: Sequence[str] = (), months: int = 6
) -> DataFrame:
    """Rows per month, days in the month and rows per day rounded."""
    monthly = daily.groupBy(*by, F.trunc("day", "MM").cast("date").alias("month")).agg(F.sum("n").alias("n"))
    spine = month_spine(subjects, today, months)
    return spine.join(monthly, [*by, "month"], "left").select(
        *by, "month",
        F.coalesce("n", F.lit(0)).alias("records_added"),
        F.day(F.last_day("month")).alias("days_in_month"),
        round_half_up(F.coalesce("n", F.lit(0)) / F.day(F.last_day("month"))).alias("per_day"),
    )


def mark_spikes(daily: DataFrame, by: Sequence[str] = (), factor: int = SPIKE_FACTOR) -> DataFrame:
    """Add the upper median of the days that have rows, and whether a day exceeds ``factor`` times it.

    Fewer than seven days never make a spike. All windows share one partitioning, and a subject has at most
    one row per calendar day of the window.
    """
    subject = Window.partitionBy(*(by or [F.lit(0)]))
    middle = F.floor(F.col("_days") / 2) + 1
    return (
        daily.withColumn("_rank", F.row_number().over(subject.orderBy("n")))
        .withColumn("_days", F.count(F.lit(1)).over(subject))
        .withColumn("median", F.max(F.when(F.col("_rank") == middle, F.col("n"))).over(subject))
        .withColumn("spike", (F.col("_days") >= SPIKE_MIN_DAYS) & (F.col("n") > factor * F.col("median")))
        .drop("_rank", "_days")
    )


def spike_days(daily: DataFrame, by: Sequence[str] = (), factor: int = SPIKE_FACTOR) -> DataFrame:
    return mark_spikes(daily, by, factor).where("spike").select(*by, "day", "n", "median")


def growth_status(
    df: DataFrame, column: str | None, time_zone: str, today: str | date, by: Sequence[str] = (),
    ntz_is_utc: bool = False, months: int = 6,
) -> DataFrame:
    """measured only when the oldest row proves the table recorded the whole window.

    A table without an insertion column cannot be measured; its row count alone says nothing about growth.
    """
    if column is None:
        return df.groupBy(*by).agg(F.lit(None).cast("timestamp").alias("oldest")).select(
            *by, "oldest", F.lit("insufficient_history").alias("status"), F.lit("no insertion column").alias("reason")
        )
    start, _ = growth_window(today, months)
    first_needed = day_start(start, column_type(df, column), time_zone, ntz_is_utc)
    oldest = df.groupBy(*by).agg(F.min(column).alias("oldest"))
    return oldest.select(
        *by, "oldest",
        F.when(F.col("oldest") <= first_needed, "measured").otherwise("insufficient_history").alias("status"),
        F.when(F.col("oldest").isNull(), "table is empty")
        .when(F.col("oldest") > first_needed, "oldest row is newer than the window start")
        .alias("reason"),
    )


def growth_average(
    daily: DataFrame, subjects: DataFrame, today: str | date, by: Sequence[str] = (), months: int = 6
) -> DataFrame:
    """Rows in the window per calendar day, with and without spike days."""
    start, end = growth_window(today, months)
    totals = mark_spikes(daily, by).groupBy(*by).agg(
        F.sum("n").alias("_n"),
        F.coalesce(F.sum(F.when(F.col("spike"), F.col("n"))), F.lit(0)).alias("_spike_rows"),
        F.count_if("spike").alias("spike_days"),
    )
    if by:
        joined = subjects.join(totals, list(by), "left")
    else:
        joined = totals
    days = F.datediff(end, start)
    rows = F.coalesce("_n", F.lit(0))
    return joined.select(
        *by,
        days.alias("days"),
        rows.alias("records_in_window"),
        round_half_up(rows / days).alias("avg_per_day"),
        F.coalesce("spike_days", F.lit(0)).alias("spike_days"),
        round_half_up(
            (rows - F.coalesce("_spike_rows", F.lit(0)))
            / F.greatest(F.lit(1), days - F.coalesce("spike_days", F.lit(0)))
        ).alias("avg_without_spikes"),
    )


def net_growth(
    snapshots: DataFrame, archived: DataFrame, today: str | date, by: Sequence[str], days: int = 180
) -> DataFrame:
    """(rows today − rows ``days`` ago + rows archived in between) per day, from daily snapshots ``(by, day, rows)``.

    Each end uses the latest snapshot on or before its day.
    """
    end = F.lit(str(today)).cast("date")
    start = F.date_sub(end, days)
    ends = snapshots.where(F.col("day") <= end).groupBy(*by).agg(
        F.max_by("rows", "day").alias("rows_now"),
        F.max_by(F.when(F.col("day") <= start, F.col("rows")), F.when(F.col("day") <= start, F.col("day"))).alias(
            "rows_before"
        ),
    )
    moved = archived.where((F.col("day") > start) & (F.col("day") <= end)).groupBy(*by).agg(
        F.sum("n").alias("archived")
    )
    archived_rows = F.coalesce("archived", F.lit(0))
    return ends.join(moved, list(by), "left").select(
        *by, "rows_now", "rows_before", archived_rows.alias("archived"),
        round_half_up((F.col("rows_now") - F.col("rows_before") + archived_rows) / F.lit(days)).alias("net_per_day"),
    )


def capacity_runway(capacity: Column, level_pct: Column | float, size: Column, per_day: Column) -> Column:
    """Days until the size reaches ``level_pct`` percent of the capacity; NULL without growth."""
    level_pct = F.lit(level_pct) if not isinstance(level_pct, Column) else level_pct
    return F.when(per_day > 0, (capacity * level_pct / 100 - size) / per_day)


def lateness_counts(lag_days: Column, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, value, n)`` of an integer measure: small whatever the table's size."""
    return df.where(lag_days.isNotNull()).groupBy(*by, lag_days.alias("value")).agg(F.count(F.lit(1)).alias("n"))

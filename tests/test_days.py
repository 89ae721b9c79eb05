"""Days in zones, cutoffs, windows, and what reaches the scan."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.functions.days import (
    before_day,
    column_type,
    eligibility_cutoff,
    growth_window,
    local_day,
    local_today,
    within_window,
)

ZONE = "Asia/Kolkata"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "today, months, grace, expected",
    [
        ("2026-09-30", 6, 0, "2026-03-30"),
        ("2026-09-30", 6, 7, "2026-03-23"),
        ("2026-09-30", 6, 30, "2026-02-28"),
        ("2026-08-31", 6, 0, "2026-03-03"),  # February has no 31st: the day runs over
        ("2024-03-31", 1, 0, "2024-03-02"),
    ],
)
def test_cutoff(spark, today, months, grace, expected):
    assert str(one(spark, eligibility_cutoff(today, months, grace))[0]) == expected


@pytest.mark.parametrize("today, start, end, days", [
    ("2026-09-30", "2026-03-01", "2026-09-01", 184),
    ("2024-03-10", "2023-09-01", "2024-03-01", 182),  # a leap February inside
])
def test_growth_window(spark, today, start, end, days):
    low, high = growth_window(today)
    row = one(spark, low, high, F.datediff(high, low))
    assert (str(row[0]), str(row[1]), row[2]) == (start, end, days)


def test_local_day_by_type(spark):
    rows = spark.sql(
        """SELECT DATE '2025-07-31' AS d, TIMESTAMP_NTZ '2025-07-31 23:59:59' AS n,
                  TIMESTAMP '2025-07-31 18:29:59+00:00' AS before, TIMESTAMP '2025-07-31 18:30:00+00:00' AS after"""
    )
    days = rows.select(*(local_day(F.col(c), column_type(rows, c), ZONE).alias(c) for c in rows.columns)).first()
    assert [str(d) for d in days] == ["2025-07-31", "2025-07-31", "2025-07-31", "2025-08-01"]


def test_local_day_does_not_depend_on_the_session_zone(spark):
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = spark.sql("SELECT TIMESTAMP '2025-07-31 18:30:00+00:00' AS t")
        kind = column_type(rows, "t")
        early = before_day(F.col("t"), kind, "2025-08-01", ZONE)
        row = rows.select(local_day(F.col("t"), kind, ZONE), early).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (str(row[0]), row[1]) == ("2025-08-01", False)


def test_text_dates_are_refused(spark):
    rows = spark.sql("SELECT '2025-01-01' AS t")
    with pytest.raises(TypeError):
        local_day(F.col("t"), column_type(rows, "t"), ZONE)


def test_null_dates_never_match(spark):
    rows = spark.sql("SELECT CAST(NULL AS DATE) AS d")
    assert rows.where(before_day(F.col("d"), column_type(rows, "d"), "2999-01-01", ZONE)).count() == 0


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_day_filter_reaches_the_parquet_scan(spark, folder, kind):
    rows = spark.sql(f"SELECT id, CAST(TIMESTAMP_NTZ '2025-01-01 10:00:00' AS {kind}) AS t FROM range(10)")
    rows.write.parquet(f"{folder}/t")
    stored = spark.read.parquet(f"{folder}/t")
    early = stored.where(before_day(F.col("t"), column_type(stored, "t"), "2025-06-01", ZONE))
    plan = early._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "LessThan(t," in pushed


@pytest.mark.parametrize("clock, inside", [("21:59", False), ("22:00", True), ("04:59", True), ("05:00", False)])
def test_window_past_midnight(spark, clock, inside):
    instant = F.lit(f"2025-01-01 {clock}:30").cast("timestamp")
    got = one(spark, within_window(instant, F.lit("22:00"), F.lit("05:00"), F.lit("UTC")))[0]
    assert got is inside


def test_local_today(spark):
    now = F.lit("2026-09-29 20:00:00").cast("timestamp")
    assert one(spark, local_today(ZONE, now))[0] == dt.date(2026, 9, 30)

"""Severity, growth, alerts, rollups and order statistics."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions.severity import (
    Thresholds,
    days_to_threshold,
    health_status,
    max_level,
    near_threshold,
    percent_of,
    round_half_up,
)
from tideline.operators import growth, health, stats

RECORDS = Thresholds(1_000_000, 1_100_000, 1_200_000)
ZONE = "Asia/Kolkata"


def values(spark, numbers, column):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n long")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_levels_include_their_threshold(spark):
    n = F.col("n")
    numbers = [999_999, 1_000_000, 1_099_999, 1_100_000, 1_200_000]
    assert values(spark, numbers, RECORDS.level(n)) == ["NONE", "LOW", "LOW", "MEDIUM", "HIGH"]
    assert values(spark, numbers, RECORDS.next_level(n)) == ["LOW", "MEDIUM", "MEDIUM", "HIGH", None]
    assert values(spark, numbers, RECORDS.next_threshold(n)) == [1_000_000, 1_100_000, 1_100_000, 1_200_000, None]


def test_projection(spark):
    n = F.col("n")
    assert values(spark, [17_600, 0, -5], days_to_threshold(n, F.lit(1240))) == [15, 0, 0]
    assert values(spark, [10], days_to_threshold(n, F.lit(0))) == [None]
    assert values(spark, [10], days_to_threshold(n, F.lit(None).cast("long"))) == [None]


def test_rounding(spark):
    n = F.col("n")
    assert values(spark, [5, -5, 4], round_half_up(n / 10)) == [1, 0, 0]
    assert values(spark, [1, 2], percent_of(n, F.lit(3))) == [33.33, 66.67]
    assert values(spark, [1], percent_of(n, F.lit(0))) == [None]


def test_level_helpers(spark):
    assert values(spark, [1], max_level(F.lit("LOW"), F.lit("HIGH"), F.lit("NONE"))) == ["HIGH"]
    for level, status in (("NONE", "healthy"), ("LOW", "attention"), ("MEDIUM", "attention"), ("HIGH", "critical")):
        assert values(spark, [1], health_status(F.lit(level))) == [status]
    assert values(spark, [950_000, 949_999, 1_050_000], near_threshold(F.col("n"), Thresholds(1e6, 9e9, 9e9))) == [
        True, False, True
    ]


def daily(spark, counts, by=None):
    rows = [(dt.date(2026, 3, 1) + dt.timedelta(days=i), n) for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "day date, n long")


def test_spikes(spark):
    rows = growth.spike_days(daily(spark, [100] * 9 + [5000])).collect()
    assert [(r["n"], r["median"]) for r in rows] == [(5000, 100)]
    assert growth.spike_days(daily(spark, [100] * 5 + [5000])).isEmpty()  # fewer than seven days
    assert growth.spike_days(daily(spark, [1, 1, 1, 1, 9, 9, 9, 46])).collect()[0]["n"] == 46  # upper median is 9
    assert growth.spike_days(daily(spark, [1, 1, 1, 1, 9, 9, 9, 45])).isEmpty()


def attendance(spark):
    """Ten rows per local day from 2025-01-01 to 2026-09-29, and five undated ones."""
    return spark.sql(
        """SELECT id, TIMESTAMP '2024-12-31 20:00:00+00:00' + make_dt_interval(CAST(id DIV 10 AS INT)) AS created_at
           FROM range(6370) UNION ALL SELECT id + 10000, CAST(NULL AS TIMESTAMP) FROM range(5)"""
    )


def test_measured_growth(spark):
    rows = attendance(spark)
    assert rows.count() == 6375
    status = growth.growth_status(rows, "created_at", ZONE, "2026-09-30").first()
    assert status["status"] == "measured"
    per_day = growth.growth_daily(rows, "created_at", ZONE, "2026-09-30")
    row = growth.growth_average(per_day, spark.range(1), "2026-09-30").first()
    assert (row["days"], row["records_in_window"], row["avg_per_day"], row["spike_days"]) == (184, 1840, 10, 0)
    months = growth.growth_monthly(per_day, spark.range(1).select(), "2026-09-30").orderBy("month").collect()
    assert [r["records_added"] for r in months] == [310, 300, 310, 300, 310, 310]
    assert [str(r["month"]) for r in months][0] == "2026-03-01"


def test_too_little_history(spark):
    young = attendance(spark).where(F.col("created_at") > F.lit("2026-03-02").cast("timestamp"))
    assert growth.growth_status(young, "created_at", ZONE, "2026-09-30").first()["status"] == "insufficient_history"
    empty = young.limit(0)
    assert growth.growth_status(empty, "created_at", ZONE, "2026-09-30").first()["reason"] == "table is empty"
    unknown = growth.growth_status(young, None, ZONE, "2026-09-30").first()
    assert (unknown["status"], unknown["reason"]) == ("insufficient_history", "no insertion column")


def test_months_without_rows_are_zero(spark):
    rows = spark.sql("SELECT 'a' AS t, DATE '2026-03-05' AS d UNION ALL SELECT 'a', DATE '2026-03-05'")
    per_day = growth.growth_daily(rows, "d", ZONE, "2026-09-30", ["t"])
    months = growth.growth_monthly(per_day, rows.select("t").distinct(), "2026-09-30", ["t"]).orderBy("month").collect()
    assert [r["records_added"] for r in months] == [2, 0, 0, 0, 0, 0]


def test_net_growth(spark):
    snapshots = spark.createDataFrame(
        [("a", dt.date(2026, 1, 1), 1000), ("a", dt.date(2026, 9, 30), 1500)], "t string, day date, rows long"
    )
    archived = spark.createDataFrame([("a", dt.date(2026, 8, 1), 400)], "t string, day date, n long")
    row = growth.net_growth(snapshots, archived, "2026-09-30", ["t"]).first()
    assert (row["archived"], row["net_per_day"]) == (400, 5)


def test_alert_changes(spark):
    levels = Thresholds(10, 20, 30)
    observed = [5, 12, 15, 25, 35, 22, 3, 2, 11]
    rows = spark.createDataFrame([("t", i, n) for i, n in enumerate(observed)], "t string, at int, n long")
    got = health.alert_transitions(rows, levels, ["t"], "at", "n").orderBy("at").collect()
    assert [(r["at"], r["action"], r["level"], r["escalated_from"]) for r in got] == [
        (1, "open", "LOW", None), (2, "update", "LOW", None), (3, "replace", "MEDIUM", "LOW"),
        (4, "replace", "HIGH", "MEDIUM"), (5, "replace", "MEDIUM", "HIGH"), (6, "resolve", "NONE", None),
        (8, "open", "LOW", None),
    ]


@pytest.mark.parametrize("seed", [3, 4])
def test_percentiles_by_index(spark, seed):
    random.seed(seed)
    numbers = [random.choice([1, 1, 1, 2, 5, 9, 50, 400]) for _ in range(random.randint(1, 500))]
    rows = spark.createDataFrame([(n,) for n in numbers], "v long")
    histogram = growth.lateness_counts(F.col("v"), rows)
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = stats.index_percentiles(histogram, points).first()
    ordered = sorted(numbers)
    for name, p in points.items():
        assert got[name] == ordered[min(len(ordered) - 1, int(p * len(ordered)))]
    assert (got["n"], got["max"]) == (len(numbers), ordered[-1])


def test_unknown_capacity_counts_as_full(spark):
    tables = spark.createDataFrame(
        [(1, "t", 10, "NONE", "archive", 5)],
        "app_id int, table_name string, row_count long, severity string, policy string, avg_daily_growth long",
    )
    apps = spark.createDataFrame(
        [(1, 50, 100, "connected"), (2, 50, 0, "connected"), (3, 95, 100, "degraded")],
        "app_id int, database_mb int, capacity_mb int, connection_status string",
    )
    got = {r["app_id"]: r for r in health.app_health(apps, tables, health.HealthSettings()).collect()}
    assert (got[1]["status"], got[2]["status"], got[3]["status"]) == ("healthy", "critical", "unknown")
    assert (got[1]["table_count"], got[2]["table_count"], got[3]["db_severity"]) == (1, 0, "HIGH")

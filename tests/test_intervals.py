"""Days in ranges against every pair, and how few pieces a range has."""

import datetime
import random

from pyspark.sql import functions as F

from tideline.operators import intervals, rollups

D = datetime.date


def test_against_every_pair(spark):
    rng = random.Random(3)
    ranges = []
    for i in range(300):
        first = D(2000, 1, 1) + datetime.timedelta(days=rng.randint(0, 4000))
        ranges.append((i, first, first + datetime.timedelta(days=rng.choice([0, 1, 2, 30, 365, 3000, -1, -40]))))
    ranges += [(900, None, D(2001, 1, 1)), (901, D(2001, 1, 1), None), (902, D(1, 1, 1), D(9999, 12, 31)), (0, *ranges[0][1:]), (0, *ranges[0][1:])]
    days = [D(2000, 1, 1) + datetime.timedelta(days=rng.randint(-50, 8000)) for _ in range(150)] + [None, D(2003, 5, 5), D(2003, 5, 5), D(1, 1, 1), D(9999, 12, 31)]
    found = intervals.days_in_ranges(
        spark.createDataFrame(ranges, "job long, first_day date, last_day date"), spark.createDataFrame([(d,) for d in days], "day date")
    )
    want = sorted((j, d) for j, a, b in ranges if a and b for d in set(days) - {None} if a <= d <= b)
    assert sorted((r.job, r.day) for r in found.collect()) == want


def test_pieces_grow_with_the_logarithm(spark):
    row = spark.sql("SELECT DATE '2001-01-02' AS a, DATE '2020-12-30' AS b")
    pieces = row.select(intervals.dyadic_pieces(F.col("a"), F.col("b"))).first()[0]
    assert len(pieces) <= 2 * 13 and sum(2 ** p["size"] for p in pieces) == (D(2020, 12, 30) - D(2001, 1, 2)).days + 1
    assert len(row.select(intervals.day_pieces(F.col("a"))).first()[0]) == intervals.SIZES + 1


def test_plan_is_an_equi_join(spark):
    ranges = spark.sql("SELECT id, date_add(DATE '2001-01-01', CAST(id AS INT)) AS first_day, DATE '2010-01-01' AS last_day FROM range(10)")
    plan = intervals.days_in_ranges(ranges, ranges.select(F.col("first_day").alias("day")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_jobs_of_days_are_counted_without_pairs(spark):
    rows = [(1, "2001-01-01", "2001-01-05"), (1, "2001-01-03", "2001-01-09"), (1, "2001-01-09", "2001-01-09"), (2, "2001-01-04", "2001-01-02")]
    rows += [(3, None, "2001-01-05"), (4, "2001-01-05", "2003-05-01"), (None, "2001-01-05", "2001-01-05"), (4, "2001-01-05", "2003-05-01")]
    covered = spark.createDataFrame(rows, "job_id long, a string, b string").selectExpr(
        "job_id", "'t' AS table_name", "CAST(a AS DATE) AS first_day", "CAST(b AS DATE) AS last_day"
    )
    days = spark.sql("SELECT explode(array(DATE'2001-01-03', DATE'2001-01-05', DATE'2001-01-05', DATE'2001-01-09', DATE'2002-01-01', DATE'2009-01-01', NULL)) AS day")
    pairs = rollups.restore_lookup_ranges(covered, days)
    assert sorted((str(r.day), r.job_id or 0) for r in pairs.collect()) == [
        ("2001-01-03", 1), ("2001-01-05", 0), ("2001-01-05", 1), ("2001-01-05", 4), ("2001-01-09", 1), ("2001-01-09", 4), ("2002-01-01", 4)
    ]
    counted = rollups.restore_lookup_ranges(covered, days, counted=True)
    found = {(str(r.day), r.jobs, r.first_job, r.last_job) for r in counted.collect()}
    assert found == {("2001-01-03", 1, 1, 1), ("2001-01-05", 3, 1, 4), ("2001-01-09", 2, 1, 4), ("2002-01-01", 1, 4, 4)}

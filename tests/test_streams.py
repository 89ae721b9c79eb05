"""Streams over several micro-batches: late rows, restarts and repeats."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.functions.severity import Thresholds
from tideline.sources import state
from tideline.streaming import jobs

SCHEMA = "id long, ts timestamp, kind string"


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def stream(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/in")


def at(day, hour=12):
    return dt.datetime(2025, 1, 1, hour) + dt.timedelta(days=day - 1)


def run(query):
    query.awaitTermination()


def test_days_close_after_their_grace_period(spark, folder):
    def drain():
        closed = jobs.stream_daily_totals(stream(spark, folder), "ts", "Asia/Kolkata", 2)
        run(jobs.append_sink(closed, f"{folder}/out", f"{folder}/progress"))
        rows = spark.read.schema("day date, n long").parquet(f"{folder}/out").collect()
        return {str(r["day"]): r["n"] for r in rows}

    add(spark, folder, [(1, at(1), "a"), (2, at(2), "a"), (3, at(2, 20), "a")])  # 20:00 UTC is the next day there
    assert drain() == {}
    add(spark, folder, [(4, at(1), "a"), (5, at(5), "a")])  # a late row, still inside the grace period
    first = drain()
    assert first == {"2025-01-01": 2, "2025-01-02": 1}
    add(spark, folder, [(6, at(1), "a"), (7, at(9), "a")])  # too late: its day is closed and stays as it was
    second = drain()
    assert {k: second[k] for k in first} == first
    assert second["2025-01-03"] == 1 and second["2025-01-05"] == 1


def test_late_rows(spark, folder):
    add(spark, folder, [(1, at(1), "a"), (2, at(5), "a"), (3, at(20), "a"), (4, at(1), "b")])
    bounds = spark.createDataFrame([("a", dt.date(2025, 1, 3), dt.date(2025, 1, 10))],
                                   "kind string, first_day date, boundary_day date")
    marked = jobs.classify_late(stream(spark, folder), bounds, "ts", ["kind"], "UTC").select("id", "arrival")
    run(jobs.append_sink(marked, f"{folder}/out", f"{folder}/progress"))
    got = {r["id"]: r["arrival"] for r in spark.read.schema("id long, arrival string").parquet(f"{folder}/out").collect()}
    assert got == {1: "backdated", 2: "late_in_range", 3: "on_time", 4: "on_time"}


def test_alerts_remember_their_level(spark, folder):
    schema = "subject string, at timestamp, observed long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)

    def drain(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"{folder}/in")
        changes = jobs.stream_alerts(source, Thresholds(10, 20, 30))
        run(jobs.append_sink(changes, f"{folder}/out", f"{folder}/progress"))
        found = spark.read.schema(changes.schema).parquet(f"{folder}/out").orderBy("subject", "at").collect()
        return [(r["subject"], r["at"].day, r["action"], r["level"], r["escalated_from"]) for r in found]

    try:
        assert drain([("x", at(2), 12), ("x", at(1), 5), ("y", at(1), 40)]) == [
            ("x", 2, "open", "LOW", None), ("y", 1, "open", "HIGH", None)
        ]
        assert drain([("x", at(3), 14), ("x", at(4), 25), ("y", at(2), 1)])[1:3] == [
            ("x", 3, "update", "LOW", None), ("x", 4, "replace", "MEDIUM", "LOW")
        ]
        assert drain([("y", at(3), 3)])[-1] == ("y", 2, "resolve", "NONE", None)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_snapshots_keep_the_latest(spark, folder):
    def drain():
        source = stream(spark, folder).select("kind", "ts", "id")
        run(jobs.upsert_sink(source, f"{folder}/out", f"{folder}/progress", ["kind"], ["ts"]))
        now = state.current_state(spark, f"{folder}/out", source.schema, ["kind"], "ts")
        return {r["kind"]: r["id"] for r in now.collect()}

    add(spark, folder, [(1, at(1), "a"), (2, at(3), "a"), (3, at(1), "b")])
    assert drain() == {"a": 2, "b": 3}
    add(spark, folder, [(4, at(2), "a"), (5, at(4), "b")])
    assert drain() == {"a": 2, "b": 5}


def test_ledger_runs_a_batch_once(spark, folder):
    def drain(source):
        requests = stream(spark, folder).select(F.col("id").alias("job_id"), F.col("kind").alias("batch_no"))
        run(jobs.ledger_sink(requests, f"{folder}/ledger", f"{folder}/{source}", source))
        done = state.read_deltas(spark, f"{folder}/ledger", requests.schema)
        return sorted((r["job_id"], r["batch_no"]) for r in done.collect())

    add(spark, folder, [(1, at(1), "0"), (1, at(1), "0"), (1, at(1), "1")])
    assert drain("one") == [(1, "0"), (1, "1")]
    add(spark, folder, [(1, at(2), "1"), (2, at(2), "0")])
    assert drain("one") == [(1, "0"), (1, "1"), (2, "0")]
    assert drain("two") == [(1, "0"), (1, "1"), (2, "0")]


def test_repeats_are_suppressed_inside_the_window(spark, folder):
    def drain():
        kept = jobs.stream_suppress(stream(spark, folder), "ts", ["kind"], 24).select("id")
        run(jobs.append_sink(kept, f"{folder}/out", f"{folder}/progress"))
        return sorted(r["id"] for r in spark.read.schema("id long").parquet(f"{folder}/out").collect())

    add(spark, folder, [(1, at(1, 1), "a")])
    assert drain() == [1]
    add(spark, folder, [(2, at(1, 20), "a"), (3, at(9), "b")])
    assert drain() == [1, 3]
    add(spark, folder, [(4, at(9, 14), "a")])  # long after the first one: reported again
    assert drain() == [1, 3, 4]


@pytest.mark.parametrize("batches", [[4], [1, 1, 1, 1], [2, 2], [3, 1]])
def test_suppression_does_not_depend_on_the_batches(spark, folder, batches):
    events = [(i, at(1 + 4 * i), "a") for i in range(4)]
    for size in batches:
        add(spark, folder, events[:size])
        events = events[size:]
        kept = jobs.stream_suppress(stream(spark, folder), "ts", ["kind"], 24).select("id")
        run(jobs.append_sink(kept, f"{folder}/out", f"{folder}/progress"))
    rows = spark.read.schema("id long").parquet(f"{folder}/out").collect()
    assert sorted(r["id"] for r in rows) == [0, 1, 2, 3]


def test_audit_is_append_only(spark, folder):
    for i in range(2):
        add(spark, folder, [(i, at(i + 1), "x")])
        run(jobs.append_sink(stream(spark, folder), f"{folder}/out", f"{folder}/progress"))
    assert spark.read.schema(SCHEMA).parquet(f"{folder}/out").count() == 2

"""Streaming queries: the event table read as a stream until it is exhausted, results read back from the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.severity import Thresholds
from tideline.queries.groups import ZONE
from tideline.queries.registry import Inputs, check_table, query
from tideline.session import scratch_path
from tideline.sources import state
from tideline.streaming import jobs

GRACE_DAYS = 2


def event_stream(inputs: Inputs) -> DataFrame:
    reader = inputs.spark.readStream.schema(inputs.events.schema)
    return reader.option("pathGlobFilter", "events.parquet").parquet(inputs.folder)


def drain(inputs: Inputs, stream: DataFrame, label: str) -> DataFrame:
    """Run a stream to the end of its input and return what its append sink holds."""
    path = scratch_path(inputs.spark, label)
    jobs.append_sink(stream, path, scratch_path(inputs.spark, "progress")).awaitTermination()
    return inputs.spark.read.schema(stream.schema).parquet(path)


check_table(
    "closed_days",
    f"""
SELECT event_type, day, count(*) AS n
FROM (SELECT event_type, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day FROM {{events}})
WHERE CAST(day + 1 AS TIMESTAMP) <= (SELECT max(ts) + INTERVAL 330 MINUTE - INTERVAL {GRACE_DAYS} DAY FROM {{events}})
GROUP BY 1, 2
""",
)


def closed_days(inputs: Inputs) -> DataFrame:
    return jobs.stream_daily_totals(event_stream(inputs), "ts", ZONE, GRACE_DAYS, ["event_type"], ntz_is_utc=True)


@query("stream_daily_totals", "SELECT event_type, CAST(day AS VARCHAR) AS day, n FROM {closed_days}")
def daily(inputs: Inputs) -> DataFrame:
    return drain(inputs, closed_days(inputs), "days")


@query(
    "stream_late_rows",
    """
SELECT event_id, event_type, CAST(day AS VARCHAR) AS day,
       CASE WHEN day < first_day THEN 'backdated' WHEN day <= boundary_day THEN 'late_in_range' ELSE 'on_time' END
         AS arrival
FROM (SELECT event_id, event_type, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day FROM {events}) e
JOIN (SELECT event_type AS t, CAST(min(ts) AS DATE) + 2 AS first_day, CAST(min(ts) AS DATE) + 9 AS boundary_day
      FROM {events} WHERE event_type <> 'signup' GROUP BY 1) b ON t = event_type
UNION ALL
SELECT event_id, event_type, CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS VARCHAR), 'on_time' FROM {events}
WHERE event_type = 'signup'
""",
)
def late(inputs: Inputs) -> DataFrame:
    first = F.min("ts").cast("date")
    boundaries = inputs.events.where("event_type <> 'signup'").groupBy("event_type").agg(
        F.date_add(first, 2).alias("first_day"), F.date_add(first, 9).alias("boundary_day")
    )
    marked = jobs.classify_late(event_stream(inputs), boundaries, "ts", ["event_type"], ZONE, ntz_is_utc=True)
    return drain(inputs, marked.select("event_id", "event_type", "day", "arrival"), "late")


def alert_limits(inputs: Inputs) -> Thresholds:
    """Around the average number of events per type and day, so levels move at every scale."""
    average = inputs.events.count() / 150
    return Thresholds(average * 0.9, average, average * 1.1)


@query(
    "stream_alerts",
    """
WITH limits AS (SELECT count(*) / 150 AS a FROM {events}), leveled AS (
  SELECT event_type, day, n, CASE WHEN n >= a * 1.1 THEN 'HIGH' WHEN n >= a THEN 'MEDIUM' WHEN n >= a * 0.9 THEN 'LOW'
         ELSE 'NONE' END AS level FROM {closed_days}, limits
), moved AS (
  SELECT *, coalesce(lag(level) OVER (PARTITION BY event_type ORDER BY day), 'NONE') AS before FROM leveled
)
SELECT event_type AS subject, CAST(CAST(day AS TIMESTAMP) AS VARCHAR) AS at, n AS observed, level,
       CASE WHEN level = 'NONE' THEN 'resolve' WHEN before = 'NONE' THEN 'open' WHEN level = before THEN 'update'
            ELSE 'replace' END AS action,
       CASE WHEN level <> 'NONE' AND before <> 'NONE' AND level <> before THEN before END AS escalated_from
FROM moved WHERE level <> 'NONE' OR before <> 'NONE'
""",
)
def alerts(inputs: Inputs) -> DataFrame:
    """Closed day totals written by one stream, turned into alert changes by a second one."""
    spark = inputs.spark
    path = scratch_path(spark, "observed")
    observed = closed_days(inputs).select(
        F.col("event_type").alias("subject"), F.col("day").cast("timestamp").alias("at"), F.col("n").alias("observed")
    )
    jobs.append_sink(observed, path, scratch_path(spark, "progress")).awaitTermination()
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    try:
        stream = spark.readStream.schema(observed.schema).parquet(path)
        return drain(inputs, jobs.stream_alerts(stream, alert_limits(inputs)), "alerts")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


@query(
    "stream_snapshots",
    """
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS captured_on, max(event_id) AS captured_at,
       arg_max(value, event_id) AS value
FROM {events} GROUP BY 1, 2
""",
)
def snapshots(inputs: Inputs) -> DataFrame:
    path = scratch_path(inputs.spark, "snapshots")
    stream = event_stream(inputs).select(
        "user_id", F.col("ts").cast("date").alias("captured_on"), F.col("event_id").alias("captured_at"), "value"
    )
    keys = ["user_id", "captured_on"]
    jobs.upsert_sink(stream, path, scratch_path(inputs.spark, "progress"), keys, ["captured_at"]).awaitTermination()
    return state.current_state(inputs.spark, path, stream.schema, keys, "captured_at")


@query("stream_audit", "SELECT event_id, event_type AS action, user_id AS actor FROM {events}")
def audit(inputs: Inputs) -> DataFrame:
    entries = event_stream(inputs).select(
        "event_id", F.col("event_type").alias("action"), F.col("user_id").alias("actor")
    )
    return drain(inputs, entries, "audit")


@query(
    "stream_ledger",
    """
SELECT user_id AS job_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS batch_no, count(DISTINCT 1) AS runs FROM {events} GROUP BY 1, 2
""",
)
def ledger(inputs: Inputs) -> DataFrame:
    """The same requests arrive from two streams; each batch still runs once."""
    path = scratch_path(inputs.spark, "ledger")
    requests = event_stream(inputs).select(
        F.col("user_id").alias("job_id"), F.col("ts").cast("date").cast("string").alias("batch_no")
    )
    for source in ("first", "second"):
        jobs.ledger_sink(requests, path, scratch_path(inputs.spark, "progress"), source).awaitTermination()
    done = state.read_deltas(inputs.spark, path, requests.schema)
    return done.groupBy("job_id", "batch_no").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "stream_suppress",
    """
WITH RECURSIVE seen AS (SELECT DISTINCT user_id, event_type, epoch_us(ts) AS micros FROM {events}),
following AS (
  SELECT a.user_id, a.event_type, a.micros, min(b.micros) AS next_micros FROM seen a JOIN seen b
    ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.micros >= a.micros + 86400000000
  GROUP BY 1, 2, 3
), reported(user_id, event_type, micros) AS (
  SELECT user_id, event_type, min(micros) FROM seen GROUP BY 1, 2
  UNION ALL
  SELECT r.user_id, r.event_type, f.next_micros FROM reported r JOIN following f
    ON f.user_id = r.user_id AND f.event_type = r.event_type AND f.micros = r.micros
)
SELECT user_id, event_type, micros FROM reported
""",
)
def suppressed(inputs: Inputs) -> DataFrame:
    stream = event_stream(inputs).select("user_id", "event_type", jobs.utc_instant(F.col("ts")).alias("ts"))
    kept = jobs.stream_suppress(stream, "ts", ["user_id", "event_type"], 24)
    return drain(inputs, kept.select("user_id", "event_type", F.unix_micros("ts").alias("micros")), "suppressed")

"""Streaming forms of the day totals, late rows, alerts, snapshots, audit log, batch ledger and suppression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tideline.functions.days import column_type, local_day
from tideline.functions.severity import LEVELS, Thresholds
from tideline.session import path_exists
from tideline.sources.state import latest_wins, read_deltas, write_delta

_AT = "_at_micros"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_wall_clock(column: Column, data_type: T.DataType, time_zone: str, ntz_is_utc: bool = False) -> Column:
    """The clock reading in the business zone, held as if it were UTC.

    Watermarks need a timestamp with zone, and day windows start at UTC midnight; so a one-day window over
    this clock is a local day in every season.
    """
    if isinstance(data_type, T.TimestampNTZType):
        clock = F.convert_timezone(F.lit("UTC"), F.lit(time_zone), column) if ntz_is_utc else column
    else:
        clock = F.convert_timezone(None, F.lit(time_zone), column)
    return utc_instant(clock)


def utc_instant(clock: Column) -> Column:
    """The instant at which a clock in UTC shows a zone-less timestamp, whatever the session's zone is."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), clock).cast("timestamp")


def stream_daily_totals(
    stream: DataFrame, column: str, time_zone: str, grace_days: int, by: Sequence[str] = (), ntz_is_utc: bool = False
) -> DataFrame:
    """Closed local days only: a day is emitted once, after the grace days have passed it."""
    clock = local_wall_clock(F.col(column), column_type(stream, column), time_zone, ntz_is_utc)
    return (
        stream.select(*by, clock.alias("_clock"))
        .withWatermark("_clock", f"{grace_days} days")
        .groupBy(F.window("_clock", "1 day"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*by, F.convert_timezone(None, F.lit("UTC"), F.col("window.start")).cast("date").alias("day"), "n")
    )


def classify_late(
    rows: DataFrame, boundaries: DataFrame, column: str, by: Sequence[str], time_zone: str, ntz_is_utc: bool = False
) -> DataFrame:
    """on_time, late_in_range or backdated, against the archived range of the row's group.

    ``boundaries``: by, first_day, boundary_day. Works on a stream and on a table alike.
    """
    day = local_day(F.col(column), column_type(rows, column), time_zone, ntz_is_utc)
    joined = rows.join(boundaries, list(by), "left").withColumn("day", day)
    kind = (
        F.when(F.col("day") < F.col("first_day"), "backdated")
        .when(F.col("day") <= F.col("boundary_day"), "late_in_range")
        .otherwise("on_time")
    )
    return joined.withColumn("arrival", kind).drop("first_day", "boundary_day")


def stream_suppress(stream: DataFrame, column: str, keys: Sequence[str], hours: int) -> DataFrame:
    """Report a key, then leave out its repeats until ``hours`` after the time that was reported.

    The last reported time of each key is kept in state, so events that arrive in order are reported the same way
    however they are split into batches. A late event is left out if it is within the window of the last report.
    """
    window = hours * 3_600_000_000

    def report(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found = list(frames)
        rows = found[0] if len(found) == 1 else pd.concat(found)
        # Keys are many and have few rows each, so what a call costs counts.
        times = rows[_AT].to_numpy()
        order = np.argsort(times, kind="stable")
        last = state.get[0] if state.exists else None
        kept = []
        for place, at in zip(order.tolist(), times[order].tolist()):
            if last is None or abs(at - last) >= window:
                kept.append(place)
                last = at if last is None else max(last, at)
        state.update((last,))
        yield rows.iloc[kept, :width]

    width = len(stream.columns)
    timed = stream.withColumn(_AT, F.unix_micros(column))
    return timed.groupBy(*keys).applyInPandasWithState(
        report, stream.schema, "last long", "append", GroupStateTimeout.NoTimeout
    )


ALERT_OUTPUT = T.StructType(
    [
        T.StructField("subject", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("observed", T.LongType()),
        T.StructField("level", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("escalated_from", T.StringType()),
    ]
)


class AlertProcessor(StatefulProcessor):
    """Keeps the active level of one subject and turns observations into alert changes."""

    def __init__(self, thresholds: Thresholds):
        self.limits = (thresholds.low, thresholds.medium, thresholds.high)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "level string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stored = self.level.get() if self.level.exists() else None
        active = stored[0] if stored else "NONE"
        # One observation per subject and day, so a subject's rows of one batch are few.
        observed = pd.concat(rows).sort_values("at")
        codes = sum((observed["observed"] >= limit).astype(int) for limit in self.limits)
        levels = codes.map(lambda c: LEVELS[c])
        before = levels.shift(1, fill_value=active)
        action = pd.Series("replace", index=observed.index)
        action[levels == before] = "update"
        action[before == "NONE"] = "open"
        action[levels == "NONE"] = "resolve"
        changed = (levels != "NONE") & (before != "NONE") & (levels != before)
        out = pd.DataFrame(
            {
                "subject": key[0],
                "at": observed["at"],
                "observed": observed["observed"],
                "level": levels,
                "action": action,
                "escalated_from": before.where(changed, None),
            }
        )
        self.level.update((levels.iloc[-1],))
        yield out[(levels != "NONE") | (before != "NONE")]

    def close(self) -> None:
        pass


def stream_alerts(stream: DataFrame, thresholds: Thresholds) -> DataFrame:
    """``(subject, at, observed)`` in, alert changes out; one active alert per subject."""
    return stream.groupBy("subject").transformWithStateInPandas(
        AlertProcessor(thresholds), outputStructType=ALERT_OUTPUT, outputMode="Append", timeMode="None"
    )


# --- sinks -------------------------------------------------------------------------------------------------


def append_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Files are added, each exactly once; nothing is rewritten."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def upsert_sink(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]
) -> StreamingQuery:
    """Each batch writes its newest row per key as a delta; readers take the newest over all deltas."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_delta(latest_wins(batch, keys, order), path, batch_id)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ledger_sink(
    stream: DataFrame, ledger: str, checkpoint: str, source: str, keys: Sequence[str] = ("job_id", "batch_no")
) -> StreamingQuery:
    """Run each requested batch once: one already in the ledger is skipped, so repeating it removes nothing.

    ``source`` names the stream; several may share a ledger if they run one after the other.
    """
    schema = T.StructType([*stream.schema.fields, T.StructField("source", T.StringType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        requested = batch.dropDuplicates(list(keys))
        if path_exists(spark, ledger):
            done = read_deltas(spark, ledger, schema)
            earlier = done.where((F.col("source") != source) | (F.col("batch") < batch_id))
            requested = requested.join(earlier.select(*keys), list(keys), "left_anti")
        write_delta(requested, f"{ledger}/source={source}", batch_id)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

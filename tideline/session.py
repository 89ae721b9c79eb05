"""Session settings and the shared scratch folder."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(
    app_name: str = "tideline",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings every job here relies on; cluster-owned settings stay with the cluster."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or where that is unset one in the session's warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "scratch")).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch folder that nothing else uses."""
    return os.path.join(scratch_root(spark), "tideline", f"{label}-{uuid.uuid4().hex}")


PARALLEL_JOBS = 16
SORTED_PARTITION_BYTES = 256 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, an upper bound for filtered scans."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sorted_partitions(df: DataFrame) -> int:
    """How many range partitions to sort ``df`` in: the session's number, or more when its size asks for it."""
    return max(estimated_bytes(df) // SORTED_PARTITION_BYTES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


DEALT_BYTES, DEALT_ROWS, MOST_PARTS, UNKNOWN_BYTES = 8 * 1024 * 1024, 100_000, 20_000, 1 << 60


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt out by ``keys``, so that grouping by them holds one part of bounded size at a time.

    A table whose groups are about as many as its rows is not made smaller before a shuffle: grouping first in each scan task
    only fills its memory and spills. The number of parts grows with the size; of an unknown size it is the session's. Files of
    narrow rows are too small to tell, and parts of no given number are put together by their bytes, so a known number of
    ``rows`` gives parts of ``DEALT_ROWS`` at most, whatever the session's number, and two at least, so rows meet by key only.
    """
    size = estimated_bytes(df)
    parts = min(size // DEALT_BYTES, MOST_PARTS) if size < UNKNOWN_BYTES else 0
    if rows is not None:
        return df.repartition(min(max(2, parts, -(-rows // DEALT_ROWS)), MOST_PARTS), *keys)
    enough = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys) if parts > enough else df.repartition(*keys)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts the lineage at a copy that outlives any executor, so several jobs can be derived from
    exactly the same rows.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """A path and the file system it lives on."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    found, file_system = hadoop_path(spark, path)
    return file_system.exists(found)


def small_frame(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    """A few driver-side rows as a DataFrame, without starting Python workers for them."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(parsed))


def in_parallel(spark: SparkSession, work: Callable, items: Iterable) -> list:
    """Submit independent Spark jobs from driver threads, so one table's job fills the gaps of another's."""
    items = list(items)
    if len(items) < 2:
        return [work(item) for item in items]
    with ThreadPoolExecutor(max_workers=min(len(items), PARALLEL_JOBS)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))

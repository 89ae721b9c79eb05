"""Table profiles from the data itself: sizes, counts, date columns and the insertion column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.days import is_date_type
from tideline.functions.severity import Thresholds, near_threshold
from tideline.session import in_parallel, small_frame

EXACT_COUNT_MAX_ROWS = 200_000

# Defaults that stamp the insertion time, and names that settle a tie.
INSERTION_DEFAULT = (
    r"(?i)\b(now\(\)|CURRENT_TIMESTAMP|clock_timestamp\(\)|statement_timestamp\(\)|transaction_timestamp\(\)"
    r"|timezone\('utc'::text, now\(\)\))"
)
INSERTION_NAMES = r"(?i)^(created_at|inserted_at|created|creation_time)$"


def scan_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, condition=None) -> DataFrame:
    """Parquet scan with only the wanted columns and the filter left to the reader."""
    df = spark.read.parquet(path)
    if condition is not None:
        df = df.where(condition)
    return df.select(*columns) if columns else df


def scan_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, lower: str, upper: str, partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table read in ranges of one column, one task per range."""
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", partition_column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .options(**(properties or {}))
        .load()
    )


def exact_row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def table_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes)`` of a table's files; names only, nothing is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(path).select("path", F.col("length").alias("bytes"))


def estimated_rows(spark: SparkSession, path: str) -> int:
    """Rows guessed from one file: its rows per byte times all bytes."""
    files = table_files(spark, path)
    sized = files.agg(F.sum("bytes").alias("total"), F.min_by("path", "path").alias("first"),
                      F.min_by("bytes", "path").alias("first_bytes")).first()
    if not sized["total"]:
        return 0
    return round(spark.read.parquet(sized["first"]).count() * sized["total"] / sized["first_bytes"])


def needs_exact_count(estimate, thresholds: Thresholds, exact_max: int = EXACT_COUNT_MAX_ROWS):
    """Count small tables, and those whose estimate is near a threshold."""
    return (estimate <= exact_max) | near_threshold(estimate, thresholds)


def estimate_then_exact(spark: SparkSession, paths: Mapping[str, str], thresholds: Thresholds,
                        exact_max: int = EXACT_COUNT_MAX_ROWS) -> DataFrame:
    """``(table_name, estimated_rows, exact_rows)``; a full count only where it matters."""
    sizes = in_parallel(spark, lambda p: estimated_rows(spark, p), paths.values())
    estimates = [{"table_name": t, "estimated_rows": n} for t, n in zip(paths, sizes)]
    frame = small_frame(spark, estimates, "table_name: string, estimated_rows: bigint")
    wanted = {r[0] for r in frame.where(needs_exact_count(F.col("estimated_rows"), thresholds, exact_max)).collect()}
    counts = [
        exact_row_count(spark.read.parquet(paths[t])).select(F.lit(t).alias("table_name"), F.col("n").alias("exact_rows"))
        for t in paths if t in wanted
    ]
    if not counts:
        return frame.withColumn("exact_rows", F.lit(None).cast("long"))
    return frame.join(reduce(DataFrame.unionByName, counts), "table_name", "left")


def profile_table(df: DataFrame, name: str, primary_key: Sequence[str], size_bytes: int | None = None) -> DataFrame:
    """One row about one table from a single aggregate: rows, key columns, date columns and their range."""
    dates = [f.name for f in df.schema.fields if is_date_type(f.dataType)]
    lows = [F.min(c).cast("timestamp_ntz") for c in dates]
    highs = [F.max(c).cast("timestamp_ntz") for c in dates]
    none = F.lit(None).cast("timestamp_ntz")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.least(*lows) if len(lows) > 1 else lows[0] if lows else none).alias("oldest"),
        (F.greatest(*highs) if len(highs) > 1 else highs[0] if highs else none).alias("newest"),
    ).select(
        F.lit(name).alias("table_name"),
        F.array(*(F.lit(c) for c in primary_key)).cast("array<string>").alias("primary_key"),
        F.lit(len(df.columns)).alias("columns"),
        F.array(*(F.lit(c) for c in dates)).cast("array<string>").alias("date_candidates"),
        F.lit(size_bytes).cast("long").alias("total_bytes"),
        "row_count", "oldest", "newest",
    )


def profile_catalog(
    spark: SparkSession, paths: Mapping[str, str], primary_keys: Mapping[str, Sequence[str]]
) -> DataFrame:
    """The profile of every table: one aggregate per table, and all of them in one job."""
    sizes = in_parallel(spark, lambda p: table_files(spark, p).agg(F.sum("bytes")).first()[0], paths.values())
    parts = [
        profile_table(spark.read.parquet(path), name, primary_keys.get(name, ()), size)
        for (name, path), size in zip(paths.items(), sizes)
    ]
    return reduce(DataFrame.unionByName, parts)


def insertion_columns(columns: DataFrame, by: Sequence[str]) -> DataFrame:
    """The column that stamps a row's insertion, per table; NULL when none or several could be it.

    ``columns``: by, column_name, ordinal, data_type, default_expr.
    """
    stamped = columns.where(F.col("data_type").startswith("timestamp") & F.col("default_expr").rlike(INSERTION_DEFAULT))
    preferred = F.col("column_name").rlike(INSERTION_NAMES)
    picked = stamped.groupBy(*by).agg(
        F.min_by("column_name", F.when(preferred, F.col("ordinal"))).alias("_preferred"),
        F.count(F.lit(1)).alias("_n"),
        F.min("column_name").alias("_only"),
    )
    choice = F.coalesce("_preferred", F.when(F.col("_n") == 1, F.col("_only")))
    return columns.select(*by).distinct().join(
        picked.select(*by, choice.alias("insertion_column")), list(by), "left"
    )


def new_tables(discovered: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tables seen for the first time, with the policy every new table starts from."""
    fresh = discovered.join(known.select(*keys), list(keys), "left_anti")
    return fresh.select(*keys, F.lit("REVIEW_REQUIRED").alias("policy"), F.lit(False).alias("enabled"))


def vanished_tables(known: DataFrame, discovered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known tables that are gone; they are marked, not forgotten."""
    gone = known.join(discovered.select(*keys), list(keys), "left_anti")
    return gone.select(*keys, F.lit(False).alias("is_present"))

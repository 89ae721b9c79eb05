"""State tables on plain files: latest-wins upserts kept as deltas, and append-only logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep_last_known: Sequence[str] = ()) -> DataFrame:
    """The newest row per key; columns in ``keep_last_known`` keep their newest non-NULL value.

    A running maximum per key, combined before the shuffle.
    """
    at = F.struct(*order)
    rest = [c for c in rows.columns if c not in keys and c not in keep_last_known]
    known = [
        F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in keep_last_known
    ]
    merged = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_last"), *known)
    return merged.select(*keys, "_last.*", *keep_last_known).select(*rows.columns)


def upsert_state(
    old: DataFrame, new: DataFrame, keys: Sequence[str], at: str, keep_last_known: Sequence[str] = ()
) -> DataFrame:
    """Old and new rows merged; at equal times the new row wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_wins(both, keys, [at, "_new"], keep_last_known).drop("_new")


def write_delta(rows: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch, so a repeated batch replaces only itself and nothing else is rewritten."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_deltas(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All deltas with the number of the batch that wrote them."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(full).option("basePath", path).parquet(path)


def current_state(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], at: str,
    keep_last_known: Sequence[str] = (),
) -> DataFrame:
    return latest_wins(read_deltas(spark, path, schema), keys, [at, "batch"], keep_last_known).drop("batch")


def compact_state(
    spark: SparkSession, path: str, new_path: str, schema: T.StructType, keys: Sequence[str], at: str,
    keep_last_known: Sequence[str] = (),
) -> None:
    """Fold all deltas into one at a new path; the old ones stay until their readers are gone."""
    write_delta(current_state(spark, path, schema, keys, at, keep_last_known), new_path, 0)


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only: existing files are never touched."""
    rows.write.mode("append").parquet(path)

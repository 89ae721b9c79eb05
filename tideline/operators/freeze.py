"""Frozen keys: the exact rows of a candidate, numbered, chunked and digested."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions.fingerprint import row_fingerprint
from tideline.operators.closure import group_rows
from tideline.operators.selection import Tables
from tideline.plans.group import GroupPlan
from tideline.session import materialize, sorted_partitions

CHUNK_SIZE = 2_000
DIGEST_FAN_IN = 10_000

PART, POSITION = "_part", "_position"

# The low bits of a monotonically increasing id are the row's position inside its partition.
_POSITION_MASK = (1 << 33) - 1


def key_columns(
    plan: GroupPlan, rows: DataFrame, table: str, double_as: str | None = None
) -> list[Column]:
    """``pk`` in its own type for ordering, ``fp`` and the key of the parent row (NULL for the root)."""
    link = plan.links.get(table)
    parent = F.col(link.child_columns[0]).cast("string") if link else F.lit(None).cast("string")
    return [
        F.col(plan.primary_key(table)).alias("pk"),
        row_fingerprint(rows, double_as=double_as).alias("fp"),
        parent.alias("parent_key"),
    ]


def frozen_keys(
    plan: GroupPlan, tables: Tables, table: str, end_day: str, double_as: str | None = None
) -> DataFrame:
    """``(pk, fp, parent_key)`` of every row of one table that belongs to the candidate."""
    rows = group_rows(plan, tables, table, end_day)
    return rows.select(*key_columns(plan, rows, table, double_as))


def place_rows(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Sort all rows by range partitions, and note each row's partition and its position there.

    ``order`` must be unique, so a repeated task puts every row in the same place again.
    """
    partitions = partitions or sorted_partitions(df)
    position = F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK))
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return ranged.withColumns({PART: F.spark_partition_id(), POSITION: position})


def number_placed(placed: DataFrame, name: str) -> DataFrame:
    """Global row numbers, from 1, of placed rows that have been written out.

    The row counts of the partitions, one small row each, turn positions into numbers. Range bounds come
    from a sample, so the counts and the rows must come from the same written copy.
    """
    before = Window.partitionBy(F.lit(0)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(PART)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    # One row per partition, so its size is known.
    return (
        placed.join(F.broadcast(offsets), PART)
        .withColumn(name, F.col("_offset") + F.col(POSITION) + 1)
        .drop(PART, POSITION, "_offset")
    )


def global_row_number(df: DataFrame, order: Sequence[str], name: str, partitions: int | None = None) -> DataFrame:
    """Number all rows by a unique ``order``, from 1, without a single-task window."""
    return number_placed(materialize(place_rows(df, order, partitions), "placed"), name)


def chunk_of(rn: Column, chunk_size: int = CHUNK_SIZE) -> Column:
    return F.floor((rn - 1) / chunk_size).cast("long")


def number_chunks(keys: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Add ``rn`` in key order and the ``chunk_no`` it falls in."""
    numbered = global_row_number(keys, ["pk"], "rn")
    return numbered.withColumn("chunk_no", chunk_of(F.col("rn"), chunk_size))


def key_line(pk: str = "pk", fp: str = "fp", parent_key: str = "parent_key") -> Column:
    """One line of the key list: pk, fingerprint and parent key, tab separated."""
    return F.concat(
        F.col(pk).cast("string"), F.lit("\t"), F.col(fp), F.lit("\t"),
        F.coalesce(F.col(parent_key).cast("string"), F.lit("")), F.lit("\n"),
    )


def chunk_digests(numbered: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """SHA-256 per chunk over its lines in key order. A chunk never exceeds its fixed size."""
    lines = F.array_sort(F.collect_list(F.struct("rn", key_line().alias("line"))))
    text = F.array_join(F.transform(lines, lambda x: x["line"]), "")
    return numbered.groupBy(*by, "chunk_no").agg(
        F.count(F.lit(1)).alias("row_count"), F.sha2(text, 256).alias("digest")
    )


def candidate_digest(chunks: DataFrame, fan_in: int = DIGEST_FAN_IN) -> DataFrame:
    """One digest over ``(table_name, chunk_no, digest)`` in that order, in two levels at every size.

    The first level digests runs of ``fan_in`` chunks, each the SHA-256 of its comma-joined entries; the second
    digests the comma-joined results. With 2,000 keys to a chunk, 10^12 keys leave 50,000 entries to the second.
    """
    per_table = chunks.groupBy("table_name").agg(F.count(F.lit(1)).alias("_chunks"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("table_name").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_table.select(  # one row per table of the group
        "table_name", F.coalesce(F.sum("_chunks").over(earlier), F.lit(0)).alias("_start")
    )
    level = chunks.join(F.broadcast(starts), "table_name").select(
        (F.col("_start") + F.col("chunk_no")).alias("seq"),
        F.concat_ws(":", "table_name", F.col("chunk_no").cast("string"), "digest").alias("entry"),
    )
    entries = F.array_sort(F.collect_list(F.struct("seq", "entry")))
    joined = F.array_join(F.transform(entries, lambda x: x["entry"]), ",")
    runs = level.groupBy(F.floor(F.col("seq") / fan_in).cast("long").alias("seq")).agg(F.sha2(joined, 256).alias("entry"))
    return runs.agg(F.sha2(joined, 256).alias("candidate_digest"))


def candidate_integrity(stored_keys: DataFrame, stored_chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recompute every chunk's digest and size from the keys and compare with what was recorded."""
    again = chunk_digests(stored_keys, by).withColumnsRenamed({"digest": "_digest", "row_count": "_rows"})
    compared = stored_chunks.join(again, [*by, "chunk_no"], "full_outer")
    same = F.coalesce((F.col("digest") == F.col("_digest")) & (F.col("row_count") == F.col("_rows")), F.lit(False))
    return compared.groupBy(*by).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(~same).alias("broken_chunks"),
        F.bool_and(same).alias("intact"),
    )


def candidate_counts(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Frozen rows per table, and whether every chunk holds as many keys as it says."""
    return chunks.groupBy(*by, "table_name").agg(
        F.sum("row_count").alias("n"), F.bool_and(F.col("key_count") == F.col("row_count")).alias("intact")
    )


def number_batches(plan: GroupPlan, keys: Mapping[str, DataFrame], batch_size: int) -> dict[str, DataFrame]:
    """Give every frozen row a removal batch.

    Root rows are batched in key order; a child row goes with its parent's batch, level by level.
    """
    root = plan.spec.root
    numbered = global_row_number(keys[root], ["pk"], "rn")
    batches = {root: numbered.withColumn("batch_no", chunk_of(F.col("rn"), batch_size)).drop("rn")}
    for table in plan.export_order:
        if table == root:
            continue
        above = batches[plan.links[table].parent].select(F.col("pk").cast("string").alias("parent_key"), "batch_no")
        batches[table] = keys[table].join(above, "parent_key")
    return batches


def distinct_fingerprints(keys: DataFrame) -> DataFrame:
    return keys.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fp").alias("distinct_fp"))

"""A hash tree over chunk digests, with its inner nodes stored, and the descent that finds a damaged chunk.

Level 0 are the chunks of a table in order; a node of the next level is the SHA-256 of the comma-joined digests of ``FAN_IN`` nodes
below it, up to a single root. Two stored trees are compared from their roots down: only the children of nodes that differ are
read, so finding one damaged chunk among many reads a number of nodes that grows with the logarithm of the chunks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.freeze import key_line

FAN_IN = 64
#: Parents that differ are named in the scan's filter up to so many; more are joined.
NAMED = 500


def _level(path: str, table: str, level: int) -> str:
    return f"{path}/{table}/level={level}"


def store_tree(chunks: DataFrame, path: str, table: str, fan_in: int = FAN_IN) -> int:
    """Writes the tree over ``chunks(chunk_no, digest)`` of one table below ``path``; returns its number of levels.

    Chunks are numbered from 0 without gaps. Nodes are stored in order, so that a few are read by their numbers. No chunks
    leave a root over nothing.
    """
    spark = chunks.sparkSession
    nodes = chunks.select(F.col("chunk_no").cast("long").alias("node"), "digest")
    level = 0
    while True:
        place = _level(path, table, level)
        nodes.repartitionByRange("node").sortWithinPartitions("node").write.mode("overwrite").parquet(place)
        stored = spark.read.schema("node long, digest string").parquet(place)
        if stored.count() <= 1:
            return level + 1
        below = F.array_sort(F.collect_list(F.struct("node", "digest")))  # at most ``fan_in``
        joined = F.array_join(F.transform(below, lambda x: x["digest"]), ",")
        nodes = stored.groupBy(F.floor(F.col("node") / fan_in).cast("long").alias("node")).agg(F.sha2(joined, 256).alias("digest"))
        level += 1


def read_level(spark: SparkSession, path: str, table: str, level: int) -> DataFrame:
    return spark.read.schema("node long, digest string").parquet(_level(path, table, level))


def children_of(parents: list[int], fan_in: int = FAN_IN) -> Column:
    """Nodes below some parents: neighbours make one range, and ranges are joined in pairs, as a chain of hundreds is too deep for the planner."""
    runs: list[list[int]] = []
    for p in sorted(set(parents)):
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    parts = [F.col("node").between(low * fan_in, (high + 1) * fan_in - 1) for low, high in runs]
    while len(parts) > 1:
        parts = [reduce(Column.__or__, parts[at : at + 2]) for at in range(0, len(parts), 2)]
    return parts[0]


@dataclass(frozen=True)
class Damage:
    """Chunks that differ between two trees, and how many nodes were read to find them."""

    chunks: DataFrame
    nodes_read: int


def differing_chunks(spark: SparkSession, recorded: str, stored: str, table: str, levels: int, fan_in: int = FAN_IN) -> Damage:
    """``chunk_no`` of the chunks of a table whose digests differ between the trees below two paths, or are in one only.

    Both trees have ``levels`` levels; a tree with another number of chunks differs in its root and along its end.
    """
    read = 0
    parents = None
    for level in range(levels - 1, -1, -1):
        sides = [read_level(spark, path, table, level) for path in (recorded, stored)]
        if parents is not None:
            named = [r.node for r in parents.limit(NAMED + 1).collect()]
            if not named:
                return Damage(parents.select(F.col("node").alias("chunk_no")), read)
            if len(named) <= NAMED:
                children = children_of(named, fan_in)
                sides = [side.where(children) for side in sides]
            else:
                parent = F.floor(F.col("node") / fan_in).cast("long")
                wanted = parents.select(F.col("node").alias("_parent"))
                sides = [side.withColumn("_parent", parent).join(wanted, "_parent", "left_semi").drop("_parent") for side in sides]
        left, right = (side.select("node", F.col("digest").alias(name)) for side, name in zip(sides, ("_a", "_b")))
        both = left.join(right, "node", "full_outer")
        counted = both.agg(F.count("_a"), F.count("_b")).first()
        read += counted[0] + counted[1]
        parents = both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node")
    return Damage(parents.select(F.col("node").alias("chunk_no")), read)


def damaged_keys(recorded_keys: DataFrame, stored_keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunk_no, rn, pk, state`` of the keys in some chunks that were changed, lost or added; only those chunks are compared.

    A row is told by its place: keys are ``(chunk_no, rn, pk, fp, parent_key)``.
    """
    wanted = chunks.select("chunk_no").distinct()
    left, right = (k.join(wanted, "chunk_no", "left_semi").select("chunk_no", "rn", F.col("pk").alias(f"_pk{i}"), key_line().alias(f"_line{i}")) for i, k in enumerate((recorded_keys, stored_keys)))
    both = left.join(right, ["chunk_no", "rn"], "full_outer").where(~F.col("_line0").eqNullSafe(F.col("_line1")))
    state = F.when(F.col("_line1").isNull(), "lost").when(F.col("_line0").isNull(), "added").otherwise("changed")
    return both.select("chunk_no", "rn", F.coalesce("_pk0", "_pk1").alias("pk"), state.alias("state"))

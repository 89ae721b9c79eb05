"""Which rows belong to a group: membership through foreign keys, and the checks around it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.days import column_type, local_day
from tideline.operators.selection import Tables, root_day, root_predicate
from tideline.plans.group import FkEdge, GroupPlan


def edge_condition(child: DataFrame, parent: DataFrame, edge: FkEdge):
    """All columns of the key take part, also for a composite one."""
    pairs = zip(edge.child_columns, edge.parent_columns)
    return reduce(lambda a, b: a & b, (child[c] == parent[p] for c, p in pairs))


def group_rows(plan: GroupPlan, tables: Tables, table: str, end_day: str) -> DataFrame:
    """Rows of ``table`` whose root row is dated before ``end_day``.

    A chain of left semi joins that carries only the key of each ancestor.
    """
    rows = tables[table]
    if table == plan.spec.root:
        return rows.where(root_predicate(plan, rows, end_day))
    edge = plan.links[table]
    parents = group_rows(plan, tables, edge.parent, end_day).select(*edge.parent_columns)
    return rows.join(parents, edge_condition(rows, parents, edge), "left_semi")


def chain_daily_counts(plan: GroupPlan, tables: Tables, table: str, end_day: str) -> DataFrame:
    """``(day, n)`` of one table by the day of its root row, joined down the foreign keys."""
    root = tables[plan.spec.root]
    path = [table]
    while path[-1] != plan.spec.root:
        path.append(plan.links[path[-1]].parent)
    dated = root.where(root_predicate(plan, root, end_day)).withColumn("_day", root_day(plan, root))
    for child in reversed(path[:-1]):
        edge = plan.links[child]
        key, fk = edge.parent_columns[0], edge.child_columns[0]
        if child == table:
            counts = tables[child].groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias("_n"))
            joined = dated.select("_day", F.col(key).alias("_key")).join(counts, F.col("_key") == F.col("_fk"))
            return joined.groupBy(F.col("_day").alias("day")).agg(F.sum("_n").alias("n"))
        above = dated.select("_day", F.col(key).alias("_key"))
        dated = tables[child].join(above, F.col(fk) == F.col("_key")).drop("_key")
    return dated.groupBy(F.col("_day").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def split_groups(
    parent: DataFrame, parent_key: str, parent_date: str, child: DataFrame, child_key: str, child_date: str,
    time_zone: str, last_day: str,
) -> DataFrame:
    """Parents up to ``last_day`` with a child on another day, and how many children differ.

    Children are reduced to one row per key and day first, which also takes the weight off hot keys.
    """
    child_day = local_day(F.col(child_date), column_type(child, child_date), time_zone)
    parent_day = local_day(F.col(parent_date), column_type(parent, parent_date), time_zone)
    child_days = child.groupBy(F.col(child_key).alias("_fk"), child_day.alias("_child_day")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    dated = parent.select(F.col(parent_key).alias("_key"), parent_day.alias("_day"))
    dated = dated.where(F.col("_day") <= F.lit(last_day).cast("date"))
    return (
        dated.join(child_days, (F.col("_key") == F.col("_fk")) & (F.col("_day") != F.col("_child_day")))
        .groupBy(F.col("_key").alias("parent_key"))
        .agg(F.sum("_n").alias("children_on_other_days"))
    )


def mark_referenced(parent: DataFrame, child: DataFrame, edge: FkEdge, name: str = "held") -> DataFrame:
    """Parent rows with a flag: does some child still point at them? The child side shrinks to its distinct keys first."""
    keys = child.select(*edge.child_columns).distinct()
    marked = parent.join(keys, edge_condition(keys, parent, edge), "left")
    return marked.select(*(parent[c] for c in parent.columns), keys[edge.child_columns[0]].isNotNull().alias(name))


def orphan_counts(child: DataFrame, parent: DataFrame, edge: FkEdge) -> DataFrame:
    """Children whose foreign key is set but names no parent, per missing key.

    They are counted before the join, so a hot key costs one row per task.
    """
    counts = child.dropna(subset=list(edge.child_columns)).groupBy(*edge.child_columns).agg(
        F.count(F.lit(1)).alias("n")
    )
    keys = parent.select(*edge.parent_columns)
    return counts.join(keys, edge_condition(counts, keys, edge), "left_anti")

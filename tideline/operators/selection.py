"""Day totals of a table group and the whole-day selection over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions.days import before_day, column_type, local_day
from tideline.plans.group import GroupPlan

Tables = Mapping[str, DataFrame]


def root_predicate(plan: GroupPlan, root: DataFrame, end_day: str) -> Column:
    """Root rows dated before ``end_day``; undated rows never match."""
    spec = plan.spec
    return before_day(
        F.col(spec.date_column), column_type(root, spec.date_column), end_day, spec.time_zone, spec.ntz_is_utc
    )


def root_day(plan: GroupPlan, root: DataFrame) -> Column:
    spec = plan.spec
    return local_day(F.col(spec.date_column), column_type(root, spec.date_column), spec.time_zone, spec.ntz_is_utc)


def _subtree_counts(plan: GroupPlan, tables: Tables, table: str) -> DataFrame:
    """Rows of ``table`` and of everything below it, per value of its foreign key towards the root.

    The partial aggregate runs before the shuffle, so a key that owns a large share of the rows arrives
    as one row per map task.
    """
    fk = plan.links[table].child_columns[0]
    rows, below = _with_counts_below(plan, tables, table, tables[table])
    return rows.groupBy(F.col(fk).alias("_parent_key")).agg(
        F.count(F.lit(1)).alias(table), *(F.sum(c).alias(c) for c in below)
    )


def _with_counts_below(
    plan: GroupPlan, tables: Tables, table: str, rows: DataFrame
) -> tuple[DataFrame, list[str]]:
    """Attach the row counts of every descendant table to the rows they hang off."""
    below: list[str] = []
    for edge in plan.children(table):
        counts = _subtree_counts(plan, tables, edge.child)
        names = [c for c in counts.columns if c != "_parent_key"]
        rows = rows.join(counts, rows[edge.parent_columns[0]] == counts["_parent_key"], "left").drop("_parent_key")
        below += names
    return rows, below


def daily_totals(plan: GroupPlan, tables: Tables, end_day: str | None = None) -> DataFrame:
    """``(day, table_name, n)``: rows per local day of their root row, for days before ``end_day``.

    Counts travel up the foreign keys: each table is scanned once and pre-aggregated by the key it is
    joined on, and the root is scanned once for its own count and all the others.
    """
    spec = plan.spec
    root = tables[spec.root]
    dated = root.where(root_predicate(plan, root, end_day or spec.cutoff_day)).withColumn("_day", root_day(plan, root))
    dated, below = _with_counts_below(plan, tables, spec.root, dated)
    wide = dated.groupBy(F.col("_day").alias("day")).agg(
        F.count(F.lit(1)).alias(spec.root), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in below)
    )
    long = wide.unpivot(["day"], [spec.root, *below], "table_name", "n")
    return long.where("n > 0")


def union_daily(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Merge ``(day, n)`` counts of several tables into ``(day, table_name, n)``."""
    frames = [df.select("day", F.lit(name).alias("table_name"), "n") for name, df in parts.items()]
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def table_daily(
    df: DataFrame, date_column: str, time_zone: str, end_day: str, ntz_is_utc: bool = False
) -> DataFrame:
    """``(day, n)`` of one table by its own date column."""
    kind = column_type(df, date_column)
    column = F.col(date_column)
    return (
        df.where(before_day(column, kind, end_day, time_zone, ntz_is_utc))
        .groupBy(local_day(column, kind, time_zone, ntz_is_utc).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def day_totals(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return days.groupBy(*by, "day").agg(F.sum("n").alias("n"))


def counts_by_table(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One map of table to count per day; a day has at most one entry per table."""
    pairs = F.array_sort(F.collect_list(F.struct("table_name", "n")))
    return days.groupBy(*by, "day").agg(F.map_from_entries(pairs).alias("counts_by_table"))


def mark_days(days: DataFrame, target: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """Per day: its total, the running total before and after it, and whether it is selected.

    A day is taken whole while the total before it is below the target. The window runs over day totals,
    at most one row per calendar day and group.
    """
    target = F.lit(target) if isinstance(target, int) else target
    ordered = Window.partitionBy(*(by or [F.lit(0)])).orderBy("day")
    return (
        day_totals(days, by)
        .withColumn("cumulative", F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.col("cumulative") - F.col("n"))
        .withColumn("selected", F.col("before") < target)
    )


def whole_day_selection(days: DataFrame, target: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: the oldest whole days whose running total first reaches the target."""
    target = F.lit(target) if isinstance(target, int) else target
    chosen = F.col("selected")
    summary = mark_days(days, target, by).groupBy(*by).agg(
        F.min(F.when(chosen, F.col("day"))).alias("oldest_day"),
        F.max(F.when(chosen, F.col("day"))).alias("boundary_day"),
        F.coalesce(F.sum(F.when(chosen, F.col("n"))), F.lit(0)).alias("total_selected"),
        F.coalesce(F.max_by(F.when(chosen, F.col("before")), F.when(chosen, F.col("day"))), F.lit(0)).alias(
            "total_before_final_day"
        ),
        F.coalesce(F.max_by(F.when(chosen, F.col("n")), F.when(chosen, F.col("day"))), F.lit(0)).alias(
            "final_day_count"
        ),
        F.count_if(chosen).alias("selected_days"),
        F.count_if(~chosen).alias("excluded_days"),
        F.min("day").alias("oldest_eligible_day"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("eligible_total"),
    )
    return summary.withColumn("reached_target", F.col("total_selected") >= target)


def selected_days(days: DataFrame, target: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """The ``(day, table_name, n)`` rows of the selected days, in one pass: a day's rows share their running total."""
    target = F.lit(target) if isinstance(target, int) else target
    keys = list(by) or [F.lit(0)]
    up_to_day = Window.partitionBy(*keys).orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("n").over(up_to_day) - F.sum("n").over(Window.partitionBy(*keys, "day"))
    return days.withColumn("_before", before).where(F.col("_before") < target).drop("_before")


def selection_totals(days: DataFrame, target: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows per table over the selected days."""
    return selected_days(days, target, by).groupBy(*by, "table_name").agg(F.sum("n").alias("n"))


def select_candidate(days: DataFrame, target: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """The selection, with a boundary only when the target is reached."""
    reached = F.col("reached_target")
    return (
        whole_day_selection(days, target, by)
        .withColumn("boundary_day", F.when(reached, F.col("boundary_day")))
        .withColumn("end_day", F.when(reached, F.date_add("boundary_day", 1)))
    )


def running_totals(days: DataFrame, target: int | Column, by: Sequence[str] = ()) -> DataFrame:
    return mark_days(days, target, by).where("selected").select(*by, "day", "n", "cumulative")


def final_day_equation(selection: DataFrame, target: int | Column) -> DataFrame:
    """total before the final day + final day = archive, with the distances to the target."""
    target = F.lit(target) if isinstance(target, int) else target
    return selection.withColumn("shortfall", target - F.col("total_before_final_day")).withColumn(
        "overshoot", F.col("total_selected") - target
    )


def timeline_slice(
    days: DataFrame, target: int | Column, tail_days: int = 3, after_days: int = 2, by: Sequence[str] = ()
) -> DataFrame:
    """The days around the boundary: the final day, the few before it, the next ones after it.

    Older selected days fold into one row with their number and sum. Days after the boundary are shown
    only when the target is reached.
    """
    target = F.lit(target) if isinstance(target, int) else target
    keys = list(by) or [F.lit(0)]
    marked = mark_days(days, target, by)
    side = Window.partitionBy(*keys, "selected")
    ranked = (
        marked.withColumn("_back", F.row_number().over(side.orderBy(F.desc("day"))))
        .withColumn("_ahead", F.row_number().over(side.orderBy("day")))
        .withColumn("_total", F.sum(F.when(F.col("selected"), F.col("n"))).over(Window.partitionBy(*keys)))
    )
    part = (
        F.when(F.col("selected") & (F.col("_back") == 1), "final")
        .when(F.col("selected") & (F.col("_back") <= tail_days + 1), "before")
        .when(F.col("selected"), "older")
        .when((F.col("_ahead") <= after_days) & (F.col("_total") >= target), "after")
    )
    shown = ranked.withColumn("part", part).where("part IS NOT NULL")
    folded = F.when(F.col("part") != "older", F.col("day"))
    return shown.groupBy(*by, "part", folded.alias("day")).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("n").alias("n"),
        F.max(F.when(F.col("part") != "after", F.col("cumulative"))).alias("cumulative"),
    )


def subset_reselection(
    days: DataFrame, tables: Sequence[str], target: int | Column, by: Sequence[str] = ()
) -> DataFrame:
    """The selection recomputed as if only some tables were in the group; days that empty out still count as days."""
    kept = days.withColumn("n", F.when(F.col("table_name").isin(*tables), F.col("n")).otherwise(F.lit(0)))
    return whole_day_selection(kept, target, by)


def preview_tail(days: DataFrame, boundary: Column, days_after: int = 14) -> DataFrame:
    """Days up to the boundary and a fixed number of calendar days after it; all days without a boundary."""
    return days.where(boundary.isNull() | (F.col("day") <= F.date_add(boundary, days_after)))


def zone_day_shift(df: DataFrame, column: str, day: str, time_zone: str, ntz_is_utc: bool = True) -> DataFrame:
    """Rows on one calendar day in the business zone against the same day in UTC."""
    kind = column_type(df, column)
    value, wanted = F.col(column), F.lit(day).cast("date")
    return df.agg(
        F.count_if(local_day(value, kind, time_zone, ntz_is_utc) == wanted).alias("rows_local"),
        F.count_if(local_day(value, kind, "UTC", ntz_is_utc) == wanted).alias("rows_utc"),
    )

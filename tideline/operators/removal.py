"""Exact removal: only frozen, unchanged and unreferenced rows go, and every frozen row is accounted for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.days import before_day, column_type
from tideline.functions.fingerprint import row_fingerprint
from tideline.operators.closure import edge_condition
from tideline.operators.keyfilter import KeyFilter, key_filter
from tideline.operators.selection import Tables
from tideline.plans.group import FkEdge, GroupPlan, require_plannable
from tideline.session import in_parallel, materialize


def live_keys(df: DataFrame, primary_key: str, double_as: str | None = None) -> DataFrame:
    """``(pk, fp)`` of a live table: hashed before any shuffle, so whole rows stay where they are."""
    return df.select(F.col(primary_key).alias("pk"), row_fingerprint(df, double_as=double_as).alias("fp"))


def exact_matches(frozen: DataFrame, live: DataFrame) -> DataFrame:
    """Frozen keys whose row is still there, unchanged."""
    return frozen.join(live.select("pk", "fp"), ["pk", "fp"], "left_semi")


def row_outcomes(frozen: DataFrame, live: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """One outcome per frozen key: missing, drifted, held or deleted, tested in that order.

    ``held`` lists, once each, the keys that some surviving child still references.
    """
    current = live.select("pk", F.col("fp").alias("_live_fp"))
    rows = frozen.join(current, "pk", "left")
    is_held = F.lit(False)
    if held is not None:
        rows = rows.join(held.select("pk").withColumn("_held", F.lit(True)), "pk", "left")
        is_held = F.coalesce(F.col("_held"), F.lit(False))
    outcome = (
        F.when(F.col("_live_fp").isNull(), "missing")
        .when(F.col("_live_fp") != F.col("fp"), "drifted")
        .when(is_held, "held")
        .otherwise("deleted")
    )
    return rows.withColumn("outcome", outcome).drop("_live_fp", "_held")


def survivors(live_rows: DataFrame, primary_key: str, outcomes: DataFrame, count: int | None = None) -> DataFrame:
    """The live table without its deleted rows. Written to a new path by the caller; inputs are never overwritten.

    Rows that a filter over the deleted keys rules out pass straight through; only the few others are shuffled and
    joined. ``count`` is the number of outcomes, where it is known.
    """
    gone = outcomes.where("outcome = 'deleted'").select(F.col("pk").alias(primary_key))
    kind = live_rows.schema[primary_key].dataType
    tested = key_filter(gone, primary_key, outcomes.count() if count is None else count, kind)
    doubtful = tested.may_hold(live_rows, primary_key)
    # An outer join, since the optimizer would move an anti join below the filter and shuffle the whole table.
    kept = doubtful.join(gone.withColumn("_gone", F.lit(True)), primary_key, "left").where("_gone IS NULL")
    kept = kept.select(*(F.col(f"`{c}`") for c in live_rows.columns))
    return tested.cannot_hold(live_rows, primary_key).unionByName(kept)


def referenced_keys(
    parent_rows: DataFrame, primary_key: str, edges: Sequence[tuple[FkEdge, DataFrame]], asked: KeyFilter | None = None
) -> DataFrame:
    """Primary keys of parent rows that a remaining child row references, over every incoming foreign key.

    A foreign key to the primary key names those keys itself; only other keys are looked up in the parent. With a
    filter over the keys that are asked for, children of other parents never leave their scan.
    """
    parts = []
    for edge, children in edges:
        if asked and edge.parent_columns == (primary_key,):
            children = asked.may_hold(children.select(*edge.child_columns), edge.child_columns[0])
        keys = children.select(*edge.child_columns).distinct()
        if edge.parent_columns == (primary_key,):
            parts.append(keys.select(F.col(edge.child_columns[0]).alias("pk")))
            continue
        parents = parent_rows.select(*dict.fromkeys([primary_key, *edge.parent_columns]))
        hit = parents.join(keys, edge_condition(keys, parents, edge), "left_semi")
        parts.append(hit.select(F.col(primary_key).alias("pk")))
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).distinct()


def exact_removal(
    plan: GroupPlan,
    frozen: Mapping[str, DataFrame],
    live: Tables,
    double_as: str | None = None,
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Outcomes per frozen row and survivors per table, children first.

    A parent is held while any surviving child row points at it: one that drifted, was itself held, or
    arrived after the freeze. Tables outside the group count too when a foreign key names them.

    A blocked plan is refused, and so is a missing table: without the rows of every table that points at the
    group, no guard can tell which parents are still in use. Each table's outcomes are written once, since its
    survivors, its parent's guard and the reconciliation all read them. A filter over the frozen keys (``keyfilter``)
    is tested where live tables are scanned, so only rows that may be frozen are hashed and shuffled.
    """
    require_plannable(plan)
    wanted = {e.child for t in plan.removal_order for e in plan.incoming(t)} | set(plan.removal_order)
    if missing := sorted(wanted - set(live)):
        raise ValueError(f"removal needs the rows of {', '.join(missing)}")
    spark = next(iter(frozen.values())).sparkSession
    counts = dict(zip(frozen, in_parallel(spark, lambda df: df.count(), frozen.values())))
    outcomes: dict[str, DataFrame] = {}
    remaining: dict[str, DataFrame] = dict(live)
    for table in plan.removal_order:
        pk = plan.primary_key(table)
        rows = live[table]
        asked = key_filter(frozen[table], "pk", counts[table], rows.schema[pk].dataType)
        guards = [(e, remaining[e.child]) for e in plan.incoming(table)]
        held = referenced_keys(rows, pk, guards, asked) if guards else None
        decided = row_outcomes(frozen[table], live_keys(asked.may_hold(rows, pk), pk, double_as), held)
        outcomes[table] = materialize(decided, "outcomes")
        remaining[table] = survivors(rows, pk, outcomes[table], counts[table])
    return outcomes, {t: remaining[t] for t in plan.spec.tables}


def outcome_counts(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    def n(kind: str) -> Column:
        return F.count_if(F.col("outcome") == kind).alias(kind)

    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requested"), n("deleted"), n("drifted"), n("held"), n("missing")
    )


def still_present(frozen: DataFrame, remaining: DataFrame, primary_key: str) -> DataFrame:
    """Frozen keys that are still in the table."""
    return frozen.join(remaining.select(F.col(primary_key).alias("pk")), "pk", "left_semi")


def late_rows(
    live_rows: DataFrame, primary_key: str, date_column: str, end_day: str, frozen: DataFrame, time_zone: str,
    ntz_is_utc: bool = False,
) -> DataFrame:
    """Live rows dated inside or before the archived range that were never frozen. They are reported and kept."""
    kind = column_type(live_rows, date_column)
    in_range = live_rows.where(before_day(F.col(date_column), kind, end_day, time_zone, ntz_is_utc))
    return in_range.join(frozen.select(F.col("pk").alias(primary_key)), primary_key, "left_anti")


def range_delete_risk(
    live_rows: DataFrame, primary_key: str, date_column: str, end_day: str, frozen: DataFrame, time_zone: str,
    double_as: str | None = None, ntz_is_utc: bool = False,
) -> DataFrame:
    """Rows a delete by date range would destroy although no archive holds them as they are now."""
    kind = column_type(live_rows, date_column)
    in_range = live_rows.where(before_day(F.col(date_column), kind, end_day, time_zone, ntz_is_utc))
    keyed = live_keys(in_range, primary_key, double_as)
    known = frozen.select("pk", F.col("fp").alias("_frozen_fp"))
    unsafe = keyed.join(known, "pk", "left").where(F.col("_frozen_fp").isNull() | (F.col("_frozen_fp") != F.col("fp")))
    return unsafe.select(
        "pk", F.when(F.col("_frozen_fp").isNull(), "not_archived").otherwise("archived_copy_stale").alias("risk")
    )


def stragglers(
    live_rows: DataFrame, primary_key: str, date_column: str, boundary_day: str, frozen: DataFrame, time_zone: str,
    ntz_is_utc: bool = False,
) -> DataFrame:
    """Eligible rows dated up to a previous boundary that its archive missed."""
    end_day = F.date_add(F.lit(boundary_day).cast("date"), 1)
    kind = column_type(live_rows, date_column)
    eligible = live_rows.where(before_day(F.col(date_column), kind, end_day, time_zone, ntz_is_utc))
    return eligible.join(frozen.select(F.col("pk").alias(primary_key)), primary_key, "left_anti")


def reconcile_tables(
    outcomes: DataFrame, frozen_counts: DataFrame, present_counts: DataFrame, by: Sequence[str] = ("table_name",)
) -> DataFrame:
    """Per table: every frozen row was requested, each has one outcome, and only skipped rows remain.

    ``outcomes`` holds counts per batch: requested, deleted, drifted, held, missing and the batch's attempts.
    """
    keys = list(by)
    rolled = outcomes.groupBy(*keys).agg(
        F.sum("requested").alias("requested"),
        F.sum("deleted").alias("deleted"),
        F.sum(F.col("drifted") + F.col("held")).alias("skipped"),
        F.sum("missing").alias("missing"),
        F.sum(F.when(F.col("attempts") > 1, F.col("missing")).otherwise(0)).alias("missing_on_retry"),
    )
    numbers = ["requested", "deleted", "skipped", "missing", "missing_on_retry", "still_present"]
    joined = frozen_counts.join(rolled, keys, "left").join(present_counts, keys, "left").na.fill(0, numbers)
    accounted = F.col("deleted") + F.col("skipped") + F.col("missing")
    return joined.withColumn(
        "reconciled",
        (F.col("requested") == F.col("frozen"))
        & (accounted == F.col("frozen"))
        & (F.col("still_present") == F.col("skipped")),
    )


def job_final_status(reconciled: DataFrame, batches: DataFrame, by: Sequence[str] = ("job_id",)) -> DataFrame:
    """completed, completed_with_exceptions (some rows skipped) or requires_review, per job."""
    keys = list(by)
    tables = reconciled.groupBy(*keys).agg(
        F.bool_and("reconciled").alias("_ok"), F.bool_or(F.col("skipped") > 0).alias("_exceptions")
    )
    done = batches.groupBy(*keys).agg(F.bool_and(F.col("state") == "done").alias("_done"))
    ok = F.col("_ok") & F.coalesce(F.col("_done"), F.lit(True))
    status = (
        F.when(~ok, "requires_review").when(F.col("_exceptions"), "completed_with_exceptions").otherwise("completed")
    )
    return tables.join(done, keys, "left").select(*keys, status.alias("final_status"))

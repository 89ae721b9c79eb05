"""Whole days: worked examples, groups, children by their root's day."""

import datetime as dt
import random

import pytest

from tideline.operators.closure import chain_daily_counts, group_rows
from tideline.operators.preview import candidate_status, preview_exclusions
from tideline.operators.selection import (
    daily_totals,
    mark_days,
    running_totals,
    select_candidate,
    selection_totals,
    subset_reselection,
    timeline_slice,
    whole_day_selection,
)
from tideline.plans.group import FkEdge, GroupSpec, PlanBlocked, plan_group, require_plannable

SCHEMA = "day date, table_name string, n long"


def day(i):
    return dt.date(2025, 7, 1) + dt.timedelta(days=i)


def frame(spark, counts, table="t"):
    return spark.createDataFrame([(day(i), table, n) for i, n in enumerate(counts)], SCHEMA)


@pytest.mark.parametrize(
    "counts, target, total, boundary, reached, before, final",
    [
        ([124_999, 210, 5], 125_000, 125_209, 1, True, 124_999, 210),
        ([124_999, 250], 125_000, 125_249, 1, True, 124_999, 250),
        ([60_000, 65_000, 10], 125_000, 125_000, 1, True, 60_000, 65_000),
        ([50_000, 40_000], 125_000, 90_000, 1, False, 50_000, 40_000),
        ([300_000, 10], 125_000, 300_000, 0, True, 0, 300_000),
        ([0, 100_000, 0, 30_000], 125_000, 130_000, 3, True, 100_000, 30_000),
    ],
)
def test_worked_examples(spark, counts, target, total, boundary, reached, before, final):
    row = whole_day_selection(frame(spark, counts), target).first()
    assert row["total_selected"] == total
    assert row["boundary_day"] == day(boundary)
    assert row["reached_target"] is reached
    assert (row["total_before_final_day"], row["final_day_count"]) == (before, final)
    assert row["excluded_days"] == len(counts) - row["selected_days"]


def test_boundary_only_when_reached(spark):
    row = select_candidate(frame(spark, [5, 5]), 100).first()
    assert row["boundary_day"] is None and row["end_day"] is None and row["total_selected"] == 10


def test_no_days_at_all(spark):
    row = candidate_status(select_candidate(frame(spark, []), 10)).first()
    assert row["status"] == "no_eligible_rows" and row["total_selected"] == 0


def test_groups_are_selected_independently(spark):
    rows = [("a", day(0), "t", 5), ("a", day(1), "t", 6), ("a", day(2), "t", 1), ("b", day(0), "t", 20)]
    days = spark.createDataFrame(rows, f"root string, {SCHEMA}")
    got = {r["root"]: (r["boundary_day"], r["total_selected"]) for r in
           whole_day_selection(days, 10, ["root"]).collect()}
    assert got == {"a": (day(1), 11), "b": (day(0), 20)}


def test_totals_by_table_and_running(spark):
    days = frame(spark, [60, 40, 30], "a").unionByName(frame(spark, [10, 20, 5], "b"))
    assert {r[0]: r[1] for r in selection_totals(days, 100).collect()} == {"a": 100, "b": 30}
    assert [r["cumulative"] for r in running_totals(days, 100).orderBy("day").collect()] == [70, 130]
    assert subset_reselection(days, ["b"], 25).first()["total_selected"] == 30


def test_timeline(spark):
    rows = timeline_slice(frame(spark, [10] * 10), 65).collect()
    parts = {p: sorted(str(r["day"]) for r in rows if r["part"] == p) for p in ("older", "before", "final", "after")}
    assert parts["final"] == [str(day(6))] and parts["before"] == [str(day(i)) for i in (3, 4, 5)]
    assert parts["after"] == [str(day(7)), str(day(8))]
    older = next(r for r in rows if r["part"] == "older")
    assert (older["days"], older["n"], older["cumulative"]) == (3, 30, 30)


def test_a_day_is_never_split(spark):
    random.seed(7)
    for _ in range(3):
        counts = [random.randint(0, 50) for _ in range(40)]
        target = random.randint(1, sum(counts))
        running, expected = 0, 0
        for n in counts:  # the rule, day by day
            if running >= target:
                break
            running += n
            expected += 1
        marked = mark_days(frame(spark, counts), target).where("selected")
        assert marked.count() == expected
        assert whole_day_selection(frame(spark, counts), target).first()["total_selected"] == running


EDGES = (
    FkEdge("item_order", "items", ("order_id",), "orders", ("id",)),
    FkEdge("note_item", "notes", ("item_id",), "items", ("id",)),
)


def shop(spark):
    """Three levels; order 1 owns most items, order 9 is undated, item 90 has no order."""
    orders = spark.sql(
        "SELECT id, CASE WHEN id = 9 THEN NULL ELSE date_add(DATE '2025-01-01', CAST(id AS INT)) END AS placed FROM range(10)"
    )
    items = spark.sql("SELECT id, CASE WHEN id = 90 THEN 500 WHEN id < 60 THEN 1 ELSE id % 10 END AS order_id FROM range(100)")
    notes = spark.sql("SELECT id, id % 100 AS item_id FROM range(300)")
    tables = {"orders": orders, "items": items, "notes": notes}
    spec = GroupSpec("shop", "orders", "placed", tuple(tables), {t: ("id",) for t in tables}, "UTC", "2025-01-08", 50)
    return plan_group(spec, {t: df.schema for t, df in tables.items()}, EDGES), tables


def test_children_count_on_their_roots_day(spark):
    plan, tables = shop(spark)
    assert plan.blocking == () and plan.removal_order == ("notes", "items", "orders")
    got = {(r["table_name"], str(r["day"])): r["n"] for r in daily_totals(plan, tables).collect()}
    for table in ("items", "notes"):
        chained = {(table, str(r["day"])): r["n"] for r in chain_daily_counts(plan, tables, table, "2025-01-08").collect()}
        assert chained == {k: v for k, v in got.items() if k[0] == table}
        assert sum(chained.values()) == group_rows(plan, tables, table, "2025-01-08").count()
    assert got[("items", "2025-01-02")] == 60 + 4 and got[("notes", "2025-01-02")] == 3 * 64
    assert not any(k[1] == "None" for k in got)


def test_exclusions(spark):
    plan, tables = shop(spark)
    got = {r["reason"]: r["n"] for r in preview_exclusions(plan, tables).collect()}
    total = sum(r["n"] for r in daily_totals(plan, tables).collect())
    chosen = select_candidate(daily_totals(plan, tables), 50).first()["total_selected"]
    assert got == {"null_date": 1, "protected_period": 2, "after_boundary": total - chosen}


def test_plan_is_blocked(spark):
    plan, tables = shop(spark)
    spec = plan.spec
    keyless = GroupSpec("shop", "orders", "id", spec.tables, {"orders": ("id",), "items": ()}, "UTC", "2025-01-08", 5)
    blocked = plan_group(keyless, {t: df.schema for t, df in tables.items()}, EDGES[:1])
    assert set(blocked.blocking) == {
        "no_single_column_primary_key: items", "no_single_column_primary_key: notes",
        "date_column_not_temporal: id is bigint", "not_reachable_from_root: notes",
    }
    with pytest.raises(PlanBlocked):
        require_plannable(blocked)


def test_selection_border(spark):
    _, tables = shop(spark)
    schemas = {t: df.schema for t, df in tables.items()}
    keys = {t: ("id",) for t in tables}
    edges = (FkEdge("a", "items", ("order_id",), "orders", ("id",), "CASCADE"),)
    alone = plan_group(GroupSpec("s", "orders", "placed", ("orders",), keys, "UTC", "2025-01-08", 5), schemas, edges)
    assert alone.blocking == ("unselected_child_cascade: a (items → orders, ON DELETE CASCADE)",)
    child = plan_group(GroupSpec("s", "items", "id", ("items",), keys, "UTC", "2025-01-08", 5), schemas, edges)
    assert child.warnings == ("child_without_parent: a (items → orders, ON DELETE CASCADE)",)

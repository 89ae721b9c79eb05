"""The table groups the queries work on."""

from __future__ import annotations

from tideline.operators.selection import daily_totals, select_candidate
from tideline.plans.group import FkEdge, GroupPlan, GroupSpec, plan_group
from tideline.queries.registry import Inputs, check_table

CUTOFF = "2001-02-08"
ZONE = "Asia/Kolkata"
# Doubles of the driver's tables hold cents; as decimals both engines write the same text.
CENTS = "decimal(18,2)"

TABLE_EDGES = (
    FkEdge("lineitem_order", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",), "NO ACTION"),
    FkEdge("order_customer", "orders", ("o_custkey",), "customer", ("c_custkey",), "RESTRICT"),
    FkEdge("customer_nation", "customer", ("c_nationkey",), "nation", ("n_nationkey",), "NO ACTION"),
    FkEdge("nation_region", "nation", ("n_regionkey",), "region", ("r_regionkey",), "NO ACTION"),
    FkEdge("supplier_nation", "supplier", ("s_nationkey",), "nation", ("n_nationkey",), "NO ACTION"),
    FkEdge("lineitem_part", "lineitem", ("l_partkey",), "part", ("p_partkey",), "CASCADE"),
    FkEdge("lineitem_supplier", "lineitem", ("l_suppkey",), "supplier", ("s_suppkey",), "SET NULL"),
)
LINE_EDGE = FkEdge("line_order", "order_lines", ("order_id",), "orders", ("o_orderkey",), "NO ACTION")


def target(inputs: Inputs) -> int:
    """A third of the line items, so the selection grows with the data."""
    return inputs.lineitem.count() // 3


def order_group(inputs: Inputs, root: str = "orders") -> tuple[GroupPlan, dict]:
    """Orders with their line items: counted by order day."""
    tables = {"orders": getattr(inputs, root), "lineitem": inputs.lineitem}
    spec = GroupSpec(
        "shop", "orders", "o_orderdate", ("orders", "lineitem"), {"orders": ("o_orderkey",), "lineitem": ()}, ZONE,
        CUTOFF, target(inputs),
    )
    return plan_group(spec, {t: df.schema for t, df in tables.items()}, TABLE_EDGES[:1]), tables


def keyed_group(inputs: Inputs) -> tuple[GroupPlan, dict]:
    """Orders with their keyed lines: the group whose rows are frozen, archived and removed."""
    tables = {"orders": inputs.orders, "order_lines": inputs.order_lines}
    spec = GroupSpec(
        "shop", "orders", "o_orderdate", ("orders", "order_lines"),
        {"orders": ("o_orderkey",), "order_lines": ("line_id",)}, ZONE, CUTOFF, target(inputs),
    )
    return plan_group(spec, {t: df.schema for t, df in tables.items()}, (LINE_EDGE,)), tables


def live_group(inputs: Inputs) -> dict:
    return {"orders": inputs.live_orders, "order_lines": inputs.live_lines}


def group_days(inputs: Inputs):
    plan, tables = order_group(inputs)
    return daily_totals(plan, tables), plan.spec.target


def keyed_end_day(plan: GroupPlan, tables: dict) -> str:
    """The day after the boundary: one small row to the driver, so scans can be pruned by it."""
    return str(select_candidate(daily_totals(plan, tables), plan.spec.target).first()["end_day"])


check_table("goal", "SELECT count(*) // 3 AS target FROM {lineitem}")
check_table(
    "group_days",
    f"""
SELECT CAST(o_orderdate AS DATE) AS day, 'orders' AS table_name, count(*) AS n
FROM {{orders}} WHERE o_orderdate < DATE '{CUTOFF}' GROUP BY 1
UNION ALL
SELECT CAST(o_orderdate AS DATE), 'lineitem', count(*)
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE o_orderdate < DATE '{CUTOFF}' GROUP BY 1
""",
)
check_table(
    "keyed_days",
    f"""
SELECT CAST(o_orderdate AS DATE) AS day, 'orders' AS table_name, count(*) AS n
FROM {{orders}} WHERE o_orderdate < DATE '{CUTOFF}' GROUP BY 1
UNION ALL
SELECT CAST(o_orderdate AS DATE), 'order_lines', count(*)
FROM {{order_lines}} JOIN {{orders}} ON order_id = o_orderkey WHERE o_orderdate < DATE '{CUTOFF}' GROUP BY 1
""",
)
for days, marked, picked in (("group_days", "marked", "picked"), ("keyed_days", "keyed_marked", "keyed_picked")):
    check_table(
        marked,
        f"""
SELECT day, n, cumulative, cumulative - n AS before, cumulative - n < target AS selected, target
FROM (SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS cumulative
      FROM (SELECT day, CAST(sum(n) AS BIGINT) AS n FROM {{{days}}} GROUP BY day)), {{goal}}
""",
    )
    check_table(
        picked,
        f"""
SELECT min(day) FILTER (selected) AS oldest_day, max(day) FILTER (selected) AS boundary_day,
       CAST(sum(n) FILTER (selected) AS BIGINT) AS total_selected,
       max(before) FILTER (selected) AS total_before_final_day,
       arg_max(n, day) FILTER (selected) AS final_day_count,
       count(*) FILTER (selected) AS selected_days, count(*) FILTER (NOT selected) AS excluded_days,
       min(day) AS oldest_eligible_day, CAST(sum(n) AS BIGINT) AS eligible_total,
       sum(n) FILTER (selected) >= max(target) AS reached_target, max(target) AS target
FROM {{{marked}}}
""",
    )

_ORDER_PARTS = (
    "CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus",
    "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)", "CAST(o_orderdate AS VARCHAR)", "o_orderpriority",
)
_LINE_PARTS = (
    "CAST(line_id AS VARCHAR)", "CAST(order_id AS VARCHAR)", "CAST(pieces AS VARCHAR)", "CAST(quantity AS VARCHAR)",
    "CAST(price AS VARCHAR)", "CAST(shipped AS VARCHAR)",
)


def canonical_sql(parts) -> str:
    return " || ".join(f"coalesce(length({p}) || ':' || {p}, '-')" for p in parts)


def fingerprint_sql(parts) -> str:
    return f"to_base64(unhex(sha256({canonical_sql(parts)})))"


ORDER_TEXT, LINE_TEXT = canonical_sql(_ORDER_PARTS), canonical_sql(_LINE_PARTS)
ORDER_FP, LINE_FP = fingerprint_sql(_ORDER_PARTS), fingerprint_sql(_LINE_PARTS)

check_table(
    "frozen_orders",
    f"""
SELECT o_orderkey AS pk, {ORDER_FP} AS fp, CAST(NULL AS VARCHAR) AS parent_key
FROM {{orders}}, {{keyed_picked}} WHERE CAST(o_orderdate AS DATE) <= boundary_day
""",
)
check_table(
    "frozen_lines",
    f"""
SELECT line_id AS pk, {LINE_FP} AS fp, CAST(order_id AS VARCHAR) AS parent_key
FROM {{order_lines}} WHERE order_id IN (SELECT pk FROM {{frozen_orders}})
""",
)
check_table("live_order_keys", f"SELECT o_orderkey AS pk, {ORDER_FP} AS fp FROM {{live_orders}}")
check_table("live_line_keys", f"SELECT line_id AS pk, {LINE_FP} AS fp FROM {{live_lines}}")
check_table(
    "line_outcomes",
    """
SELECT f.pk, f.fp, f.parent_key,
       CASE WHEN v.fp IS NULL THEN 'missing' WHEN v.fp <> f.fp THEN 'drifted' ELSE 'deleted' END AS outcome
FROM {frozen_lines} f LEFT JOIN {live_line_keys} v ON v.pk = f.pk
""",
)
check_table(
    "line_survivors",
    """
SELECT v.* FROM {live_lines} v
WHERE NOT EXISTS (SELECT 1 FROM {line_outcomes} o WHERE o.pk = v.line_id AND o.outcome = 'deleted')
""",
)
check_table(
    "order_outcomes",
    """
SELECT f.pk, f.fp, f.parent_key,
       CASE WHEN v.fp IS NULL THEN 'missing' WHEN v.fp <> f.fp THEN 'drifted'
            WHEN f.pk IN (SELECT order_id FROM {line_survivors}) THEN 'held' ELSE 'deleted' END AS outcome
FROM {frozen_orders} f LEFT JOIN {live_order_keys} v ON v.pk = f.pk
""",
)
check_table(
    "outcomes",
    """
SELECT 'orders' AS table_name, * FROM {order_outcomes} UNION ALL SELECT 'order_lines', * FROM {line_outcomes}
""",
)
check_table(
    "numbered_orders",
    "SELECT pk, fp, parent_key, row_number() OVER (ORDER BY pk) AS rn FROM {frozen_orders}",
)
check_table(
    "numbered_lines",
    "SELECT pk, fp, parent_key, row_number() OVER (ORDER BY pk) AS rn FROM {frozen_lines}",
)
check_table(
    "chunks",
    """
SELECT table_name, (rn - 1) // 2000 AS chunk_no, count(*) AS row_count,
       sha256(string_agg(CAST(pk AS VARCHAR) || chr(9) || fp || chr(9) || coalesce(parent_key, '') || chr(10), ''
                         ORDER BY rn)) AS digest
FROM (SELECT 'orders' AS table_name, * FROM {numbered_orders}
      UNION ALL SELECT 'order_lines', * FROM {numbered_lines})
GROUP BY 1, 2
""",
)

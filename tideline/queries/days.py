"""Days, predicates, day totals and the whole-day selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.days import (
    before_day,
    column_type,
    day_start,
    eligibility_cutoff,
    local_day,
    local_today,
    within_window,
)
from tideline.operators import preview, selection
from tideline.operators.closure import chain_daily_counts, group_rows, split_groups
from tideline.queries.groups import CUTOFF, ZONE, group_days, order_group, target
from tideline.queries.registry import Inputs, query
from tideline.sources.catalog import exact_row_count, scan_table

CLOCK = "2024-01-15"


@query("scan_table", "SELECT o_orderkey, o_custkey, o_orderpriority FROM {orders} WHERE o_orderdate < DATE '1996-01-01'")
def scan(inputs: Inputs) -> DataFrame:
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return scan_table(inputs.spark, inputs.path("orders"), ["o_orderkey", "o_custkey", "o_orderpriority"], early)


@query("exact_row_count", "SELECT count(*) AS n FROM {lineitem}")
def row_count(inputs: Inputs) -> DataFrame:
    return exact_row_count(inputs.lineitem)


@query(
    "local_day",
    """
SELECT event_id, CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS day FROM {events}
""",
)
def event_day(inputs: Inputs) -> DataFrame:
    events = inputs.events
    return events.select("event_id", local_day(F.col("ts"), column_type(events, "ts"), ZONE, True).alias("day"))


@query(
    "day_start",
    """
SELECT DISTINCT CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS day,
       CAST(CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS TIMESTAMP) - INTERVAL 330 MINUTE AS VARCHAR) AS starts_at
FROM {events}
""",
)
def event_day_start(inputs: Inputs) -> DataFrame:
    events = inputs.events
    kind = column_type(events, "ts")
    days = events.select(local_day(F.col("ts"), kind, ZONE, True).alias("day")).distinct()
    return days.withColumn("starts_at", day_start(F.col("day"), kind, ZONE, True))


@query(
    "root_predicate",
    f"""
SELECT event_id, user_id FROM {{events}} WHERE ts < TIMESTAMP '{CLOCK} 00:00:00' - INTERVAL 330 MINUTE
""",
)
def events_before(inputs: Inputs) -> DataFrame:
    events = inputs.events
    early = before_day(F.col("ts"), column_type(events, "ts"), CLOCK, ZONE, ntz_is_utc=True)
    return events.where(early).select("event_id", "user_id")


@query(
    "table_predicate",
    f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM {{lineitem}}
WHERE l_orderkey IN (SELECT o_orderkey FROM {{dated_orders}} WHERE o_orderdate < DATE '{CUTOFF}')
""",
)
def lines_of_group(inputs: Inputs) -> DataFrame:
    plan, tables = order_group(inputs, "dated_orders")
    return group_rows(plan, tables, "lineitem", CUTOFF).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "eligibility_cutoff",
    """
SELECT o_orderkey,
       CAST(CAST(date_trunc('month', o_orderdate) - to_months(CAST(o_custkey % 24 AS INTEGER)) AS DATE)
            + CAST(day(o_orderdate) - 1 AS INTEGER) - CAST(o_custkey % 45 AS INTEGER) AS VARCHAR) AS cutoff
FROM {orders}
""",
)
def order_cutoffs(inputs: Inputs) -> DataFrame:
    months, grace = (F.col("o_custkey") % 24).cast("int"), (F.col("o_custkey") % 45).cast("int")
    cutoff = eligibility_cutoff(F.col("o_orderdate").cast("date"), months, grace)
    return inputs.orders.select("o_orderkey", cutoff.alias("cutoff"))


@query(
    "local_today",
    """
SELECT event_id, CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS today FROM {events}
""",
)
def event_today(inputs: Inputs) -> DataFrame:
    now = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    return inputs.events.select("event_id", local_today(ZONE, now).alias("today"))


@query(
    "window_membership",
    """
SELECT event_id,
       CASE WHEN lo <= hi THEN clock >= lo AND clock < hi ELSE clock >= lo OR clock < hi END AS inside
FROM (SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%H:%M') AS clock,
             CASE WHEN user_id % 2 = 0 THEN '22:00' ELSE '02:30' END AS lo,
             CASE WHEN user_id % 3 = 0 THEN '05:00' ELSE '23:15' END AS hi FROM {events})
""",
)
def event_windows(inputs: Inputs) -> DataFrame:
    start = F.when(F.col("user_id") % 2 == 0, "22:00").otherwise("02:30")
    end = F.when(F.col("user_id") % 3 == 0, "05:00").otherwise("23:15")
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    return inputs.events.select("event_id", within_window(instant, start, end, F.lit(ZONE)).alias("inside"))


@query("null_date_filter", "SELECT o_orderkey, o_custkey FROM {dated_orders} WHERE o_orderdate IS NULL")
def undated(inputs: Inputs) -> DataFrame:
    return inputs.dated_orders.where(F.col("o_orderdate").isNull()).select("o_orderkey", "o_custkey")


@query(
    "protected_filter",
    f"SELECT count(*) FILTER (o_orderdate >= DATE '{CUTOFF}') AS protected_rows FROM {{dated_orders}}",
)
def protected(inputs: Inputs) -> DataFrame:
    plan, tables = order_group(inputs, "dated_orders")
    counts = preview.root_counts(plan, tables["orders"])
    return counts.select((F.col("dated_rows") - F.col("eligible_root_rows")).alias("protected_rows"))


@query(
    "fk_chain_join",
    f"""
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n
FROM {{lineitem}} JOIN {{dated_orders}} ON l_orderkey = o_orderkey WHERE o_orderdate < DATE '{CUTOFF}' GROUP BY 1
""",
)
def chain_counts(inputs: Inputs) -> DataFrame:
    plan, tables = order_group(inputs, "dated_orders")
    return chain_daily_counts(plan, tables, "lineitem", CUTOFF)


@query(
    "fk_closure",
    """
SELECT order_id, line_id FROM {order_lines}
WHERE order_id IN (SELECT o_orderkey FROM {orders}, {keyed_picked} WHERE CAST(o_orderdate AS DATE) <= boundary_day)
""",
)
def closure(inputs: Inputs) -> DataFrame:
    from tideline.queries.groups import keyed_end_day, keyed_group

    plan, tables = keyed_group(inputs)
    return group_rows(plan, tables, "order_lines", keyed_end_day(plan, tables)).select("order_id", "line_id")


@query(
    "split_group_detection",
    f"""
SELECT o_orderkey AS parent_key, count(*) AS children_on_other_days
FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey
WHERE CAST(o_orderdate AS DATE) <= DATE '{CUTOFF}' AND CAST(l_shipdate AS DATE) <> CAST(o_orderdate AS DATE)
GROUP BY 1
""",
)
def split(inputs: Inputs) -> DataFrame:
    return split_groups(
        inputs.orders, "o_orderkey", "o_orderdate", inputs.lineitem, "l_orderkey", "l_shipdate", ZONE, CUTOFF
    )


@query("daily_totals", "SELECT CAST(day AS VARCHAR) AS day, table_name, n FROM {group_days}")
def totals(inputs: Inputs) -> DataFrame:
    return group_days(inputs)[0]


@query(
    "counts_by_table_map",
    """
SELECT CAST(day AS VARCHAR) AS day,
       '{' || string_agg('"' || table_name || '":' || n, ',' ORDER BY table_name) || '}' AS counts_by_table
FROM {group_days} GROUP BY 1
""",
)
def totals_map(inputs: Inputs) -> DataFrame:
    counts = selection.counts_by_table(group_days(inputs)[0])
    return counts.select("day", F.to_json("counts_by_table").alias("counts_by_table"))


_THREE_TABLES = f"""
SELECT CAST(o_orderdate AS DATE) AS day, 'orders' AS table_name, count(*) AS n
FROM {{orders}} WHERE o_orderdate < DATE '{CUTOFF}' GROUP BY 1
UNION ALL
SELECT CAST(l_shipdate AS DATE), 'lineitem', count(*) FROM {{lineitem}} WHERE l_shipdate < DATE '{CUTOFF}' GROUP BY 1
UNION ALL
SELECT CAST(ts + INTERVAL 330 MINUTE AS DATE), 'events', count(*)
FROM {{events}} WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 330 MINUTE GROUP BY 1
"""


def three_tables(inputs: Inputs) -> DataFrame:
    return selection.union_daily(
        {
            "orders": selection.table_daily(inputs.orders, "o_orderdate", ZONE, CUTOFF),
            "lineitem": selection.table_daily(inputs.lineitem, "l_shipdate", ZONE, CUTOFF),
            "events": selection.table_daily(inputs.events, "ts", ZONE, "2024-01-20", ntz_is_utc=True),
        }
    )


@query("union_daily", f"SELECT CAST(day AS VARCHAR) AS day, table_name, n FROM ({_THREE_TABLES})")
def merged_daily(inputs: Inputs) -> DataFrame:
    return three_tables(inputs)


@query(
    "multi_root_daily",
    f"""
WITH totals AS (SELECT day, CAST(sum(n) AS BIGINT) AS n FROM ({_THREE_TABLES}) GROUP BY day)
SELECT CAST(day AS VARCHAR) AS day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS cumulative,
       CAST(sum(n) OVER (ORDER BY day) - n AS BIGINT) AS before,
       sum(n) OVER (ORDER BY day) - n < (SELECT target FROM {{goal}}) AS selected
FROM totals
""",
)
def multi_root(inputs: Inputs) -> DataFrame:
    return selection.mark_days(three_tables(inputs), target(inputs))


@query("day_total", "SELECT CAST(day AS VARCHAR) AS day, CAST(sum(n) AS BIGINT) AS n FROM {group_days} GROUP BY 1")
def day_total(inputs: Inputs) -> DataFrame:
    return selection.day_totals(group_days(inputs)[0])


@query(
    "selection_totals",
    """
SELECT table_name, CAST(sum(n) AS BIGINT) AS n FROM {group_days}, {picked} WHERE day <= boundary_day GROUP BY 1
""",
)
def selection_totals(inputs: Inputs) -> DataFrame:
    return selection.selection_totals(*group_days(inputs))


_SELECTION = """
SELECT CAST(oldest_day AS VARCHAR) AS oldest_day, CAST({boundary} AS VARCHAR) AS boundary_day, total_selected,
       total_before_final_day, final_day_count, selected_days, excluded_days,
       CAST(oldest_eligible_day AS VARCHAR) AS oldest_eligible_day, eligible_total, reached_target{more}
FROM {{picked}}
"""


@query("whole_day_selection", _SELECTION.format(boundary="boundary_day", more=""))
def whole_days(inputs: Inputs) -> DataFrame:
    return selection.whole_day_selection(*group_days(inputs))


@query(
    "select_candidate",
    _SELECTION.format(
        boundary="CASE WHEN reached_target THEN boundary_day END",
        more=", CAST(CASE WHEN reached_target THEN boundary_day + 1 END AS VARCHAR) AS end_day",
    ),
)
def candidate(inputs: Inputs) -> DataFrame:
    return selection.select_candidate(*group_days(inputs))


@query("running_totals", "SELECT CAST(day AS VARCHAR) AS day, n, cumulative FROM {marked} WHERE selected")
def running(inputs: Inputs) -> DataFrame:
    return selection.running_totals(*group_days(inputs))


@query(
    "final_day_equation",
    """
SELECT total_before_final_day, final_day_count, total_selected, target - total_before_final_day AS shortfall,
       total_selected - target AS overshoot FROM {picked}
""",
)
def equation(inputs: Inputs) -> DataFrame:
    days, goal = group_days(inputs)
    result = selection.final_day_equation(selection.whole_day_selection(days, goal), goal)
    return result.select("total_before_final_day", "final_day_count", "total_selected", "shortfall", "overshoot")


@query(
    "timeline_slice",
    """
WITH placed AS (
  SELECT m.*, row_number() OVER (PARTITION BY selected ORDER BY day DESC) AS back,
         row_number() OVER (PARTITION BY selected ORDER BY day) AS ahead, reached_target
  FROM {marked} m, {picked}
), named AS (
  SELECT *, CASE WHEN selected AND back = 1 THEN 'final' WHEN selected AND back <= 4 THEN 'before'
                 WHEN selected THEN 'older' WHEN ahead <= 2 AND reached_target THEN 'after' END AS part FROM placed
)
SELECT part, CASE WHEN part <> 'older' THEN CAST(day AS VARCHAR) END AS day, count(*) AS days,
       CAST(sum(n) AS BIGINT) AS n, max(CASE WHEN part <> 'after' THEN cumulative END) AS cumulative
FROM named WHERE part IS NOT NULL GROUP BY 1, 2
""",
)
def timeline(inputs: Inputs) -> DataFrame:
    return selection.timeline_slice(*group_days(inputs))


@query(
    "subset_reselection",
    """
WITH kept AS (
  SELECT day, CAST(sum(CASE WHEN table_name = 'orders' THEN n ELSE 0 END) AS BIGINT) AS n FROM {group_days} GROUP BY day
), m AS (
  SELECT day, n, sum(n) OVER (ORDER BY day) - n AS before,
         sum(n) OVER (ORDER BY day) - n < target // 4 AS selected, target // 4 AS target FROM kept, {goal}
)
SELECT CAST(max(day) FILTER (selected) AS VARCHAR) AS boundary_day, CAST(sum(n) FILTER (selected) AS BIGINT)
         AS total_selected, CAST(max(before) FILTER (selected) AS BIGINT) AS total_before_final_day,
       count(*) FILTER (selected) AS selected_days, sum(n) FILTER (selected) >= max(target) AS reached_target
FROM m
""",
)
def subset(inputs: Inputs) -> DataFrame:
    days, goal = group_days(inputs)
    return selection.subset_reselection(days, ["orders"], goal // 4).select(
        "boundary_day", "total_selected", "total_before_final_day", "selected_days", "reached_target"
    )


@query(
    "preview_exclusions",
    f"""
WITH days AS (
  SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM {{dated_orders}}
  WHERE o_orderdate < DATE '{CUTOFF}' GROUP BY 1
  UNION ALL
  SELECT CAST(o_orderdate AS DATE), count(*) FROM {{lineitem}} JOIN {{dated_orders}} ON l_orderkey = o_orderkey
  WHERE o_orderdate < DATE '{CUTOFF}' GROUP BY 1
), m AS (
  SELECT n, sum(n) OVER (ORDER BY day) - n < target AS selected, target
  FROM (SELECT day, sum(n) AS n FROM days GROUP BY day), {{goal}}
), s AS (
  SELECT CAST(sum(n) AS BIGINT) AS eligible, CAST(sum(n) FILTER (selected) AS BIGINT) AS chosen,
         sum(n) FILTER (selected) >= max(target) AS reached FROM m
)
SELECT 'null_date' AS reason, count(*) AS n FROM {{dated_orders}} WHERE o_orderdate IS NULL
UNION ALL SELECT 'protected_period', count(*) FROM {{dated_orders}} WHERE o_orderdate >= DATE '{CUTOFF}'
UNION ALL SELECT 'after_boundary', eligible - chosen FROM s WHERE reached
UNION ALL SELECT 'target_not_reached', eligible FROM s WHERE NOT reached AND eligible > 0
""",
)
def exclusions(inputs: Inputs) -> DataFrame:
    return preview.preview_exclusions(*order_group(inputs, "dated_orders"))


_STATUS_DAYS = f"""
SELECT o_custkey AS app_id, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM {{dated_orders}}
WHERE o_orderdate < DATE '{CUTOFF}' GROUP BY 1, 2
"""


@query(
    "candidate_status",
    f"""
WITH days AS ({_STATUS_DAYS}), m AS (
  SELECT app_id, day, n, sum(n) OVER (PARTITION BY app_id ORDER BY day) - n < 8 AS selected FROM days
)
SELECT app_id, CAST(sum(n) FILTER (selected) AS BIGINT) AS total_selected,
       CASE WHEN app_id % 12 = 0 THEN 'blocked' WHEN sum(n) = 0 THEN 'no_eligible_rows'
            WHEN sum(n) FILTER (selected) >= 8 THEN 'ready' ELSE 'target_not_reached' END AS status
FROM m GROUP BY app_id
""",
)
def statuses(inputs: Inputs) -> DataFrame:
    """One candidate per customer: each has its own days, target and status."""
    dated = inputs.dated_orders
    early = before_day(F.col("o_orderdate"), column_type(dated, "o_orderdate"), CUTOFF, ZONE)
    days = dated.where(early).groupBy(
        F.col("o_custkey").alias("app_id"), F.col("o_orderdate").cast("date").alias("day")
    ).agg(F.count(F.lit(1)).alias("n"))
    chosen = selection.whole_day_selection(days, 8, ["app_id"])
    return preview.candidate_status(chosen, F.col("app_id") % 12 == 0).select("app_id", "total_selected", "status")


@query(
    "preview_tail",
    """
SELECT CAST(day AS VARCHAR) AS day, table_name, n FROM {group_days}, {picked} WHERE day <= boundary_day + 14
""",
)
def tail(inputs: Inputs) -> DataFrame:
    days, goal = group_days(inputs)
    boundary = selection.select_candidate(days, goal).first()["boundary_day"]
    return selection.preview_tail(days, F.lit(boundary).cast("date"))


@query(
    "zone_day_shift",
    f"""
SELECT count(*) FILTER (CAST(ts + INTERVAL 330 MINUTE AS DATE) = DATE '{CLOCK}') AS rows_local,
       count(*) FILTER (CAST(ts AS DATE) = DATE '{CLOCK}') AS rows_utc FROM {{events}}
""",
)
def zone_shift(inputs: Inputs) -> DataFrame:
    return selection.zone_day_shift(inputs.events, "ts", CLOCK, ZONE)


@query(
    "oldest_eligible_day",
    f"""
SELECT CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS oldest_eligible_day FROM {{live_orders}}
WHERE o_orderdate < DATE '{CUTOFF}' AND o_orderkey NOT IN (SELECT pk FROM {{order_outcomes}} WHERE outcome = 'deleted')
""",
)
def oldest_eligible(inputs: Inputs) -> DataFrame:
    """The next selection starts at the oldest row that is left, not after the last boundary."""
    from tideline.queries.removal import removal

    _, remaining = removal(inputs)
    left = remaining["orders"]
    early = before_day(F.col("o_orderdate"), column_type(left, "o_orderdate"), CUTOFF, ZONE)
    return left.where(early).agg(F.min(F.col("o_orderdate").cast("date")).alias("oldest_eligible_day"))


@query(
    "suspicious_dates",
    """
SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM {live_orders}
WHERE o_orderdate < DATE '1995-01-01'
""",
)
def suspicious(inputs: Inputs) -> DataFrame:
    early = F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")
    return inputs.live_orders.where(early).select("o_orderkey", "o_orderdate")


@query(
    "settled_guard",
    f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
WHERE o_orderdate < DATE '{CUTOFF}' AND l_shipdate < DATE '{CUTOFF}'
""",
)
def settled(inputs: Inputs) -> DataFrame:
    """Both the event date and the later date must be past the cutoff."""
    plan, tables = order_group(inputs)
    rows = group_rows(plan, tables, "lineitem", CUTOFF)
    late = before_day(F.col("l_shipdate"), column_type(rows, "l_shipdate"), CUTOFF, ZONE)
    return rows.where(late).select("l_orderkey", "l_linenumber", "l_partkey")

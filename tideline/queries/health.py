"""Severity, table and application health, alerts, growth and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import severity
from tideline.functions.severity import Thresholds
from tideline.operators import growth, health, rollups, stats
from tideline.queries.derived import NOW, TODAY
from tideline.queries.groups import ZONE
from tideline.queries.registry import Inputs, check_table, query

RECORDS = Thresholds(500_000, 1_000_000, 1_500_000)
SETTINGS = health.HealthSettings(records=RECORDS)


def level_sql(value: str, low, medium, high) -> str:
    return (
        f"CASE WHEN {value} >= {high} THEN 'HIGH' WHEN {value} >= {medium} THEN 'MEDIUM' "
        f"WHEN {value} >= {low} THEN 'LOW' ELSE 'NONE' END"
    )


def record_level(value: str) -> str:
    return level_sql(value, 500000, 1000000, 1500000)


def next_sql(value: str) -> str:
    return (
        f"CASE WHEN {value} < 500000 THEN 500000 WHEN {value} < 1000000 THEN 1000000 "
        f"WHEN {value} < 1500000 THEN 1500000 END"
    )


def now():
    return F.lit(NOW).cast("timestamp_ntz")


check_table(
    "table_health",
    f"""
SELECT *, CASE WHEN remaining <= 0 THEN 0 WHEN avg_daily_growth > 0 THEN CAST(ceil(remaining / avg_daily_growth) AS BIGINT)
          END AS days_to_next
FROM (
  SELECT t.app_id, t.schema_name, t.table_name, t.table_bytes, t.index_bytes,
         coalesce(exact_rows, estimated_rows) AS row_count,
         CASE WHEN exact_rows IS NOT NULL THEN 'exact' ELSE 'estimate' END AS row_count_kind,
         {record_level('coalesce(exact_rows, estimated_rows)')} AS severity,
         CAST({next_sql('coalesce(exact_rows, estimated_rows)')} - coalesce(exact_rows, estimated_rows) AS BIGINT)
           AS remaining,
         CASE WHEN growth_status = 'measured' THEN avg_per_day END AS avg_daily_growth, growth_status,
         first_discovered >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AS is_new,
         floor(table_bytes / 1048576.0 * 100.0 + 0.5) / 100.0 AS table_mb,
         floor(index_bytes / 1048576.0 * 100.0 + 0.5) / 100.0 AS index_mb,
         CASE WHEN p.policy = 'ARCHIVE' THEN 'archive' WHEN p.policy = 'DO_NOT_ARCHIVE' THEN 'dont_archive'
              ELSE 'review_required' END AS policy
  FROM {{tables}} t LEFT JOIN {{policies}} p
    ON p.app_id = t.app_id AND p.schema_name = t.schema_name AND p.table_name = t.table_name
  WHERE is_present
)
""",
)
check_table(
    "app_health",
    f"""
SELECT a.app_id, a.connection_status, last_check,
       CASE WHEN capacity_mb > 0 THEN database_mb / capacity_mb * 100 END AS usage_pct,
       CASE WHEN capacity_mb = 0 THEN 'HIGH' ELSE {level_sql('database_mb * 100.0 / capacity_mb', 70, 80, 90)} END
         AS db_severity,
       coalesce(worst, 'NONE') AS table_severity, coalesce(n, 0) AS table_count, largest_table, largest_rows, total,
       coalesce(unmeasured, 0) > 0 AS growth_incomplete, coalesce(review, 0) AS tables_needing_review,
       coalesce(over_low, 0) AS tables_over_low
FROM {{applications}} a LEFT JOIN (
  SELECT app_id, count(*) AS n,
         CASE WHEN bool_or(severity = 'HIGH') THEN 'HIGH' WHEN bool_or(severity = 'MEDIUM') THEN 'MEDIUM'
              WHEN bool_or(severity = 'LOW') THEN 'LOW' ELSE 'NONE' END AS worst,
         first(table_name ORDER BY row_count DESC, table_name) AS largest_table, max(row_count) AS largest_rows,
         CAST(sum(avg_daily_growth) AS BIGINT) AS total, count(*) FILTER (avg_daily_growth IS NULL) AS unmeasured,
         count(*) FILTER (policy = 'review_required') AS review, count(*) FILTER (severity <> 'NONE') AS over_low
  FROM {{table_health}} GROUP BY app_id
) t ON t.app_id = a.app_id
""",
)
_OVERALL = """CASE WHEN db_severity = 'HIGH' OR table_severity = 'HIGH' THEN 'HIGH'
       WHEN db_severity = 'MEDIUM' OR table_severity = 'MEDIUM' THEN 'MEDIUM'
       WHEN db_severity = 'LOW' OR table_severity = 'LOW' THEN 'LOW' ELSE 'NONE' END"""
check_table(
    "app_status",
    f"""
SELECT *, {_OVERALL} AS overall_severity,
       CASE WHEN connection_status <> 'connected' THEN 'unknown' WHEN {_OVERALL} = 'NONE' THEN 'healthy'
            WHEN {_OVERALL} = 'HIGH' THEN 'critical' ELSE 'attention' END AS status
FROM {{app_health}}
""",
)


def tables(inputs: Inputs) -> DataFrame:
    return health.table_health(inputs.tables, inputs.policies, SETTINGS, now())


def apps(inputs: Inputs) -> DataFrame:
    return health.app_health(inputs.applications, tables(inputs), SETTINGS)


@query("severity_records", f"SELECT o_orderkey, {record_level('o_totalprice * 4')} AS severity FROM {{orders}}")
def record_severity(inputs: Inputs) -> DataFrame:
    return inputs.orders.select("o_orderkey", RECORDS.level(F.col("o_totalprice") * 4).alias("severity"))


@query(
    "severity_capacity",
    f"SELECT app_id, {level_sql('database_mb / 100.0', 70, 80, 90)} AS severity FROM {{applications}}",
)
def capacity_severity(inputs: Inputs) -> DataFrame:
    usage = F.col("database_mb") / F.lit(100.0)
    return inputs.applications.select("app_id", SETTINGS.capacity_pct.level(usage).alias("severity"))


@query(
    "next_threshold",
    f"""
SELECT app_id, table_name, CASE WHEN n < 500000 THEN 'LOW' WHEN n < 1000000 THEN 'MEDIUM' WHEN n < 1500000 THEN 'HIGH' END
         AS next_level, CAST({next_sql('n')} AS BIGINT) AS next_threshold
FROM (SELECT app_id, table_name, estimated_rows AS n FROM {{tables}})
""",
)
def next_steps(inputs: Inputs) -> DataFrame:
    rows = F.col("estimated_rows")
    return inputs.tables.select(
        "app_id", "table_name", RECORDS.next_level(rows).alias("next_level"),
        RECORDS.next_threshold(rows).cast("long").alias("next_threshold"),
    )


@query(
    "days_to_threshold",
    f"""
SELECT app_id, table_name, CASE WHEN left_over <= 0 THEN 0 WHEN avg_per_day > 0
         THEN CAST(ceil(left_over / avg_per_day) AS BIGINT) END AS days
FROM (SELECT app_id, table_name, avg_per_day, 1000000 - estimated_rows AS left_over FROM {{tables}})
""",
)
def projections(inputs: Inputs) -> DataFrame:
    days = severity.days_to_threshold(F.lit(1_000_000) - F.col("estimated_rows"), F.col("avg_per_day"))
    return inputs.tables.select("app_id", "table_name", days.alias("days"))


@query(
    "table_health",
    """
SELECT app_id, schema_name, table_name, row_count, row_count_kind, severity,
       CASE WHEN severity = 'NONE' THEN 'LOW' WHEN severity = 'LOW' THEN 'MEDIUM' WHEN severity = 'MEDIUM' THEN 'HIGH' END
         AS next_level,
       remaining AS records_remaining, avg_daily_growth, growth_status,
       CASE WHEN avg_daily_growth IS NOT NULL OR remaining <= 0 THEN days_to_next END AS days_to_next_threshold, is_new,
       table_mb, index_mb, policy
FROM {table_health}
""",
)
def table_report(inputs: Inputs) -> DataFrame:
    return tables(inputs).drop("table_bytes", "index_bytes")


@query(
    "capacity_pct",
    f"""
SELECT app_id, database_bytes / 1048576.0 / capacity_mb * 100 AS usage_pct, level,
       CAST(floor(database_bytes / 1048576.0 + 0.5) AS BIGINT) AS observed_mb,
       CAST(floor(capacity_mb * CASE level WHEN 'HIGH' THEN 90 WHEN 'MEDIUM' THEN 80 ELSE 70 END / 100.0 + 0.5) AS BIGINT)
         AS threshold_mb
FROM (SELECT *, {level_sql('database_bytes / 1048576.0 / capacity_mb * 100', 70, 80, 90)} AS level
      FROM {{applications}} WHERE capacity_mb > 0)
""",
)
def capacity(inputs: Inputs) -> DataFrame:
    return health.capacity_alert(inputs.applications, SETTINGS.capacity_pct)


@query(
    "app_health_rollup",
    """
SELECT app_id, usage_pct, db_severity, table_severity, overall_severity, status, table_count, largest_table,
       largest_rows, total AS total_daily_growth, growth_incomplete, tables_needing_review, tables_over_low
FROM {app_status}
""",
)
def app_rollup(inputs: Inputs) -> DataFrame:
    return apps(inputs)


@query("max_severity", "SELECT app_id, overall_severity FROM {app_status}")
def worst(inputs: Inputs) -> DataFrame:
    return apps(inputs).select(
        "app_id", severity.max_level(F.col("db_severity"), F.col("table_severity")).alias("overall_severity")
    )


@query("severity_counts", "SELECT severity, count(*) AS tables FROM {table_health} GROUP BY 1")
def severities(inputs: Inputs) -> DataFrame:
    return health.severity_counts(tables(inputs))


@query(
    "new_table_flag",
    f"""
SELECT app_id, table_name, CASE WHEN app_id % 37 = 0 THEN TIMESTAMP '2001-08-10' ELSE first_discovered END
         >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AS is_new
FROM {{tables}}
""",
)
def new_flags(inputs: Inputs) -> DataFrame:
    """Some applications were connected in the last week."""
    recent = F.lit("2001-08-10").cast("timestamp_ntz")
    flag = health.is_new_table(F.when(F.col("app_id") % 37 == 0, recent).otherwise(F.col("first_discovered")), now())
    return inputs.tables.select("app_id", "table_name", flag.alias("is_new"))


@query(
    "near_threshold_filter",
    "SELECT app_id, schema_name, table_name, row_count FROM {table_health} WHERE row_count >= 250000",
)
def near(inputs: Inputs) -> DataFrame:
    return health.near_threshold_tables(tables(inputs), SETTINGS).select(*health.TABLE_KEY, "row_count")


@query(
    "index_size_sum",
    """
SELECT app_id, floor(CAST(sum(CAST(index_mb AS DECIMAL(18,2))) AS DOUBLE) * 10.0 + 0.5) / 10.0 AS index_mb
FROM {table_health} GROUP BY 1
""",
)
def index_sizes(inputs: Inputs) -> DataFrame:
    return rollups.index_size_sum(tables(inputs))


@query("present_tables", "SELECT app_id, schema_name, table_name FROM {tables} WHERE is_present")
def present(inputs: Inputs) -> DataFrame:
    return inputs.tables.where("is_present").select(*health.TABLE_KEY)


@query(
    "table_policy_join",
    "SELECT app_id, schema_name, table_name, policy FROM {table_health}",
)
def with_policy(inputs: Inputs) -> DataFrame:
    present_tables = inputs.tables.where("is_present")
    return health.join_policies(present_tables, inputs.policies).select(*health.TABLE_KEY, "policy")


@query(
    "tables_by_rows",
    "SELECT app_id, schema_name, table_name, row_count FROM {table_health}",
)
def by_rows(inputs: Inputs) -> DataFrame:
    return health.tables_by_rows(tables(inputs)).select(*health.TABLE_KEY, "row_count")


@query(
    "top_near_threshold",
    """
SELECT app_id, table_name, row_count, remaining AS records_remaining FROM {table_health}
WHERE severity <> 'NONE' OR row_count >= 300000
ORDER BY coalesce(remaining, -1), row_count DESC, app_id, schema_name, table_name LIMIT 4
""",
)
def top_near(inputs: Inputs) -> DataFrame:
    top = health.top_near_threshold(tables(inputs), SETTINGS)
    return top.select("app_id", "table_name", "row_count", "records_remaining")


@query(
    "largest_tables",
    """
SELECT app_id, table_name, row_count, position FROM (
  SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY row_count DESC, schema_name, table_name) AS position
  FROM {table_health}
) WHERE position <= 3
""",
)
def largest(inputs: Inputs) -> DataFrame:
    top = health.largest_tables(tables(inputs))
    return top.select("app_id", "table_name", "row_count", F.col("position").cast("long").alias("position"))


@query(
    "growth_tables",
    """
SELECT app_id, table_name, row_count FROM {table_health} WHERE row_count >= 100000
ORDER BY row_count DESC, app_id, schema_name, table_name LIMIT 4
""",
)
def growth_list(inputs: Inputs) -> DataFrame:
    return health.growth_tables(tables(inputs)).select("app_id", "table_name", "row_count")


_SNAPSHOT_LEVEL = level_sql("rows", 500000, 1000000, 1500000)


@query(
    "alert_transitions",
    f"""
WITH leveled AS (
  SELECT *, {_SNAPSHOT_LEVEL} AS level FROM {{snapshots}}
), moved AS (
  SELECT *, coalesce(lag(level) OVER (PARTITION BY app_id ORDER BY day), 'NONE') AS before FROM leveled
)
SELECT app_id, CAST(day AS VARCHAR) AS day, rows AS observed, level,
       CASE WHEN level = 'NONE' THEN 'resolve' WHEN before = 'NONE' THEN 'open' WHEN level = before THEN 'update'
            ELSE 'replace' END AS action,
       CASE WHEN level <> 'NONE' AND before <> 'NONE' AND level <> before THEN before END AS escalated_from,
       CASE level WHEN 'HIGH' THEN 1500000 WHEN 'MEDIUM' THEN 1000000 WHEN 'LOW' THEN 500000 END AS threshold
FROM moved WHERE level <> 'NONE' OR before <> 'NONE'
""",
)
def transitions(inputs: Inputs) -> DataFrame:
    return health.alert_transitions(inputs.snapshots, RECORDS, ["app_id"], "day", "rows")


@query(
    "alert_counts",
    """
SELECT count(*) FILTER (state = 'active' AND level = 'HIGH') AS high,
       count(*) FILTER (state = 'active' AND level = 'MEDIUM') AS medium,
       count(*) FILTER (state = 'active' AND level = 'LOW') AS low, count(*) FILTER (state = 'resolved') AS resolved
FROM {alerts}
""",
)
def alert_totals(inputs: Inputs) -> DataFrame:
    return rollups.alert_counts(inputs.alerts)


# --- growth ------------------------------------------------------------------------------------------------

_WINDOW = "l_shipdate >= TIMESTAMP '2001-02-01' AND l_shipdate < TIMESTAMP '2001-08-01'"
_ORDER_WINDOW = "o_orderdate >= TIMESTAMP '2001-02-01' AND o_orderdate < TIMESTAMP '2001-08-01'"
check_table(
    "supplier_daily",
    f"SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM {{lineitem}} WHERE {_WINDOW} GROUP BY 1, 2",
)
check_table(
    "supplier_spikes",
    """
SELECT d.l_suppkey, day, n, median FROM {supplier_daily} d JOIN (
  SELECT l_suppkey, list(n ORDER BY n)[count(*) // 2 + 1] AS median FROM {supplier_daily} GROUP BY 1
  HAVING count(*) >= 7
) m ON m.l_suppkey = d.l_suppkey WHERE n > 3 * median
""",
)


def supplier_daily(inputs: Inputs) -> DataFrame:
    return growth.growth_daily(inputs.lineitem, "l_shipdate", ZONE, TODAY, ["l_suppkey"])


def suppliers(inputs: Inputs) -> DataFrame:
    return inputs.lineitem.select("l_suppkey").distinct()


_MONTHLY = """
SELECT l_suppkey, CAST(month AS VARCHAR) AS month, coalesce(n, 0) AS records_added, days_in_month,
       CAST(floor(coalesce(n, 0) / days_in_month + 0.5) AS BIGINT) AS per_day
FROM (SELECT l_suppkey, month, CAST(day(last_day(month)) AS INTEGER) AS days_in_month
      FROM (SELECT DISTINCT l_suppkey FROM {lineitem})
      CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2001-02-01', DATE '2001-07-01', INTERVAL 1 MONTH)) AS DATE)
                    AS month))
LEFT JOIN (SELECT l_suppkey AS s, CAST(date_trunc('month', day) AS DATE) AS m, CAST(sum(n) AS BIGINT) AS n
           FROM {supplier_daily} GROUP BY 1, 2) ON s = l_suppkey AND m = month
"""


@query("growth_monthly", _MONTHLY.replace(",\n       CAST(floor(coalesce(n, 0) / days_in_month + 0.5) AS BIGINT) AS per_day", ""))
def monthly(inputs: Inputs) -> DataFrame:
    points = growth.growth_monthly(supplier_daily(inputs), suppliers(inputs), TODAY, ["l_suppkey"])
    return points.drop("per_day")


@query(
    "monthly_rate",
    """
SELECT CAST(month AS VARCHAR) AS month, records_added,
       CAST(floor(records_added / day(last_day(month)) + 0.5) AS BIGINT) AS per_day
FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS records_added FROM {orders} GROUP BY 1)
""",
)
def rates(inputs: Inputs) -> DataFrame:
    month = F.trunc(F.col("o_orderdate"), "MM").cast("date").alias("month")
    added = inputs.orders.groupBy(month).agg(F.count(F.lit(1)).alias("records_added"))
    return added.withColumn(
        "per_day", health.monthly_rate(F.col("records_added"), F.day(F.last_day("month")))
    )


check_table(
    "flag_daily",
    f"SELECT l_returnflag, CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM {{shipments}} WHERE {_WINDOW} GROUP BY 1, 2",
)


@query(
    "growth_average",
    """
SELECT s.l_returnflag, 181 AS days, coalesce(n, 0) AS records_in_window,
       CAST(floor(coalesce(n, 0) / 181 + 0.5) AS BIGINT) AS avg_per_day, coalesce(k, 0) AS spike_days,
       CAST(floor((coalesce(n, 0) - coalesce(x, 0)) / greatest(1, 181 - coalesce(k, 0)) + 0.5) AS BIGINT)
         AS avg_without_spikes
FROM (SELECT DISTINCT l_returnflag FROM {lineitem}) s
LEFT JOIN (SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n FROM {flag_daily} GROUP BY 1) d USING (l_returnflag)
LEFT JOIN (SELECT d.l_returnflag, count(*) AS k, CAST(sum(n) AS BIGINT) AS x FROM {flag_daily} d
           JOIN (SELECT l_returnflag, list(n ORDER BY n)[count(*) // 2 + 1] AS median FROM {flag_daily}
                 GROUP BY 1 HAVING count(*) >= 7) m ON m.l_returnflag = d.l_returnflag AND n > 5 * median GROUP BY 1) k
  USING (l_returnflag)
""",
)
def averages(inputs: Inputs) -> DataFrame:
    daily = growth.growth_daily(inputs.shipments, "l_shipdate", ZONE, TODAY, ["l_returnflag"])
    return growth.growth_average(daily, inputs.lineitem.select("l_returnflag").distinct(), TODAY, ["l_returnflag"])


@query("spike_days", "SELECT l_suppkey, CAST(day AS VARCHAR) AS day, n, median FROM {supplier_spikes}")
def spikes(inputs: Inputs) -> DataFrame:
    return growth.spike_days(supplier_daily(inputs), ["l_suppkey"], factor=3)


@query(
    "growth_status",
    """
SELECT o_custkey, CAST(min(o_orderdate) AS VARCHAR) AS oldest,
       CASE WHEN min(o_orderdate) <= TIMESTAMP '2001-02-01' THEN 'measured' ELSE 'insufficient_history' END AS status,
       CASE WHEN min(o_orderdate) IS NULL THEN 'table is empty'
            WHEN min(o_orderdate) > TIMESTAMP '2001-02-01' THEN 'oldest row is newer than the window start' END AS reason
FROM {dated_orders} GROUP BY 1
""",
)
def growth_states(inputs: Inputs) -> DataFrame:
    return growth.growth_status(inputs.dated_orders, "o_orderdate", ZONE, TODAY, ["o_custkey"])


@query(
    "net_growth",
    f"""
WITH ends AS (
  SELECT app_id, arg_max(rows, day) AS rows_now,
         arg_max(rows, day) FILTER (day <= DATE '{TODAY}' - 180) AS rows_before
  FROM {{snapshots}} WHERE day <= DATE '{TODAY}' GROUP BY 1
), moved AS (
  SELECT app_id, CAST(sum(deleted) AS BIGINT) AS archived
  FROM {{batches}} b JOIN {{jobs}} j ON j.job_id = b.job_id
  WHERE CAST(created_at AS DATE) > DATE '{TODAY}' - 180 AND CAST(created_at AS DATE) <= DATE '{TODAY}' GROUP BY 1
)
SELECT e.app_id, rows_now, rows_before, coalesce(archived, 0) AS archived,
       CAST(floor((rows_now - rows_before + coalesce(archived, 0)) / 180 + 0.5) AS BIGINT) AS net_per_day
FROM ends e LEFT JOIN moved m ON m.app_id = e.app_id
""",
)
def net(inputs: Inputs) -> DataFrame:
    removed = inputs.batches.join(inputs.jobs.select("job_id", "app_id", "created_at"), "job_id")
    archived = removed.select("app_id", F.col("created_at").cast("date").alias("day"), F.col("deleted").alias("n"))
    return growth.net_growth(inputs.snapshots, archived, TODAY, ["app_id"])


@query(
    "capacity_runway",
    """
SELECT app_id, CASE WHEN app_id % 30 > 0 THEN (capacity_mb * 80.0 / 100 - database_mb) / (app_id % 30) END AS days
FROM {applications}
""",
)
def runway(inputs: Inputs) -> DataFrame:
    days = growth.capacity_runway(F.col("capacity_mb"), 80.0, F.col("database_mb"), F.col("app_id") % 30)
    return inputs.applications.select("app_id", days.alias("days"))


_LAG = """
SELECT l_returnflag, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) AS value
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""


def lag_histogram(inputs: Inputs) -> DataFrame:
    joined = inputs.lineitem.select("l_orderkey", "l_shipdate", "l_returnflag").join(
        inputs.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return growth.lateness_counts(F.datediff("l_shipdate", "o_orderdate"), joined, ["l_returnflag"])


def _position_sql(rank: str, name: str) -> str:
    return f"min(value) FILTER (rn = {rank}) AS {name}"


def _ranks(picks: str) -> str:
    return f"""
WITH ranked AS (
  SELECT l_returnflag, value, row_number() OVER (PARTITION BY l_returnflag ORDER BY value) AS rn,
         count(*) OVER (PARTITION BY l_returnflag) AS n FROM ({_LAG})
)
SELECT l_returnflag, max(n) AS n, {picks}, max(value) AS max FROM ranked GROUP BY 1
"""


@query(
    "latency_percentiles",
    _ranks(", ".join(
        _position_sql(f"least(n, CAST(floor({p} * n) AS BIGINT) + 1)", name) for name, p in (("p50", 0.5), ("p95", 0.95))
    )),
)
def latency(inputs: Inputs) -> DataFrame:
    return stats.index_percentiles(lag_histogram(inputs), {"p50": 0.5, "p95": 0.95}, ["l_returnflag"])


@query(
    "lateness_percentiles",
    f"""
SELECT l_returnflag, count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50,
       percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95,
       percentile_disc(0.99) WITHIN GROUP (ORDER BY value) AS p99, max(value) AS max
FROM ({_LAG}) GROUP BY 1
""",
)
def lateness(inputs: Inputs) -> DataFrame:
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return stats.disc_percentiles(lag_histogram(inputs), points, ["l_returnflag"])


@query(
    "price_percentiles",
    """
SELECT l_returnflag, count(*) AS n, percentile_disc(0.01) WITHIN GROUP (ORDER BY l_extendedprice) AS p01,
       percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS p50,
       percentile_disc(0.95) WITHIN GROUP (ORDER BY l_extendedprice) AS p95, max(l_extendedprice) AS max
FROM {lineitem} GROUP BY 1
""",
)
def prices(inputs: Inputs) -> DataFrame:
    """Exact percentiles of a measure with almost as many values as rows."""
    return stats.radix_percentiles(inputs.lineitem, "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p95": 0.95}, ["l_returnflag"])

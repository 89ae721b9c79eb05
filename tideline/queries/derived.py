"""Tables derived from the driver's: a keyed child table, edited copies, and the records of a retention service.

The text is limited to what both engines read the same way. Every table grows with the data it comes from.
"""

from __future__ import annotations

from tideline.queries.registry import derive

# Fixed point in time of all evaluations.
TODAY = "2001-08-15"
NOW = "2001-08-15 06:00:00"

# Orders with some undated rows.
derive(
    "dated_orders",
    """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate, o_orderpriority
FROM {orders}
""",
)

# Order lines with a single-column key: lineitem repeats (order, line number), so its rows are added up.
derive(
    "order_lines",
    """
SELECT l_orderkey * 8 + l_linenumber AS line_id, l_orderkey AS order_id, CAST(count(*) AS BIGINT) AS pieces,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS quantity,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS price,
       min(l_shipdate) AS shipped
FROM {lineitem}
GROUP BY l_orderkey, l_linenumber
""",
    {"lineitem": ("l_orderkey", "l_linenumber")},
)

# Shipments per return flag, with two days on which twenty times as many went out.
SPIKE_DAYS, SPIKE_COPIES = ("2001-03-15", "2001-05-20"), 19
_COPIES = ", ".join(f"(DATE '{day}', {n})" for day in SPIKE_DAYS for n in range(SPIKE_COPIES))
derive(
    "shipments",
    f"""
SELECT l_returnflag, l_shipdate FROM {{lineitem}}
UNION ALL
SELECT l_returnflag, l_shipdate FROM {{lineitem}} JOIN (VALUES {_COPIES}) AS copies(day, n) ON CAST(l_shipdate AS DATE) = day
""",
)

# The orders as they look after a freeze: some edited, some gone, some arrived late inside the archived range.
derive(
    "live_orders",
    """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 103 <> 0
UNION ALL
SELECT o_orderkey + 1000000000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 89 = 0
UNION ALL
SELECT o_orderkey + 2000000000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       DATE '1990-06-01' AS o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 997 = 0
""",
)

derive(
    "live_lines",
    """
SELECT line_id, order_id, pieces, CASE WHEN line_id % 107 = 0 THEN quantity + 1 ELSE quantity END AS quantity,
       price, shipped
FROM {order_lines} WHERE line_id % 109 <> 0
UNION ALL
SELECT line_id + 1000000000000 AS line_id, order_id, pieces, quantity, price, shipped
FROM {order_lines} WHERE line_id % 113 = 0
""",
)

# One application per customer.
derive(
    "applications",
    """
SELECT c_custkey AS app_id, c_name AS app_name,
       CASE WHEN c_custkey % 7 = 0 THEN 'production' ELSE 'synthetic' END AS environment,
       c_custkey % 11 <> 0 AS enabled,
       CASE WHEN c_custkey % 6 = 0 THEN 'disconnected' WHEN c_custkey % 6 = 1 THEN 'degraded'
            ELSE 'connected' END AS connection_status,
       CAST(floor(c_acctbal) AS BIGINT) + 1000 AS database_mb,
       (CAST(floor(c_acctbal) AS BIGINT) + 1000) * 1048576 + 600000 AS database_bytes,
       CAST(CASE WHEN c_custkey % 19 = 0 THEN 0 ELSE 10000 END AS BIGINT) AS capacity_mb,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'Asia/Kolkata' END AS time_zone,
       CAST(CAST('2001-08-01' AS DATE) + CAST(c_custkey % 14 AS INTEGER) AS DATE) AS last_check
FROM {customer}
""",
)

# Up to five tables per application, one per order priority.
derive(
    "tables",
    """
SELECT app_id, schema_name, table_name,
       CAST(CASE WHEN app_id % 5 = 0 THEN NULL ELSE amount * 3 + 17 END AS BIGINT) AS exact_rows,
       amount * 3 AS estimated_rows, amount * 360 AS table_bytes, amount * 95 AS index_bytes,
       first_discovered, last_seen, app_id % 17 <> 0 AS is_present,
       CASE WHEN app_id % 23 = 0 THEN 0 WHEN app_id % 29 = 0 THEN 2 ELSE 1 END AS key_columns,
       CASE WHEN table_name = 'members' THEN 0 ELSE 1 END AS date_candidates,
       CASE WHEN app_id % 4 = 0 THEN 'insufficient_history' ELSE 'measured' END AS growth_status,
       CAST(CASE WHEN app_id % 4 = 0 THEN NULL WHEN app_id % 9 = 0 THEN 0 ELSE orders * 1240 END AS BIGINT) AS avg_per_day
FROM (
  SELECT o_custkey AS app_id, CASE WHEN o_custkey % 31 = 0 THEN 'billing' ELSE 'public' END AS schema_name,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'attendance_records' WHEN o_orderpriority = '2-HIGH' THEN 'audit_logs'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'members' WHEN o_orderpriority = '5-LOW' THEN 'orders'
              ELSE 'order_items' END AS table_name,
         CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS amount, CAST(count(*) AS BIGINT) AS orders,
         min(o_orderdate) AS first_discovered, max(o_orderdate) AS last_seen
  FROM {orders}
  GROUP BY o_custkey, o_orderpriority
) per_priority
""",
)

derive(
    "policies",
    """
SELECT app_id, schema_name, table_name,
       CASE WHEN estimated_rows % 5 = 0 THEN 'REVIEW_REQUIRED' WHEN estimated_rows % 7 = 1 THEN 'DO_NOT_ARCHIVE'
            ELSE 'ARCHIVE' END AS policy,
       CASE WHEN app_id % 8 = 3 THEN NULL ELSE 'created_at' END AS date_column,
       CASE WHEN app_id % 10 = 4 THEN NULL ELSE CAST(app_id % 13 AS INTEGER) END AS protected_months,
       CAST(CASE WHEN app_id % 14 = 5 THEN NULL ELSE app_id % 9 * 10000 END AS BIGINT) AS target_rows,
       CASE WHEN app_id % 3 = 0 THEN NULL ELSE CAST(app_id % 12 AS INTEGER) - 1 END AS grace_days,
       CASE WHEN app_id % 21 = 2 THEN 'xlsx' WHEN app_id % 22 = 3 THEN NULL ELSE 'csv.gz' END AS archive_format,
       CASE WHEN app_id % 5 = 2 THEN 'Europe/Paris' ELSE NULL END AS time_zone,
       app_id % 6 <> 1 AS enabled,
       CASE WHEN table_name = 'order_items' OR table_name = 'audit_logs' THEN schema_name || '.orders' ELSE NULL END
         AS group_root
FROM {tables}
WHERE (app_id + estimated_rows) % 11 <> 0
""",
)

# What a policy is checked against.
derive(
    "policy_context",
    """
SELECT t.app_id, t.schema_name, t.table_name, t.key_columns,
       CASE WHEN t.date_candidates = 0 THEN NULL WHEN t.app_id % 16 = 9 THEN 'string'
            WHEN t.app_id % 2 = 0 THEN 'timestamp' ELSE 'date' END AS date_type,
       a.time_zone AS app_time_zone
FROM {tables} t JOIN {applications} a ON a.app_id = t.app_id
""",
)

# One archive job per order.
derive(
    "jobs",
    """
SELECT o_orderkey AS job_id, o_custkey AS app_id,
       CASE WHEN o_custkey % 31 = 0 THEN 'billing.' ELSE 'public.' END ||
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'attendance_records' WHEN o_orderpriority = '2-HIGH' THEN 'audit_logs'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'members' WHEN o_orderpriority = '5-LOW' THEN 'orders'
            ELSE 'order_items' END AS group_root,
       CASE WHEN o_orderstatus = 'P' THEN
         CASE WHEN o_orderkey % 8 = 0 THEN 'queued' WHEN o_orderkey % 8 = 1 THEN 'exporting'
              WHEN o_orderkey % 8 = 2 THEN 'verifying' WHEN o_orderkey % 8 = 3 THEN 'ready_for_deletion'
              WHEN o_orderkey % 8 = 4 THEN 'deletion_approved' WHEN o_orderkey % 8 = 5 THEN 'deleting'
              WHEN o_orderkey % 8 = 6 THEN 'verifying_deletion' ELSE 'freezing' END
       WHEN o_orderstatus = 'F' THEN
         CASE WHEN o_orderkey % 4 = 0 THEN 'failed' WHEN o_orderkey % 4 = 1 THEN 'cancelled'
              WHEN o_orderkey % 4 = 2 THEN 'requires_review' ELSE 'completed_with_exceptions' END
       ELSE 'completed' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN 'ARCHIVE_AND_VERIFY_ONLY' ELSE 'ARCHIVE_VERIFY_DELETE' END AS mode,
       o_orderkey % 3 + 1 AS attempt, o_custkey % 40 AS created_by,
       o_orderdate AS created_at,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS finished_at,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS boundary_day,
       CAST(floor(o_totalprice) AS BIGINT) AS selected_rows,
       'schema-' || CAST(o_custkey % 50 AS VARCHAR(20)) AS schema_hash,
       'graph-' || CAST(o_custkey % 60 AS VARCHAR(20)) AS graph_hash
FROM {orders}
""",
)

# One verification run per order line, of one of the job's attempts.
derive(
    "verifications",
    """
SELECT line_id AS verification_id, order_id AS job_id, order_id % 3 + 1 - CASE WHEN line_id % 10 = 0 THEN 1 ELSE 0 END
         AS attempt,
       line_id % 4 <> 0 AS verified,
       CASE WHEN line_id % 4 <> 0 THEN NULL WHEN line_id % 8 = 0 THEN 'archive_key_set' ELSE 'schema_hash' END
         AS failed_stage,
       shipped AS verified_at
FROM {order_lines}
""",
)

# Gate checks: one per line item.
derive(
    "checks",
    """
SELECT l_orderkey AS job_id,
       CASE WHEN l_linenumber = 1 THEN 'archive_created' WHEN l_linenumber = 2 THEN 'archive_integrity'
            WHEN l_linenumber = 3 THEN 'archive_row_count' WHEN l_linenumber = 4 THEN 'archive_key_set'
            WHEN l_linenumber = 5 THEN 'restore_fingerprint' ELSE 'schema_hash' END AS stage,
       NOT (l_returnflag = 'R' AND l_partkey % 5 = 0) AS pass
FROM {lineitem}
""",
)

# Removal batches: one per order line, with the outcome of its rows.
derive(
    "batches",
    """
SELECT order_id AS job_id, line_id % 8 AS batch_no,
       CASE WHEN line_id % 6 = 0 THEN 'started' ELSE 'done' END AS state,
       CASE WHEN line_id % 7 = 0 THEN 2 ELSE 1 END AS attempts,
       CASE WHEN line_id % 2 = 0 THEN 'order_items' ELSE 'orders' END AS table_name,
       pieces * 100 AS requested,
       pieces * 100 - CASE WHEN line_id % 5 = 0 THEN 7 ELSE 0 END - CASE WHEN line_id % 9 = 0 THEN 3 ELSE 0 END
         - CASE WHEN line_id % 11 = 0 THEN 2 ELSE 0 END AS deleted,
       CAST(CASE WHEN line_id % 5 = 0 THEN 7 ELSE 0 END AS BIGINT) AS drifted,
       CAST(CASE WHEN line_id % 9 = 0 THEN 3 ELSE 0 END AS BIGINT) AS held,
       CAST(CASE WHEN line_id % 11 = 0 THEN 2 ELSE 0 END AS BIGINT) AS missing
FROM {order_lines}
""",
)

# Chunks of frozen keys: one per line item.
derive(
    "candidates",
    """
SELECT l_orderkey AS job_id, l_orderkey % 3 + 1 AS attempt,
       CASE WHEN l_linenumber > 4 THEN 'public.order_items' WHEN l_linenumber > 2 THEN 'public.orders'
            ELSE 'public.audit_logs' END AS table_name,
       l_linenumber AS chunk_no, CAST(l_quantity AS BIGINT) AS row_count,
       CAST(l_quantity AS BIGINT) - CASE WHEN l_partkey % 40 = 0 THEN 1 ELSE 0 END AS key_count
FROM {lineitem}
""",
)

# Manifests of job attempts.
derive(
    "manifests",
    """
SELECT o_orderkey AS job_id, o_orderkey % 3 + 1 AS attempt,
       CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE 'sha-' || CAST(o_orderkey % 500 AS VARCHAR(20)) END
         AS manifest_sha256,
       CAST(floor(o_totalprice) AS BIGINT) * 14 AS data_bytes
FROM {orders} WHERE o_orderkey % 6 <> 5
""",
)

# Stored objects of archives: one per line item.
derive(
    "objects",
    """
SELECT l_orderkey AS job_id,
       CASE WHEN l_linenumber = 7 THEN 'manifest/part-' WHEN l_linenumber % 2 = 0 THEN 'data/orders/part-'
            ELSE 'keys/orders/part-' END || CAST(l_partkey AS VARCHAR(20)) AS object,
       CAST(floor(l_extendedprice) AS BIGINT) AS bytes
FROM {lineitem}
""",
)

# Decisions on removal, one per order line.
derive(
    "approvals",
    """
SELECT line_id AS approval_id, order_id AS job_id, order_id % 3 + 1 - CASE WHEN line_id % 38 = 0 THEN 1 ELSE 0 END AS attempt,
       line_id % 45 AS operator_id,
       CASE WHEN line_id % 12 = 0 THEN 'reject' ELSE 'approve' END AS decision,
       CASE WHEN line_id % 15 = 0 THEN shipped ELSE NULL END AS revoked_at,
       CASE WHEN line_id % 25 = 0 THEN NULL WHEN line_id % 4 = 1 THEN TIMESTAMP '2001-08-01 00:00:00'
            ELSE TIMESTAMP '2001-09-01 00:00:00' END AS expires_at,
       'sha-' || CAST((order_id + CASE WHEN line_id % 18 = 0 THEN 1 ELSE 0 END) % 500 AS VARCHAR(20)) AS manifest_sha256,
       CASE WHEN line_id % 26 = 0 THEN 'schema-x' WHEN line_id % 27 = 0 THEN NULL ELSE j.schema_hash END AS schema_hash,
       CASE WHEN line_id % 34 = 0 THEN 'graph-x' ELSE j.graph_hash END AS graph_hash,
       'set-' || CAST((order_id + CASE WHEN line_id % 22 = 0 THEN 1 ELSE 0 END) % 700 AS VARCHAR(20)) AS candidate_digest
FROM {order_lines} JOIN {jobs} j ON j.job_id = order_id
""",
)

# Operators and what they may do: one per supplier.
derive(
    "operators",
    """
SELECT s_suppkey AS operator_id, s_acctbal > 0 AS active, s_nationkey % 5 <> 0 AS can_approve FROM {supplier}
""",
)

# Alerts: one per order.
derive(
    "alerts",
    """
SELECT o_orderkey AS alert_id, o_custkey AS app_id,
       CASE WHEN o_totalprice > 400000 THEN 'HIGH' WHEN o_totalprice > 250000 THEN 'MEDIUM' ELSE 'LOW' END AS level,
       CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'resolved' END AS state, o_orderdate AS detected_at
FROM {orders}
""",
)

# Daily snapshots of a table's size: what its application had ordered up to each day.
derive(
    "snapshots",
    """
SELECT app_id, day, CAST(sum(amount) OVER (PARTITION BY app_id ORDER BY day) - 4 * amount AS BIGINT) AS rows
FROM (
  SELECT o_custkey AS app_id, CAST(o_orderdate AS DATE) AS day, sum(CAST(floor(o_totalprice) AS BIGINT)) AS amount
  FROM {orders}
  GROUP BY o_custkey, CAST(o_orderdate AS DATE)
) per_day
""",
)

# Foreign keys of very many small databases: one database per order, one key per line item.
derive(
    "edges",
    """
SELECT DISTINCT l_orderkey AS app_id, 't' || CAST(l_linenumber AS VARCHAR(20)) AS child,
       't' || CAST(l_partkey % 7 + 1 AS VARCHAR(20)) AS parent,
       'fk_t' || CAST(l_linenumber AS VARCHAR(20)) || '_t' || CAST(l_partkey % 7 + 1 AS VARCHAR(20)) AS name,
       CASE WHEN l_partkey % 7 = 0 THEN 'CASCADE' WHEN l_partkey % 7 = 1 THEN 'SET NULL'
            WHEN l_partkey % 7 = 2 THEN 'RESTRICT' WHEN l_partkey % 7 = 3 THEN 'SET DEFAULT' ELSE 'NO ACTION' END
         AS on_delete
FROM {lineitem}
""",
    {"lineitem": ("l_orderkey",)},
)

# The tables of those databases: both ends of every key.
derive(
    "edge_tables",
    """
SELECT app_id, child AS table_name FROM {edges} UNION SELECT app_id, parent AS table_name FROM {edges}
""",
)

# Columns of the tables of those databases: one per distinct line of an order.
derive(
    "table_columns",
    """
SELECT DISTINCT l_orderkey AS app_id, 't' || CAST(l_linenumber AS VARCHAR(20)) AS table_name,
       CAST(l_partkey % 4 + 1 AS INTEGER) AS ordinal,
       CASE WHEN l_partkey % 4 = 0 THEN 'id' WHEN l_partkey % 4 = 1 THEN 'created_at'
            WHEN l_partkey % 4 = 2 THEN 'updated_at' ELSE 'seen_at' END AS column_name,
       CASE WHEN l_partkey % 4 = 0 THEN 'bigint' ELSE 'timestamp with time zone' END AS data_type,
       CASE WHEN l_partkey % 4 = 3 OR l_partkey % 4 = 1 THEN 'now()' ELSE NULL END AS default_expr
FROM {lineitem}
""",
)

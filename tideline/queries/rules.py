"""Rule checks, graph operators, text masking and table profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.functions.severity import Thresholds
from tideline.operators import graph, health, rules
from tideline.queries.derived import NOW
from tideline.queries.groups import LINE_EDGE, TABLE_EDGES
from tideline.queries.registry import BASE_TABLES, Inputs, check_table, query
from tideline.session import dealt, materialize, scratch_path
from tideline.sources import catalog, state


def joined(column: str = "reasons"):
    return F.array_join(column, ",").alias(column)


def reason_sql(*pairs: tuple[str, str]) -> str:
    """The check's form of a reason list: names of the conditions that hold, joined by commas."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + ")"


_POLICY_REASONS = reason_sql(
    ("policy <> 'ARCHIVE' AND enabled", "only_archive_can_be_enabled"),
    ("policy = 'ARCHIVE' AND date_column IS NULL", "date_column_not_configured"),
    ("policy = 'ARCHIVE' AND date_column IS NOT NULL AND date_type IS NULL", "date_column_missing"),
    (
        "policy = 'ARCHIVE' AND date_column IS NOT NULL AND date_type NOT IN ('date', 'timestamp', 'timestamp_ntz')",
        "date_column_not_temporal",
    ),
    ("policy = 'ARCHIVE' AND coalesce(key_columns, 0) = 0", "no_primary_key"),
    ("policy = 'ARCHIVE' AND protected_months IS NULL", "protected_period_not_configured"),
    ("policy = 'ARCHIVE' AND protected_months < 1", "protected_period_below_one_month"),
    ("policy = 'ARCHIVE' AND target_rows IS NULL", "target_not_configured"),
    ("policy = 'ARCHIVE' AND target_rows < 1", "target_not_positive"),
    ("policy = 'ARCHIVE' AND grace_days IS NULL", "grace_period_not_configured"),
    ("policy = 'ARCHIVE' AND grace_days < 0", "grace_period_negative"),
    ("policy = 'ARCHIVE' AND coalesce(p.time_zone, app_time_zone) IS NULL", "time_zone_not_configured"),
    (
        "policy = 'ARCHIVE' AND coalesce(archive_format NOT IN ('parquet', 'csv.gz', 'jsonl.gz'), true)",
        "archive_format_unsupported",
    ),
)
check_table(
    "policy_reasons",
    f"""
SELECT p.app_id, p.schema_name, p.table_name, policy, {_POLICY_REASONS} AS reasons
FROM {{policies}} p LEFT JOIN {{policy_context}} c
  ON c.app_id = p.app_id AND c.schema_name = p.schema_name AND c.table_name = p.table_name
""",
)


def validated(inputs: Inputs) -> DataFrame:
    return rules.policy_validation(inputs.policies, inputs.policy_context, None)


@query(
    "policy_validation",
    """
SELECT app_id, schema_name, table_name, policy, reasons,
       CASE WHEN policy = 'ARCHIVE' AND reasons <> '' THEN 'incomplete' ELSE 'active' END AS status
FROM {policy_reasons}
""",
)
def policy_checks(inputs: Inputs) -> DataFrame:
    return validated(inputs).withColumn("reasons", joined())


@query(
    "type_predicate",
    """
SELECT app_id, table_name, date_type FROM {policy_context} WHERE date_type IN ('date', 'timestamp', 'timestamp_ntz')
""",
)
def dated_tables(inputs: Inputs) -> DataFrame:
    context = inputs.policy_context
    return context.where(rules.type_predicate(F.col("date_type"))).select("app_id", "table_name", "date_type")


_PREFLIGHT = reason_sql(
    ("key_columns <> 1", "no_single_column_primary_key"),
    ("root AND date_type IS NULL", "date_column_missing"),
    ("root AND date_type NOT IN ('date', 'timestamp', 'timestamp_ntz')", "date_column_not_temporal"),
    ("NOT reachable", "not_reachable_from_root"),
    ("on_cycle", "cycle"),
)
_WALKS = """
RECURSIVE walks(app_id, node, ancestor) AS (
  SELECT app_id, child, parent FROM {edges}
  UNION SELECT w.app_id, w.node, e.parent FROM walks w JOIN {edges} e ON e.app_id = w.app_id AND e.child = w.ancestor
)
"""
_ROOTS = "roots AS (SELECT app_id, min(table_name) AS root FROM {edge_tables} GROUP BY 1)"
_REACHED = """
reached AS (
  SELECT t.app_id, t.table_name, t.table_name = root OR EXISTS (
    SELECT 1 FROM walks w WHERE w.app_id = t.app_id AND w.node = t.table_name AND w.ancestor = root) AS reachable
  FROM {edge_tables} t JOIN roots r ON r.app_id = t.app_id
)
"""


def graph_edges(inputs: Inputs) -> DataFrame:
    """Edges; written once because every round of a graph operator reads them."""
    edges = inputs.edges.withColumn("child_columns", F.array(F.lit("ref")))
    return materialize(edges.withColumn("parent_columns", F.array(F.lit("id"))), "edges")


def graphs(inputs: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables, roots and edges."""
    edges = graph_edges(inputs)
    ends = F.explode(F.array("child", "parent")).alias("table_name")
    tables = materialize(dealt(edges.select("app_id", ends), "app_id", rows=2 * edges.count()).distinct(), "tables")
    return tables, tables.groupBy("app_id").agg(F.min("table_name").alias("root")), edges


@query("fk_reachability", f"WITH {_WALKS}, {_ROOTS}, {_REACHED} SELECT app_id, table_name, reachable FROM reached")
def reachable(inputs: Inputs) -> DataFrame:
    return graph.reachability(*graphs(inputs), ["app_id"])


_CYCLES = """
cycles AS (
  SELECT a.app_id, a.node AS table_name, min(a.ancestor) AS component FROM walks a
  JOIN walks b ON b.app_id = a.app_id AND b.node = a.ancestor AND b.ancestor = a.node GROUP BY 1, 2
)
"""


@query("fk_cycles", f"WITH {_WALKS}, {_CYCLES} SELECT app_id, table_name, component FROM cycles")
def cycles(inputs: Inputs) -> DataFrame:
    return graph.fk_cycles(graph_edges(inputs), ["app_id"])


@query(
    "removal_order",
    """
WITH RECURSIVE plain AS (SELECT DISTINCT app_id, child, parent FROM {edges} WHERE child <> parent),
walks(app_id, node, ancestor) AS (
  SELECT app_id, child, parent FROM plain
  UNION SELECT w.app_id, w.node, e.parent FROM walks w JOIN plain e ON e.app_id = w.app_id AND e.child = w.ancestor
), cyclic AS (SELECT DISTINCT app_id FROM walks WHERE node = ancestor),
chains(app_id, table_name, depth) AS (
  SELECT app_id, table_name, 0 FROM {edge_tables} WHERE app_id NOT IN (SELECT app_id FROM cyclic)
  UNION SELECT c.app_id, e.parent, c.depth + 1 FROM chains c
  JOIN plain e ON e.app_id = c.app_id AND e.child = c.table_name
)
SELECT app_id, table_name, max(depth) AS round FROM chains GROUP BY 1, 2
""",
)
def order(inputs: Inputs) -> DataFrame:
    tables, _, edges = graphs(inputs)
    return graph.removal_order(tables, edges, ["app_id"])


@query(
    "selection_issues",
    """
WITH marked AS (
  SELECT e.*, child IN ('t1', 't2', 't3', 't5') AS c, parent IN ('t1', 't2', 't3', 't5') AS p FROM {edges} e
)
SELECT app_id, name, child, parent, on_delete,
       CASE WHEN c AND NOT p THEN 'child_without_parent' WHEN on_delete = 'CASCADE' THEN 'unselected_child_cascade'
            WHEN on_delete IN ('SET NULL', 'SET DEFAULT') THEN 'unselected_child_set_null'
            ELSE 'unselected_child_blocks' END AS kind,
       CASE WHEN c AND NOT p THEN 'warning' ELSE 'blocking' END AS severity
FROM marked WHERE c <> p
""",
)
def issues(inputs: Inputs) -> DataFrame:
    tables, _, edges = graphs(inputs)
    chosen = tables.where(F.col("table_name").isin("t1", "t2", "t3", "t5"))
    return graph.selection_issues(edges, chosen, ["app_id"])


check_table(
    "members",
    """
SELECT app_id, table_name, 1 + CASE WHEN app_id % 10 = 0 THEN 1 WHEN app_id % 10 = 1 THEN -1 ELSE 0 END AS key_columns,
       CASE WHEN app_id % 6 = 0 THEN NULL WHEN app_id % 6 = 1 THEN 'string' ELSE 'date' END AS date_type
FROM {edge_tables}
""",
)


def members(inputs: Inputs) -> DataFrame:
    tables, roots, edges = graphs(inputs)
    found = graph.reachability(tables, roots, edges, ["app_id"])
    on_cycle = graph.fk_cycles(edges, ["app_id"]).select("app_id", "table_name").withColumn("_cycle", F.lit(True))
    joined_rows = found.join(on_cycle, ["app_id", "table_name"], "left").join(roots, "app_id")
    app = F.col("app_id")
    return joined_rows.select(
        "app_id", "table_name", "reachable",
        F.when(F.col("table_name") == F.col("root"), "root").otherwise("child").alias("role"),
        (F.lit(1) + F.when(app % 10 == 0, 1).when(app % 10 == 1, -1).otherwise(0)).alias("key_columns"),
        F.when(app % 6 == 0, None).when(app % 6 == 1, "string").otherwise("date").alias("date_type"),
        F.coalesce("_cycle", F.lit(False)).alias("on_cycle"),
    )


_PREFLIGHT_SQL = f"""
WITH {_WALKS}, {_ROOTS}, {_REACHED}, {_CYCLES}, preflight AS (
  SELECT app_id, table_name, {_PREFLIGHT} AS reasons FROM (
    SELECT m.*, r.reachable, m.table_name = o.root AS root, c.table_name IS NOT NULL AS on_cycle
    FROM {{members}} m JOIN reached r ON r.app_id = m.app_id AND r.table_name = m.table_name
    JOIN roots o ON o.app_id = m.app_id
    LEFT JOIN cycles c ON c.app_id = m.app_id AND c.table_name = m.table_name)
)
"""


@query("group_preflight", _PREFLIGHT_SQL + "SELECT app_id, table_name, reasons FROM preflight")
def preflight(inputs: Inputs) -> DataFrame:
    return rules.group_preflight(members(inputs)).select("app_id", "table_name", joined())


@query(
    "blocking_union",
    _PREFLIGHT_SQL
    + """
SELECT app_id, table_name, unnest(string_split(reasons, ',')) AS reason, 'policy' AS source FROM {policy_reasons}
WHERE reasons <> ''
UNION ALL
SELECT app_id, table_name, unnest(string_split(reasons, ',')), 'group' FROM preflight WHERE reasons <> ''
""",
)
def all_reasons(inputs: Inputs) -> DataFrame:
    return rules.blocking_union(("policy", validated(inputs)), ("group", rules.group_preflight(members(inputs))))


_LATEST = """
SELECT job_id, max(verification_id) AS verification_id, arg_max(verified, verification_id) AS verified,
       arg_max(attempt, verification_id) AS verified_attempt, arg_max(verified_at, verification_id) AS verified_at
FROM {verifications} GROUP BY 1
"""
check_table(
    "gated",
    f"""
SELECT j.job_id, j.status, j.mode, j.attempt, environment, verified, verified_attempt, verified_at, j.schema_hash,
       CASE WHEN j.job_id % 25 = 0 THEN 'schema-x' WHEN j.job_id % 26 = 0 THEN NULL ELSE j.schema_hash END
         AS live_schema_hash,
       j.graph_hash, CASE WHEN j.job_id % 27 = 0 THEN 'graph-x' ELSE j.graph_hash END AS live_graph_hash,
       coalesce(intact, false) AS candidate_set_intact, j.job_id % 4 <> 0 AS authorized
FROM {{jobs}} j JOIN {{applications}} a ON a.app_id = j.app_id LEFT JOIN ({_LATEST}) v ON v.job_id = j.job_id
LEFT JOIN (SELECT job_id, bool_and(key_count = row_count) AS intact FROM {{candidates}} GROUP BY 1) c
  ON c.job_id = j.job_id
""",
)


def gated(inputs: Inputs) -> DataFrame:
    """Jobs with everything the removal rules look at."""
    from tideline.operators.jobs import latest_per_key

    runs = inputs.verifications.select(
        "job_id", "verification_id", "verified", F.col("attempt").alias("verified_attempt"), "verified_at"
    )
    intact = inputs.candidates.groupBy("job_id").agg(
        F.bool_and(F.col("key_count") == F.col("row_count")).alias("candidate_set_intact")
    )
    job = F.col("job_id")
    return (
        inputs.jobs.join(inputs.applications.select("app_id", "environment"), "app_id")
        .join(latest_per_key(runs, ["job_id"], ["verification_id"]), "job_id", "left")
        .join(intact, "job_id", "left")
        .withColumn(
            "live_schema_hash",
            F.when(job % 25 == 0, "schema-x").when(job % 26 == 0, None).otherwise(F.col("schema_hash")),
        )
        .withColumn("live_graph_hash", F.when(job % 27 == 0, "graph-x").otherwise(F.col("graph_hash")))
        .withColumn("authorized", job % 4 != 0)
    )


_REMOVAL = reason_sql(
    ("coalesce(environment NOT IN ('synthetic'), true)", "environment_not_allowed"),
    ("coalesce(mode <> 'ARCHIVE_VERIFY_DELETE', true)", "verify_only_job"),
    ("coalesce(status NOT IN ('deletion_approved', 'deleting'), true)", "status_not_approved"),
    ("verified IS NULL", "no_verification"),
    ("NOT verified", "verification_failed"),
    ("verified IS NOT NULL AND coalesce(verified_attempt <> attempt, true)", "verification_of_other_attempt"),
    (
        f"verified IS NOT NULL AND coalesce(verified_at < TIMESTAMP '{NOW}' - INTERVAL 525600 MINUTE, true)",
        "verification_too_old",
    ),
    ("coalesce(live_schema_hash <> schema_hash, true)", "schema_changed"),
    ("coalesce(live_graph_hash <> graph_hash, true)", "graph_changed"),
    ("NOT candidate_set_intact", "candidate_set_damaged"),
    ("NOT coalesce(authorized, false)", "not_authorized"),
)
# Every input of the gate is unknown for some jobs.
_UNKNOWN = (
    ("environment", 31), ("mode", 37), ("status", 41), ("verified_attempt", 43), ("verified_at", 47), ("authorized", 53),
)
_WITH_UNKNOWNS = "SELECT * REPLACE ({}) FROM {{gated}}".format(
    ", ".join(f"CASE WHEN job_id % {n} <> 0 THEN {c} END AS {c}" for c, n in _UNKNOWN)
)


@query(
    "removal_eligibility",
    f"SELECT job_id, reasons, reasons = '' AS allowed FROM (SELECT job_id, {_REMOVAL} AS reasons FROM ({_WITH_UNKNOWNS}))",
)
def eligibility(inputs: Inputs) -> DataFrame:
    jobs = gated(inputs).withColumns({c: F.when(F.col("job_id") % n != 0, F.col(c)) for c, n in _UNKNOWN})
    checked = rules.removal_eligibility(jobs, F.lit(NOW).cast("timestamp_ntz"), ("synthetic",), 525_600, True, False)
    return checked.select("job_id", joined(), "allowed")


_STATE = """
SELECT job_id, status, CASE WHEN mode <> 'ARCHIVE_VERIFY_DELETE' THEN 'blocked'
         WHEN status IN ('ready_for_deletion', 'deletion_approved') THEN 'awaiting_review' ELSE 'not_started' END AS state,
       CASE WHEN verified THEN 'passed' WHEN verified IS NOT NULL THEN 'failed' ELSE 'pending' END AS verification,
       candidate_set_intact AS checksum FROM {gated}
"""


@query(
    "removal_allowed",
    f"""
SELECT job_id, allowed, status = 'ready_for_deletion' AND allowed AND state = 'awaiting_review' AS reviewable
FROM (SELECT *, state <> 'blocked' AND verification = 'passed' AND checksum AS allowed FROM ({_STATE}))
""",
)
def allowed(inputs: Inputs) -> DataFrame:
    state_column = (
        F.when(F.col("mode") != "ARCHIVE_VERIFY_DELETE", "blocked")
        .when(F.col("status").isin("ready_for_deletion", "deletion_approved"), "awaiting_review")
        .otherwise("not_started")
    )
    verification = (
        F.when(F.col("verified"), "passed").when(F.col("verified").isNotNull(), "failed").otherwise("pending")
    )
    rows = F.col("selected_rows")
    gate = rules.removal_allowed(state_column, verification, F.col("candidate_set_intact"), rows, rows)
    return gated(inputs).withColumn("allowed", gate).select(
        "job_id", "allowed",
        rules.removal_reviewable(F.col("status"), F.col("allowed"), state_column).alias("reviewable"),
    )


@query(
    "removal_blockers",
    "SELECT job_id, "
    + reason_sql(
        ("true", "removal_disabled"),
        ("mode <> 'ARCHIVE_VERIFY_DELETE'", "verify_only_job"),
        ("job_id % 5 = 0", "approval_policy_incomplete"),
        ("job_id % 7 = 0", "kill_switch_on"),
        ("NOT coalesce(verified, false)", "verification_not_passed"),
    )
    + " AS reasons FROM {gated}",
)
def blockers(inputs: Inputs) -> DataFrame:
    gaps = F.when(F.col("job_id") % 5 == 0, F.array(F.lit("required_approvers"))).otherwise(
        F.array().cast("array<string>")
    )
    found = rules.removal_blockers(F.col("mode"), F.col("verified"), gaps, F.col("job_id") % 7 == 0)
    return gated(inputs).select("job_id", F.array_join(found, ",").alias("reasons"))


@query(
    "schema_drift",
    """
SELECT job_id, coalesce(schema_hash <> live_schema_hash, true) AS schema_changed,
       coalesce(graph_hash <> live_graph_hash, true) AS graph_changed FROM {gated}
""",
)
def drift(inputs: Inputs) -> DataFrame:
    jobs = gated(inputs)
    current = jobs.select(
        "job_id", F.col("live_schema_hash").alias("schema_hash"), F.col("live_graph_hash").alias("graph_hash")
    )
    return rules.schema_drift(jobs.select("job_id", "schema_hash", "graph_hash"), current, ("job_id",))


check_table(
    "schedulable",
    """
SELECT p.*, coalesce(p.time_zone, a.time_zone) AS zone, p.app_id % 18 <> 0 AS storage_available,
       CASE WHEN p.app_id % 3 = 0 THEN 'passed' WHEN p.app_id % 3 = 1 THEN 'failed' ELSE 'none' END
         AS previous_verification,
       active_job, CASE WHEN capacity_mb = 0 THEN 'UNKNOWN' ELSE 'NONE' END AS capacity_level,
       a.enabled AS credentials_valid
FROM {policies} p JOIN {applications} a ON a.app_id = p.app_id
LEFT JOIN (SELECT app_id, group_root, min(job_id) AS active_job FROM {jobs}
           WHERE status NOT IN ('completed', 'completed_with_exceptions', 'failed', 'cancelled', 'requires_review')
           GROUP BY 1, 2) j
  ON j.app_id = p.app_id AND j.group_root = p.schema_name || '.' || p.table_name
""",
)


@query(
    "schedule_eligibility",
    "SELECT app_id, schema_name, table_name, "
    + reason_sql(
        ("NOT (policy = 'ARCHIVE' AND enabled)", "policy_not_enabled_archive"),
        ("policy = 'ARCHIVE' AND enabled AND date_column IS NULL", "date_column_not_configured"),
        ("policy = 'ARCHIVE' AND enabled AND protected_months IS NULL", "protected_period_not_configured"),
        ("policy = 'ARCHIVE' AND enabled AND target_rows IS NULL", "target_not_configured"),
        ("grace_days IS NULL", "grace_period_not_configured"),
        ("zone IS NULL", "time_zone_not_configured"),
        ("NOT storage_available", "storage_unavailable"),
        ("previous_verification = 'failed'", "previous_verification_failed"),
        ("previous_verification = 'none'", "no_previous_verification"),
        ("active_job IS NOT NULL", "active_job_for_group"),
        ("capacity_level = 'UNKNOWN'", "capacity_unknown"),
        ("NOT credentials_valid", "credentials_invalid"),
    )
    + " AS reasons FROM {schedulable}",
)
def schedule(inputs: Inputs) -> DataFrame:
    from tideline.operators.jobs import TERMINAL_STATES

    app = F.col("app_id")
    applications = inputs.applications.select(
        "app_id", F.col("time_zone").alias("_zone"), "capacity_mb", F.col("enabled").alias("credentials_valid")
    )
    running = (
        inputs.jobs.where(~F.col("status").isin(*TERMINAL_STATES))
        .groupBy("app_id", F.col("group_root").alias("_name"))
        .agg(F.min("job_id").alias("active_job"))
    )
    candidates = (
        inputs.policies.withColumn("_name", F.concat_ws(".", "schema_name", "table_name"))
        .join(applications, "app_id")
        .join(running, ["app_id", "_name"], "left")
        .withColumn("time_zone", F.coalesce("time_zone", "_zone"))
        .withColumn("storage_available", app % 18 != 0)
        .withColumn(
            "previous_verification", F.when(app % 3 == 0, "passed").when(app % 3 == 1, "failed").otherwise("none")
        )
        .withColumn("capacity_level", F.when(F.col("capacity_mb") == 0, "UNKNOWN").otherwise("NONE"))
    )
    return rules.schedule_eligibility(candidates, True).select("app_id", "schema_name", "table_name", joined())


check_table(
    "settings",
    """
SELECT app_id, CASE WHEN app_id % 5 = 0 THEN NULL ELSE 2 END AS required_approvers,
       CASE WHEN app_id % 6 = 0 THEN NULL ELSE 60 END AS approval_validity_minutes,
       CASE WHEN app_id % 7 = 0 THEN NULL ELSE true END AS excludes_creator,
       CASE WHEN app_id % 8 = 0 THEN NULL ELSE 30 END AS authorization_validity_minutes,
       CASE WHEN app_id % 9 = 0 THEN NULL ELSE '22:00' END AS removal_window,
       CASE WHEN app_id % 15 <> 0 THEN app_id % 100 - 3 END AS low, 40 + app_id % 50 AS medium, 60 + app_id % 20 AS high,
       app_id % 71 AS capacity_low, 50 + app_id % 30 AS capacity_medium, 60 + app_id % 45 AS capacity_high
FROM {applications}
""",
)


def settings(inputs: Inputs) -> DataFrame:
    app = F.col("app_id")

    def unless(n: int, value) -> object:
        return F.when(app % n != 0, F.lit(value))

    return inputs.applications.select(
        "app_id", unless(5, 2).alias("required_approvers"), unless(6, 60).alias("approval_validity_minutes"),
        unless(7, True).alias("excludes_creator"), unless(8, 30).alias("authorization_validity_minutes"),
        unless(9, "22:00").alias("removal_window"), F.when(app % 15 != 0, app % 100 - 3).alias("low"), (40 + app % 50).alias("medium"),
        (60 + app % 20).alias("high"), (app % 71).alias("capacity_low"), (50 + app % 30).alias("capacity_medium"),
        (60 + app % 45).alias("capacity_high"),
    )


@query(
    "approval_policy_gaps",
    "SELECT app_id, "
    + reason_sql(*((f"{n} IS NULL", n) for n in (
        "required_approvers", "approval_validity_minutes", "excludes_creator", "authorization_validity_minutes",
        "removal_window",
    )))
    + " AS gaps FROM {settings}",
)
def gaps(inputs: Inputs) -> DataFrame:
    return rules.approval_policy_gaps(settings(inputs)).select("app_id", joined("gaps"))


@query(
    "threshold_order_check",
    "SELECT app_id, "
    + reason_sql(
        ("NOT coalesce(low > 0, false)", "low_not_positive"),
        ("NOT coalesce(medium > low, false)", "medium_not_above_low"),
        ("NOT coalesce(high > medium, false)", "high_not_above_medium"),
        (
            "NOT (capacity_low > 0 AND capacity_low < capacity_medium AND capacity_medium < capacity_high "
            "AND capacity_high <= 100)",
            "capacity_levels_not_rising",
        ),
    )
    + " AS reasons FROM {settings}",
)
def threshold_orders(inputs: Inputs) -> DataFrame:
    return rules.threshold_order_check(settings(inputs)).select("app_id", joined())


@query(
    "ui_policy_map",
    """
SELECT app_id, schema_name, table_name, policy AS code,
       CASE policy WHEN 'ARCHIVE' THEN 'archive' WHEN 'DO_NOT_ARCHIVE' THEN 'dont_archive' ELSE 'review_required' END
         AS shown
FROM {policies}
""",
)
def shown_policies(inputs: Inputs) -> DataFrame:
    named = inputs.policies.withColumn("shown", health.policy_name(F.col("policy")))
    return named.select(*health.TABLE_KEY, health.policy_code(F.col("shown")).alias("code"), "shown")


_ARCHIVE_HINTS = reason_sql(
    (
        "key_columns = 1 AND date_candidates > 0 AND (table_name LIKE '%log%' OR table_name LIKE '%attendance%')",
        "event_like_name",
    ),
    ("key_columns = 1 AND date_candidates > 0 AND estimated_rows >= 100000", "large"),
)


@query("archive_hints", f"SELECT app_id, table_name, {_ARCHIVE_HINTS} AS hints FROM {{tables}}")
def hints(inputs: Inputs) -> DataFrame:
    counted = inputs.tables.withColumn("row_count", F.col("estimated_rows"))
    return rules.archive_hints(counted).select("app_id", "table_name", joined("hints"))


# Keys between the tables of an application: order items and attendance point at orders and members.
check_table(
    "table_edges",
    """
SELECT app_id, table_name AS child, 'orders' AS parent FROM {tables} WHERE table_name IN ('order_items', 'audit_logs')
UNION ALL
SELECT app_id, table_name, 'members' FROM {tables} WHERE table_name = 'attendance_records'
""",
)


def table_edges(inputs: Inputs) -> DataFrame:
    name = F.col("table_name")
    parent = F.when(name.isin("order_items", "audit_logs"), "orders").when(name == "attendance_records", "members")
    return inputs.tables.select("app_id", name.alias("child"), parent.alias("parent")).where("parent IS NOT NULL")


_PROTECTION_HINTS = reason_sql(
    ("children > 0 AND date_candidates = 0", "referenced_master_data"),
    ("children > 0 AND date_candidates > 0", "parent_of_others"),
    ("key_columns = 0", "no_primary_key"),
    ("key_columns > 1", "composite_primary_key"),
    ("table_name = 'members'", "identity_like_name"),
)
_WITH_CHILDREN = """
SELECT t.*, coalesce(n, 0) AS children FROM {tables} t
LEFT JOIN (SELECT app_id, parent, count(*) AS n FROM {table_edges} GROUP BY 1, 2) e
  ON e.app_id = t.app_id AND e.parent = t.table_name"""


@query(
    "protection_hints",
    f"SELECT app_id, table_name, children, {_PROTECTION_HINTS} AS hints FROM (" + _WITH_CHILDREN + ")",
)
def protections(inputs: Inputs) -> DataFrame:
    found = rules.protection_hints(inputs.tables, table_edges(inputs))
    return found.select("app_id", "table_name", "children", joined("hints"))


# --- text --------------------------------------------------------------------------------------------------

_WS = r"\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_MASKED = "text"
for _pattern, _replacement in (
    (rf"(?i)(postgres(?:ql)?://[^:{_WS}/@]+:)[^@{_WS}]+@", r"\1[REDACTED]@"),
    (rf"(?i)\bBearer[{_WS}]+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "[REDACTED_JWT]"),
    (r"\bsb_(secret|publishable)_[A-Za-z0-9_-]+", "[REDACTED_SUPABASE_KEY]"),
    (
        r"(?i)\b(password|passwd|pwd|secret|token|api[_-]?key|service[_-]?role[_-]?key|authorization)"
        + rf"""[{_WS}]*[=:][{_WS}]*("[^"]*"|''[^'']*''|[^{_WS},;]+)""",
        r"\1=[REDACTED]",
    ),
):
    _MASKED = f"regexp_replace({_MASKED}, '{_pattern}', '{_replacement}', 'g')"


@query(
    "redact_text",
    f"""
SELECT doc_id, {_MASKED} AS redacted FROM {{documents}}
""",
)
def masked(inputs: Inputs) -> DataFrame:
    return inputs.documents.select("doc_id", text.redact(F.col("text")).alias("redacted"))


@query(
    "redact_whole_text",
    f"SELECT doc_id, md5({_MASKED}) AS digest FROM {{documents}}",
)
def masked_whole(inputs: Inputs) -> DataFrame:
    """Digests of the masked texts."""
    return inputs.documents.select("doc_id", F.md5(text.redact(F.col("text"))).alias("digest"))


@query(
    "allow_list_fields",
    "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM {events}",
)
def listed_fields(inputs: Inputs) -> DataFrame:
    kept = text.allow_list_fields(F.col("props"), {"k": "bigint"})
    return inputs.events.select("event_id", kept.alias("kept")).select("event_id", "kept.k")


@query(
    "pii_key_guard",
    """
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'email' WHEN user_id % 3 = 1 THEN 'table_name' ELSE '' END AS forbidden
FROM {events}
""",
)
def guarded_keys(inputs: Inputs) -> DataFrame:
    name = F.when(F.col("user_id") % 3 == 0, "email").when(F.col("user_id") % 3 == 1, "table_name").otherwise("rows")
    facts = F.create_map(name, F.col("user_id").cast("string"), F.lit("event"), F.col("event_type"))
    return inputs.events.select("event_id", F.array_join(text.forbidden_facts(facts), ",").alias("forbidden"))


# --- profiles ----------------------------------------------------------------------------------------------

KEYS = {
    "orders": ("o_orderkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "events": ("event_id",), "documents": ("doc_id",), "nation": ("n_nationkey",), "region": ("r_regionkey",),
    "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",),
}
# Date column and number of columns of every table, as the checks state them.
_SHAPES = {
    "orders": ("o_orderdate", 6), "lineitem": ("l_shipdate", 11), "customer": ("", 5), "supplier": ("", 4), "part": ("", 6),
    "events": ("ts", 6), "documents": ("", 5), "nation": ("", 3), "region": ("", 2), "embeddings": ("", 3), "pages": ("", 3),
    "benchmark": ("", 2), "labels": ("", 3), "conversations": ("", 4),
}


def _shape_sql(table: str) -> str:
    day, columns = _SHAPES[table]
    low, high = (f"CAST({f}({day}) AS VARCHAR)" if day else "NULL" for f in ("min", "max"))
    key = ",".join(KEYS.get(table, ()))
    return (
        f"SELECT '{table}' AS table_name, '{key}' AS primary_key, {columns} AS columns, '{day}' AS date_candidates, "
        f"count(*) AS row_count, {low} AS oldest, {high} AS newest FROM {{{table}}}"
    )


@query("catalog_join", " UNION ALL ".join(map(_shape_sql, BASE_TABLES)))
def profiles(inputs: Inputs) -> DataFrame:
    paths = {t: inputs.path(t) for t in BASE_TABLES}
    found = catalog.profile_catalog(inputs.spark, paths, KEYS)
    return found.select(
        "table_name", F.array_join("primary_key", ",").alias("primary_key"), "columns",
        F.array_join("date_candidates", ",").alias("date_candidates"), "row_count", "oldest", "newest",
    )


@query(
    "estimate_then_exact",
    "SELECT table_name, n AS estimated_rows, "
    "CASE WHEN n <= 20000 OR abs(n - 500000) <= 25000 OR abs(n - 600000) <= 30000 OR abs(n - 700000) <= 35000 THEN n END "
    "AS exact_rows FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {{{t}}}" for t in BASE_TABLES)
    + ")",
)
def estimates(inputs: Inputs) -> DataFrame:
    paths = {t: inputs.path(t) for t in BASE_TABLES}
    return catalog.estimate_then_exact(inputs.spark, paths, Thresholds(500_000, 600_000, 700_000), 20_000)


@query(
    "insertion_column",
    """
WITH stamped AS (SELECT * FROM {table_columns} WHERE data_type LIKE 'timestamp%' AND default_expr = 'now()')
SELECT a.app_id, a.table_name, coalesce(max(s.column_name) FILTER (s.column_name = 'created_at'),
       CASE WHEN count(s.column_name) = 1 THEN min(s.column_name) END) AS insertion_column
FROM (SELECT DISTINCT app_id, table_name FROM {table_columns}) a
LEFT JOIN stamped s ON s.app_id = a.app_id AND s.table_name = a.table_name GROUP BY 1, 2
""",
)
def stamps(inputs: Inputs) -> DataFrame:
    return catalog.insertion_columns(inputs.table_columns, ["app_id", "table_name"])


@query(
    "archive_report",
    "SELECT app_id, schema_name, table_name, estimated_rows AS row_count, growth_status, avg_per_day, children, "
    + _ARCHIVE_HINTS + " AS archive_hints, " + _PROTECTION_HINTS + " AS hints FROM (" + _WITH_CHILDREN + ")",
)
def report(inputs: Inputs) -> DataFrame:
    """The profile of every table with its hints, written as a table and read back."""
    path = scratch_path(inputs.spark, "report")
    counted = inputs.tables.withColumn("row_count", F.col("estimated_rows"))
    hinted = rules.archive_hints(counted).withColumnRenamed("hints", "archive_hints")
    rules.protection_hints(hinted, table_edges(inputs)).write.parquet(path)
    return inputs.spark.read.parquet(path).select(
        *health.TABLE_KEY, "row_count", "growth_status", "avg_per_day", "children", joined("archive_hints"), joined("hints")
    )


@query(
    "edge_discovery",
    """
SELECT 'lineitem_order' AS name, (SELECT count(*) FROM {lineitem}) AS child_rows, 0 AS null_keys,
       (SELECT count(*) FROM {lineitem} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {orders})) AS orphans,
       0 AS repeated_parent_keys
UNION ALL SELECT 'line_order', (SELECT count(*) FROM {live_lines}), 0,
       (SELECT count(*) FROM {live_lines} WHERE order_id NOT IN (SELECT o_orderkey FROM {live_orders})), 0
UNION ALL SELECT 'order_customer', (SELECT count(*) FROM {orders}), 0,
       (SELECT count(*) FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer})), 0
""",
)
def edges_by_data(inputs: Inputs) -> DataFrame:
    """Stated foreign keys, checked against the rows."""
    checked = (
        (TABLE_EDGES[0], inputs.lineitem, inputs.orders),
        (LINE_EDGE, inputs.live_lines, inputs.live_orders),
        (TABLE_EDGES[1], inputs.orders, inputs.customer),
    )
    merged = None
    for edge, child, parent in checked:
        part = graph.check_edge_data(child, edge.child_columns[0], parent, edge.parent_columns[0])
        part = part.withColumn("name", F.lit(edge.name))
        merged = part if merged is None else merged.unionByName(part)
    return merged


# --- state -------------------------------------------------------------------------------------------------


@query(
    "new_tables",
    """
SELECT app_id, schema_name, table_name, 'REVIEW_REQUIRED' AS policy, false AS enabled FROM {tables} t
WHERE NOT EXISTS (SELECT 1 FROM {policies} p WHERE p.app_id = t.app_id AND p.schema_name = t.schema_name
                  AND p.table_name = t.table_name)
""",
)
def fresh(inputs: Inputs) -> DataFrame:
    return catalog.new_tables(inputs.tables, inputs.policies, health.TABLE_KEY)


@query(
    "vanished_tables",
    """
SELECT app_id, schema_name, table_name, false AS is_present FROM {policies} p
WHERE NOT EXISTS (SELECT 1 FROM {tables} t WHERE t.app_id = p.app_id AND t.schema_name = p.schema_name
                  AND t.table_name = p.table_name AND t.is_present)
""",
)
def vanished(inputs: Inputs) -> DataFrame:
    return catalog.vanished_tables(inputs.policies, inputs.tables.where("is_present"), health.TABLE_KEY)




def captured(inputs: Inputs) -> DataFrame:
    rows = F.floor("o_totalprice").cast("long")
    return inputs.orders.select(
        F.col("o_custkey").alias("app_id"), F.trunc(F.col("o_orderdate"), "YYYY").cast("date").alias("captured_on"),
        F.col("o_orderkey").alias("captured_at"),
        F.when(F.col("o_orderkey") % 3 != 0, rows).alias("exact_rows"), (rows * 2).alias("estimated_rows"),
    )


@query(
    "upsert_state",
    """
SELECT app_id, CAST(captured_on AS VARCHAR) AS captured_on, max(captured_at) AS captured_at,
       arg_max(exact_rows, captured_at) FILTER (exact_rows IS NOT NULL) AS exact_rows,
       arg_max(estimated_rows, captured_at) AS estimated_rows
FROM (SELECT o_custkey AS app_id, CAST(date_trunc('year', o_orderdate) AS DATE) AS captured_on,
             o_orderkey AS captured_at,
             CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS exact_rows,
             CAST(floor(o_totalprice) AS BIGINT) * 2 AS estimated_rows FROM {orders})
GROUP BY 1, 2
""",
)
def upserted(inputs: Inputs) -> DataFrame:
    rows = captured(inputs)
    keys = ["app_id", "captured_on"]
    earlier = F.col("captured_at") < inputs.orders.count() // 2
    old = state.latest_wins(rows.where(earlier), keys, ["captured_at"], ["exact_rows"])
    return state.upsert_state(old, rows.where(~earlier), keys, "captured_at", ["exact_rows"])


@query("append_audit", "SELECT event_id, event_type AS action, user_id AS actor FROM {events}")
def appended(inputs: Inputs) -> DataFrame:
    path = scratch_path(inputs.spark, "audit")
    entries = inputs.events.select("event_id", F.col("event_type").alias("action"), F.col("user_id").alias("actor"))
    half = F.col("actor") % 2 == 0
    state.append_log(entries.where(half), path)
    state.append_log(entries.where(~half), path)
    return inputs.spark.read.parquet(path)

"""Rule checks, jobs, approvals and profiles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.functions.severity import Thresholds
from tideline.operators import jobs, rollups, rules
from tideline.sources import catalog, state

POLICY = (
    "app_id int, schema_name string, table_name string, policy string, date_column string, protected_months int, "
    "target_rows long, grace_days int, archive_format string, time_zone string, enabled boolean"
)
CONTEXT = "app_id int, schema_name string, table_name string, key_columns int, date_type string, app_time_zone string"
GOOD = dict(policy="ARCHIVE", date_column="d", protected_months=6, target_rows=1000, grace_days=7,
            archive_format="csv.gz", time_zone=None, enabled=True)


def check(spark, default_grace=None, key_columns=1, date_type="date", zone="UTC", **changes):
    values = {"app_id": 1, "schema_name": "public", "table_name": "t", **GOOD, **changes}
    policies = spark.createDataFrame([tuple(values[c.split()[0]] for c in POLICY.split(", "))], POLICY)
    context = spark.createDataFrame([(1, "public", "t", key_columns, date_type, zone)], CONTEXT)
    row = rules.policy_validation(policies, context, default_grace).first()
    return row["reasons"], row["status"]


@pytest.mark.parametrize(
    "changes, reasons",
    [
        ({}, []),
        ({"policy": "REVIEW_REQUIRED"}, ["only_archive_can_be_enabled"]),
        ({"policy": "DO_NOT_ARCHIVE", "enabled": False, "date_column": None}, []),
        ({"date_column": None}, ["date_column_not_configured"]),
        ({"date_type": None}, ["date_column_missing"]),
        ({"date_type": "string"}, ["date_column_not_temporal"]),
        ({"key_columns": 0}, ["no_primary_key"]),
        ({"protected_months": None, "target_rows": 0}, ["protected_period_not_configured", "target_not_positive"]),
        ({"protected_months": 0, "target_rows": None}, ["protected_period_below_one_month", "target_not_configured"]),
        ({"grace_days": None}, ["grace_period_not_configured"]),
        ({"grace_days": None, "default_grace": 7}, []),
        ({"grace_days": -1}, ["grace_period_negative"]),
        ({"zone": None}, ["time_zone_not_configured"]),
        ({"zone": None, "time_zone": "UTC"}, []),
        ({"archive_format": "xlsx"}, ["archive_format_unsupported"]),
    ],
)
def test_policy_reasons(spark, changes, reasons):
    found, status = check(spark, **changes)
    assert found == reasons
    incomplete = reasons and changes.get("policy", "ARCHIVE") == "ARCHIVE"
    assert status == ("incomplete" if incomplete else "active")


def test_removal_reasons(spark):
    now = F.lit("2026-09-30 06:00:00").cast("timestamp_ntz")
    schema = (
        "job_id int, environment string, mode string, status string, attempt int, verified boolean, verified_attempt int, "
        "verified_at timestamp_ntz, schema_hash string, live_schema_hash string, graph_hash string, live_graph_hash string, "
        "candidate_set_intact boolean, authorized boolean"
    )
    fresh = dt.datetime(2026, 9, 30, 5, 30)
    good = (1, "synthetic", "ARCHIVE_VERIFY_DELETE", "deletion_approved", 1, True, 1, fresh, "s", "s", "g", "g", True, True)
    old = list(good)
    old[0], old[7], old[9], old[6] = 2, dt.datetime(2026, 9, 29), None, 3
    bad = (3, "production", "ARCHIVE_AND_VERIFY_ONLY", "failed", 1, None, None, None, None, "s", "g", "h", None, None)
    rows = spark.createDataFrame([good, tuple(old), bad], schema)
    got = {r["job_id"]: r for r in rules.removal_eligibility(rows, now, ("synthetic",), 60, True, False).collect()}
    assert got[1]["allowed"] and got[1]["reasons"] == []
    assert got[2]["reasons"] == ["verification_of_other_attempt", "verification_too_old", "schema_changed"]
    assert got[3]["reasons"] == [
        "environment_not_allowed", "verify_only_job", "status_not_approved", "no_verification", "schema_changed",
        "graph_changed", "candidate_set_damaged", "not_authorized",
    ]
    off = rules.removal_eligibility(rows, now, ("synthetic",), 60, False, True).where("job_id = 1").first()
    assert off["reasons"] == ["removal_disabled", "kill_switch_on"]


def test_removal_is_never_allowed_by_an_unknown(spark):
    rows = spark.createDataFrame(
        [("awaiting_review", "passed", True, 5, 5), ("awaiting_review", "passed", None, 5, 5),
         ("awaiting_review", "passed", True, None, 5), ("blocked", "passed", True, 5, 5),
         ("awaiting_review", "failed", True, 5, 5), ("awaiting_review", "passed", True, 4, 5)],
        "state string, verification string, checksum boolean, verified int, expected int",
    )
    allowed = rules.removal_allowed(*(F.col(c) for c in rows.columns))
    assert [r[0] for r in rows.select(allowed).collect()] == [True, False, False, False, False, False]


def test_approvals(spark):
    now = F.lit("2026-09-30 06:00:00").cast("timestamp_ntz")
    late, early = dt.datetime(2026, 10, 1), dt.datetime(2026, 9, 1)
    rows = [
        (1, "a", "approve", None, late, "m"), (2, "a", "approve", None, late, "m"), (3, "b", "approve", None, late, "m"),
        (4, "c", "approve", early, late, "m"), (5, "c", "approve", None, early, "m"), (6, "c", "approve", None, None, "m"),
        (7, "c", "approve", None, late, "other"), (8, "idle", "approve", None, late, "m"),
        (9, "creator", "approve", None, late, "m"), (10, "stranger", "approve", None, late, "m"),
    ]
    schema = "approval_id int, operator_id string, decision string, revoked_at timestamp_ntz, expires_at timestamp_ntz, manifest_sha256 string"
    approvals = spark.createDataFrame(rows, schema).selectExpr(
        "1 AS job_id", "1 AS attempt", "*", "'s' AS schema_hash", "'g' AS graph_hash", "'d' AS candidate_digest"
    )
    evidence = spark.sql(
        "SELECT 1 AS job_id, 1 AS attempt, 'creator' AS created_by, 'm' AS manifest_sha256, 's' AS schema_hash, 'g' AS graph_hash, 'd' AS candidate_digest"
    )
    operators = spark.createDataFrame(
        [("a", True, True), ("b", True, True), ("c", True, True), ("idle", False, True), ("creator", True, True)],
        "operator_id string, active boolean, can_approve boolean",
    )
    decided = jobs.why_not_counted(approvals, operators, evidence, now)
    got = {r["approval_id"]: r["reason"] for r in decided.collect()}
    assert got == {
        1: None, 2: None, 3: None, 4: "revoked", 5: "expired", 6: "expired", 7: "evidence_changed",
        8: "approver_role_missing", 9: "creator_may_not_approve", 10: "approver_role_missing",
    }
    row = jobs.approval_quorum(decided, 2).first()
    assert (row["valid_approvals"], row["rejected"], row["quorum_met"]) == (2, False, True)
    against = approvals.where("approval_id = 1").withColumn("decision", F.lit("reject")).withColumn("approval_id", F.lit(11))
    row = jobs.approval_quorum(jobs.why_not_counted(approvals.unionByName(against), operators, evidence, now), 2).first()
    assert (row["rejected"], row["quorum_met"]) == (True, False)


def test_hot_operator_counts_once(spark):
    """One operator owns most of the decisions of one job."""
    decided = spark.sql(
        """SELECT 1 AS job_id, 1 AS attempt, CASE WHEN id < 9000 THEN 0 ELSE id % 50 END AS operator_id,
                  CAST(NULL AS STRING) AS reason, false AS live_rejection FROM range(10000)"""
    )
    assert jobs.approval_quorum(decided, 2).first()["valid_approvals"] == 50


def test_progress_and_classes(spark):
    rows = spark.createDataFrame([("deleting", 3, 8), ("deleting", 0, 0), ("completed", 0, 0), ("unknown", 1, 2)],
                                 "status string, done int, total int")
    pct = jobs.progress_pct(F.col("status"), F.col("done"), F.col("total"))
    assert [r[0] for r in rows.select(pct).collect()] == [73, 70, 100, 0]
    counts = jobs.job_counts(rows).first()
    assert (counts["all_jobs"], counts["active_jobs"], counts["completed_jobs"]) == (4, 2, 1)


def test_group_policies(spark):
    rows = spark.createDataFrame(
        [(1, "public", "orders", "ARCHIVE", True, None), (1, "public", "items", "ARCHIVE", True, "public.orders"),
         (1, "public", "notes", "ARCHIVE", False, "public.orders"), (1, "public", "logs", "ARCHIVE", True, None),
         (1, "public", "users", "REVIEW_REQUIRED", False, None)],
        "app_id int, schema_name string, table_name string, policy string, enabled boolean, group_root string",
    )
    got = {r["group_root"]: (r["members"], r["members_ready"]) for r in jobs.group_policies(rows).collect()}
    assert got == {"public.orders": (2, False), "public.logs": (0, True)}


def test_insertion_columns(spark):
    rows = spark.createDataFrame(
        [("a", "created_at", 1, "timestamp with time zone", "now()"), ("a", "updated_at", 2, "timestamp with time zone", "now()"),
         ("b", "x", 1, "timestamp without time zone", "CURRENT_TIMESTAMP"), ("b", "y", 2, "date", "now()"),
         ("c", "x", 1, "timestamp with time zone", "now()"), ("c", "y", 2, "timestamp with time zone", "clock_timestamp()"),
         ("d", "x", 1, "timestamp with time zone", None)],
        "t string, column_name string, ordinal int, data_type string, default_expr string",
    )
    got = {r["t"]: r["insertion_column"] for r in catalog.insertion_columns(rows, ["t"]).collect()}
    assert got == {"a": "created_at", "b": "x", "c": None, "d": None}


def test_estimates_come_first(spark, folder):
    spark.range(50_000).repartition(4).write.parquet(f"{folder}/big")
    spark.range(100).write.parquet(f"{folder}/small")
    spark.range(30_500).repartition(3).write.parquet(f"{folder}/close")
    paths = {t: f"{folder}/{t}" for t in ("big", "small", "close")}
    rows = catalog.estimate_then_exact(spark, paths, Thresholds(30_000, 90_000, 99_000), 1_000).collect()
    got = {r["table_name"]: r for r in rows}
    assert got["big"]["exact_rows"] is None and abs(got["big"]["estimated_rows"] - 50_000) < 2_500
    assert got["small"]["exact_rows"] == 100 and got["close"]["exact_rows"] == 30_500


def test_profiles(spark, folder):
    spark.sql("SELECT id, TIMESTAMP_NTZ '2025-01-02 00:00:00' AS a, DATE '2024-05-05' AS b FROM range(7)").write.parquet(f"{folder}/t")
    row = catalog.profile_catalog(spark, {"t": f"{folder}/t"}, {"t": ("id",)}).first()
    assert (row["row_count"], row["date_candidates"], row["primary_key"]) == (7, ["a", "b"], ["id"])
    assert (row["oldest"], row["newest"]) == (dt.datetime(2024, 5, 5), dt.datetime(2025, 1, 2)) and row["total_bytes"] > 0


def test_upsert_keeps_the_last_known_count(spark):
    schema = "t string, at int, exact_rows long, estimated_rows long"
    old = spark.createDataFrame([("a", 1, 10, 11), ("b", 1, 5, 6)], schema)
    new = spark.createDataFrame([("a", 2, None, 20), ("c", 2, 1, 1), ("b", 1, 7, 8)], schema)
    got = {r["t"]: tuple(r)[1:] for r in state.upsert_state(old, new, ["t"], "at", ["exact_rows"]).collect()}
    assert got == {"a": (2, 10, 20), "b": (1, 7, 8), "c": (2, 1, 1)}


def test_deltas_compact(spark, folder):
    schema = spark.createDataFrame([], "t string, at int, n long").schema
    for batch, rows in enumerate(([("a", 1, 1), ("b", 1, 1)], [("a", 2, 5)], [("a", 2, 6)])):
        state.write_delta(spark.createDataFrame(rows, schema), f"{folder}/s", batch)
    now = state.current_state(spark, f"{folder}/s", schema, ["t"], "at")
    assert {r["t"]: r["n"] for r in now.collect()} == {"a": 6, "b": 1}
    state.compact_state(spark, f"{folder}/s", f"{folder}/c", schema, ["t"], "at")
    assert {r["t"]: r["n"] for r in state.read_deltas(spark, f"{folder}/c", schema).collect()} == {"a": 6, "b": 1}


def test_newest_breaks_ties_by_id(spark):
    rows = spark.sql("SELECT id, id DIV 10 AS at FROM range(100)")
    assert [r["id"] for r in rollups.newest(rows, "at", "id", 3).collect()] == [99, 98, 97]


def test_hints(spark):
    rows = spark.createDataFrame(
        [(1, "audit_logs", 1, 1, 200_000), (1, "app_events", 2, 1, 5), (1, "user_profiles", 0, 0, 5), (1, "orders", 1, 1, 5)],
        "app_id int, table_name string, key_columns int, date_candidates int, row_count long",
    )
    got = {r["table_name"]: r["hints"] for r in rules.archive_hints(rows).collect()}
    assert got == {"audit_logs": ["event_like_name", "large"], "app_events": [], "user_profiles": [], "orders": []}
    edges = spark.createDataFrame([(1, "audit_logs", "orders"), (1, "x", "user_profiles"), (1, "orders", "orders")],
                                  "app_id int, child string, parent string")
    got = {r["table_name"]: r["hints"] for r in rules.protection_hints(rows, edges).collect()}
    assert got["orders"] == ["parent_of_others"]
    assert got["user_profiles"] == ["referenced_master_data", "no_primary_key", "identity_like_name"]
    assert got["app_events"] == ["composite_primary_key"]


GATE = (
    "environment string, mode string, status string, attempt int, verified boolean, verified_attempt int, "
    "verified_at timestamp_ntz, schema_hash string, live_schema_hash string, graph_hash string, live_graph_hash string, "
    "candidate_set_intact boolean, authorized boolean"
)
GATE_OK = (
    "synthetic", "ARCHIVE_VERIFY_DELETE", "deletion_approved", 1, True, 1, dt.datetime(2001, 8, 15, 5), "s", "s", "g", "g",
    True, True,
)


def test_no_unknown_value_opens_the_removal_gate(spark):
    names = [c.split()[0] for c in GATE.split(", ")]
    rows = [GATE_OK] + [tuple(None if i == j else v for j, v in enumerate(GATE_OK)) for i in range(len(GATE_OK))]
    jobs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, " + GATE)
    now = F.lit("2001-08-15 06:00:00").cast("timestamp_ntz")
    checked = rules.removal_eligibility(jobs, now, ("synthetic",), 120, True, False).orderBy("n").collect()
    assert checked[0].allowed and not any(r.allowed for r in checked[1:]), [names[r.n - 1] for r in checked[1:] if r.allowed]


def test_other_refusals_close_on_unknown_values(spark):
    members = spark.createDataFrame(
        [("child", 1, "date", True, False)] + [("child", None, "date", True, False), ("child", 1, None, None, False), ("child", 1, "date", True, None), (None, 1, None, True, False)],
        "role string, key_columns int, date_type string, reachable boolean, on_cycle boolean",
    )
    assert [bool(r.reasons) for r in rules.group_preflight(members).collect()] == [False, True, True, True, True]
    limits = "low int, medium int, high int, capacity_low int, capacity_medium int, capacity_high int"
    full = (1, 2, 3, 10, 20, 30)
    settings = spark.createDataFrame([full] + [tuple(None if i == j else v for j, v in enumerate(full)) for i in range(6)], limits)
    assert [bool(r.reasons) for r in rules.threshold_order_check(settings).collect()] == [False] + [True] * 6
    planned = "policy string, enabled boolean, date_column string, protected_months int, target_rows int, grace_days int, time_zone string, storage_available boolean, previous_verification string, active_job int, capacity_level string, credentials_valid boolean"
    good = ("ARCHIVE", True, "d", 1, 1, 1, "UTC", True, "passed", None, "NONE", True)
    rows = [good] + [tuple(None if i == j else v for j, v in enumerate(good)) for i in range(12) if i != 9]
    eligible = [r.eligible for r in rules.schedule_eligibility(spark.createDataFrame(rows, planned), True).collect()]
    assert eligible == [True] + [False] * 11
    shown = spark.createDataFrame([(None, None, None)], "mode string, gaps array<string>, stop boolean")
    found = shown.select(rules.removal_blockers(F.col("mode"), F.lit(True), F.col("gaps"), F.col("stop")).alias("r")).first().r
    assert {"verify_only_job", "approval_policy_incomplete", "kill_switch_on"} <= set(found)


def test_the_writers_formats_are_supported():
    from tideline.sources.archive import FORMATS

    assert set(FORMATS) == set(rules.ARCHIVE_FORMATS)

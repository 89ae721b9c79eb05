"""Archive jobs: classes, progress, steps, evidence and approvals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.severity import percent_of, round_half_up
from tideline.operators.health import lookup

# Job states, their classes and their progress.
ACTIVE_STATES = (
    "queued", "preparing", "selecting", "exporting", "verifying", "ready_for_deletion", "deletion_approved",
    "deleting", "verifying_deletion", "waiting_retry",
)
TERMINAL_STATES = ("completed", "completed_with_exceptions", "failed", "cancelled", "requires_review")
FINISHED_STATES = ("completed", "failed", "requires_review")
ATTENTION_STATES = ("failed", "requires_review", "ready_for_deletion")
SHOWN_STATES = {"freezing": "selecting"}
PROGRESS = {
    "queued": 0, "preparing": 5, "freezing": 15, "exporting": 30, "verifying": 50, "ready_for_deletion": 60,
    "deletion_approved": 62, "deleting": 70, "verifying_deletion": 95, "waiting_retry": 0, "completed": 100,
    "completed_with_exceptions": 100, "failed": 0, "cancelled": 0, "requires_review": 0,
}
STEPS = (
    "candidate_selection", "candidate_frozen", "archive_created", "archive_verified", "deletion",
    "deletion_verified", "completed",
)
REMOVAL_MODE = "ARCHIVE_VERIFY_DELETE"


def job_class(kind: str) -> Column:
    """Condition of a filter class: all, active, attention or completed."""
    status = F.col("status")
    return {
        "all": F.lit(True),
        "active": status.isin(*ACTIVE_STATES),
        "attention": status.isin(*ATTENTION_STATES),
        "completed": status == "completed",
    }[kind]


def job_counts(jobs: DataFrame) -> DataFrame:
    """Jobs per filter class in one pass."""
    kinds = ("all", "active", "attention", "completed")
    return jobs.agg(*(F.count_if(job_class(k)).alias(f"{k}_jobs") for k in kinds))


def shown_status(status: Column) -> Column:
    return lookup(SHOWN_STATES, status, status)


def latest_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order``. A running maximum, so a hot key never gathers its rows."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*by, "_last.*")


def one_active_per_group(jobs: DataFrame) -> DataFrame:
    """Groups that break the rule of one unfinished job at a time."""
    active = jobs.where(F.col("status").isin(*ACTIVE_STATES))
    counted = active.groupBy("app_id", "group_root").agg(
        F.count(F.lit(1)).alias("active_jobs"), F.min("job_id").alias("first_job")
    )
    return counted.where("active_jobs > 1")


def unfinished_batches(batches: DataFrame, ledger: DataFrame, by: Sequence[str] = ("job_id", "batch_no")) -> DataFrame:
    """Batches still to run on resume: those the ledger does not show as done."""
    done = ledger.where("state = 'done'").select(*by)
    return batches.join(done, list(by), "left_anti")


def candidate_context(previews: DataFrame, policies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Previews with their policy, any active job of the group and the boundary of its last finished one.

    Jobs are reduced to one row per group first instead of being searched per preview.
    """
    finished = F.col("status").isin("completed", "completed_with_exceptions")
    per_group = jobs.groupBy("app_id", "group_root").agg(
        F.min(F.when(~F.col("status").isin(*TERMINAL_STATES), F.col("job_id"))).alias("active_job"),
        F.max_by(
            F.when(finished, F.col("boundary_day")), F.when(finished, F.struct("finished_at", "job_id"))
        ).alias("previous_boundary"),
    )
    months = policies.select(
        "app_id", F.concat_ws(".", "schema_name", "table_name").alias("group_root"), "protected_months"
    )
    keys = ["app_id", "group_root"]
    return previews.join(months, keys, "left").join(per_group, keys, "left")


def progress_pct(status: Column, done: Column, total: Column) -> Column:
    """Removal progress counts batches; every other state has a fixed value."""
    fixed = lookup({k: str(v) for k, v in PROGRESS.items()}, status, F.lit("0")).cast("long")
    running = round_half_up(F.lit(60) + F.lit(35) * done / total)
    return F.when((status == "deleting") & (total > 0), running).otherwise(fixed)


def batch_rollup(batches: DataFrame) -> DataFrame:
    return batches.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("batches"),
        F.count_if(F.col("state") == "done").alias("batches_done"),
        F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"),
    )


def root_candidate_count(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """All frozen rows and the root's, per job attempt, in one pass over the counts per table."""
    per_table = candidates.groupBy("job_id", "attempt", "table_name").agg(F.sum("row_count").alias("n"))
    joined = jobs.select("job_id", "attempt", "group_root").join(per_table, ["job_id", "attempt"], "left")
    return joined.groupBy("job_id", "attempt").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("candidate_rows"),
        F.coalesce(F.sum(F.when(F.col("table_name") == F.col("group_root"), F.col("n"))), F.lit(0)).alias("root_rows"),
    )


def job_progress(jobs: DataFrame, batches: DataFrame, counts: DataFrame, batch_size: int) -> DataFrame:
    """Progress of each job; the expected batches follow from the root rows."""
    joined = jobs.join(batch_rollup(batches), "job_id", "left").join(
        counts.select("job_id", "attempt", "root_rows"), ["job_id", "attempt"], "left"
    )
    done = F.coalesce("batches_done", F.lit(0))
    total = F.ceil(F.coalesce("root_rows", F.lit(0)) / F.lit(batch_size)).cast("long")
    return joined.select(
        "job_id", "status", done.alias("batches_done"), total.alias("batches_total"),
        progress_pct(F.col("status"), done, total).alias("progress_pct"),
    )


def job_steps(jobs: DataFrame, manifests: DataFrame, verifications: DataFrame, batches: DataFrame) -> DataFrame:
    """State of the seven steps of each job, as ``(job_id, step_no, step, state)``.

    ``manifests`` names the job attempts with a manifest, ``verifications`` holds the latest one per job.
    """
    has_manifest = manifests.select("job_id", "attempt").distinct().withColumn("_manifest", F.lit(True))
    latest = verifications.select("job_id", F.col("verified").alias("_verified"))
    started = batches.select("job_id").distinct().withColumn("_batches", F.lit(True))
    j = (
        jobs.join(has_manifest, ["job_id", "attempt"], "left")
        .join(latest, "job_id", "left")
        .join(started, "job_id", "left")
    )
    status = F.col("status")
    manifest, verified = F.coalesce("_manifest", F.lit(False)), F.col("_verified")
    selected = F.col("boundary_day").isNotNull()
    finished = status.isin("completed", "completed_with_exceptions")
    removing = status.isin("deleting", "verifying_deletion") | finished | F.coalesce("_batches", F.lit(False))
    states = [
        F.when(selected, "passed").when((status == "failed") & ~manifest, "failed").otherwise("pending"),
        F.when(manifest, "passed").otherwise("pending"),
        F.when(manifest, "passed").when(status == "exporting", "running").otherwise("pending"),
        F.when(verified, "passed").when(verified.isNotNull(), "failed").when(status == "verifying", "running")
        .otherwise("pending"),
        F.when(~verified, "blocked").when(~removing & verified, "blocked").when(status == "deleting", "running")
        .when(finished, "passed").when(status.isin("ready_for_deletion", "deletion_approved"), "awaiting_review")
        .otherwise("pending"),
        F.when(finished, "passed").otherwise("pending"),
        F.when(finished, "passed").when(status == "failed", "failed").otherwise("pending"),
    ]
    steps = F.array(
        *(
            F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step"), state.alias("state"))
            for i, (name, state) in enumerate(zip(STEPS, states))
        )
    )
    return j.select("job_id", F.inline(steps))


def deletion_impact(counts: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows to remove against the table: share in percent and the bytes that become reusable."""
    sizes = tables.select(
        "app_id", F.concat_ws(".", "schema_name", "table_name").alias("table_name"),
        F.coalesce("exact_rows", "estimated_rows").alias("table_rows"), "table_bytes",
    )
    joined = counts.join(sizes, ["app_id", "table_name"], "left")
    reusable = F.when(
        F.col("table_bytes").isNotNull() & (F.col("table_rows") > 0),
        round_half_up(F.col("table_bytes") * F.col("n") / F.col("table_rows")),
    )
    return joined.withColumn("pct_of_table", percent_of(F.col("n"), F.col("table_rows"))).withColumn(
        "reusable_bytes", reusable
    )


def evidence_equal(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """All fields equal and none missing on either side."""
    same = F.lit(True)
    for a, b in zip(left, right):
        same = same & F.coalesce(a == b, F.lit(False))
    return same


EVIDENCE = ("attempt", "manifest_sha256", "schema_hash", "graph_hash", "candidate_digest")


def job_evidence(
    jobs: DataFrame, applications: DataFrame, manifests: DataFrame, verifications: DataFrame, candidates: DataFrame,
) -> DataFrame:
    """Everything a reviewer relies on, one row per job.

    ``verifications`` may hold several runs per attempt; the last id wins. ``candidates`` holds chunk
    counts per table.
    """
    key = ["job_id", "attempt"]
    last = latest_per_key(verifications.select(*key, "verification_id", "verified", "failed_stage"), key,
                          ["verification_id"])
    frozen = candidates.groupBy(*key).agg(
        F.sum("row_count").alias("candidate_rows"),
        F.bool_and(F.col("key_count") == F.col("row_count")).alias("candidate_set_intact"),
    )
    return (
        jobs.join(applications.select("app_id", "app_name", "environment"), "app_id")
        .join(manifests.select(*key, "manifest_sha256", "data_bytes"), key, "left")
        .join(last, key, "left")
        .join(frozen, key, "left")
        .withColumn("candidate_rows", F.coalesce("candidate_rows", F.lit(0)))
        .withColumn("candidate_set_intact", F.coalesce("candidate_set_intact", F.lit(False)))
    )


def why_not_counted(approvals: DataFrame, operators: DataFrame, evidence: DataFrame, now: Column,
                    exclude_creator: bool = True) -> DataFrame:
    """Each decision of the current attempt with the first reason it does not count, NULL if it does.

    ``operators`` has one row per operator: active, can_approve. ``evidence`` is the current evidence per job.
    """
    current = evidence.select(
        "job_id", "attempt", F.col("created_by").alias("_creator"), *(F.col(c).alias(f"_now_{c}") for c in EVIDENCE[1:])
    )
    rights = operators.select("operator_id", F.col("active").alias("_active"), F.col("can_approve").alias("_may"))
    joined = approvals.join(current, ["job_id", "attempt"]).join(rights, "operator_id", "left")
    same = evidence_equal([F.col(c) for c in EVIDENCE[1:]], [F.col(f"_now_{c}") for c in EVIDENCE[1:]])
    may = F.coalesce("_active", F.lit(False)) & F.coalesce("_may", F.lit(False))
    reason = (
        F.when(F.col("decision") != "approve", "rejection")
        .when(F.col("revoked_at").isNotNull(), "revoked")
        .when(F.col("expires_at").isNull() | (F.col("expires_at") <= now), "expired")
        .when(~same, "evidence_changed")
        .when(~may, "approver_role_missing")
    )
    if exclude_creator:
        reason = reason.when(F.col("operator_id") == F.col("_creator"), "creator_may_not_approve")
    return joined.select(
        "approval_id", "job_id", "attempt", "operator_id", "decision", reason.alias("reason"),
        ((F.col("decision") == "reject") & F.col("revoked_at").isNull() & same).alias("live_rejection"),
    )


def approval_quorum(decisions: DataFrame, required: int) -> DataFrame:
    """Different operators with a counting approval, against the number required; any live rejection blocks.

    Decisions are reduced to one row per operator first, so a job with very many of them stays spread out.
    """
    per_operator = decisions.groupBy("job_id", "attempt", "operator_id").agg(
        F.bool_or(F.col("reason").isNull()).alias("_counts"), F.bool_or("live_rejection").alias("_rejects")
    )
    return per_operator.groupBy("job_id", "attempt").agg(
        F.count_if("_counts").alias("valid_approvals"), F.bool_or("_rejects").alias("rejected")
    ).withColumn("quorum_met", (F.col("valid_approvals") >= required) & ~F.col("rejected"))


def group_policies(policies: DataFrame) -> DataFrame:
    """Root policies with their members: number, and whether all are enabled for archiving."""
    ready = (F.col("policy") == "ARCHIVE") & F.col("enabled")
    named = policies.withColumn("_name", F.concat_ws(".", "schema_name", "table_name"))
    members = (
        named.where(F.col("group_root").isNotNull() & (F.col("group_root") != F.col("_name")))
        .groupBy("app_id", "group_root")
        .agg(F.count(F.lit(1)).alias("_members"), F.bool_and(ready).alias("_ready"))
    )
    is_root = F.col("group_root").isNull() | (F.col("group_root") == F.col("_name"))
    roots = named.where(ready & is_root).select("app_id", F.col("_name").alias("group_root"))
    return roots.join(members, ["app_id", "group_root"], "left").select(
        "app_id", "group_root", F.coalesce("_members", F.lit(0)).alias("members"),
        F.coalesce("_ready", F.lit(True)).alias("members_ready"),
    )

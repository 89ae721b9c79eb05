"""Rule checks over tables: every reason that applies, as an array per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.jobs import REMOVAL_MODE

# Column types that can define a day, name hints, and the archive formats that can be written.
DATE_TYPES = ("date", "timestamp", "timestamp_ntz")
PROTECTED_NAMES = (
    r"(?i)(^|_)(users?|profiles?|accounts?|members?|roles?|permissions?|settings?|config|plans?|products?"
    r"|branches?|staff)(_|$)"
)
ARCHIVE_NAMES = (
    r"(?i)(log|logs|events?|history|audit|attendance|check_?ins?|notifications?|messages?|sessions?|visits?"
    r"|activity|tracking)"
)
LARGE_TABLE_ROWS = 100_000
ARCHIVE_FORMATS = ("parquet", "csv.gz", "jsonl.gz")


def reasons(*rules: tuple[Column, str]) -> Column:
    """The texts of all rules that hold, in order. A rule whose condition is unknown does not hold."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(text)) for condition, text in rules)))


def unless(condition: Column) -> Column:
    """True where ``condition`` does not hold for certain: an unknown value is a reason to refuse."""
    return ~F.coalesce(condition, F.lit(False))


def type_predicate(type_column: Column) -> Column:
    return type_column.isin(*DATE_TYPES)


def policy_validation(
    policies: DataFrame, tables: DataFrame, default_grace: int | None, formats: tuple[str, ...] = ARCHIVE_FORMATS
) -> DataFrame:
    """All reasons an ARCHIVE policy cannot run, and whether it is complete. An unknown format is unsupported.

    ``tables`` gives each table's key columns, the type of the policy's date column (NULL when there is no
    such column) and its application's zone.
    """
    p = policies.join(tables, ["app_id", "schema_name", "table_name"], "left")
    archive = F.col("policy") == "ARCHIVE"
    date_set = F.col("date_column").isNotNull()
    grace = F.coalesce(F.col("grace_days"), F.lit(default_grace).cast("int"))
    found = reasons(
        (~archive & F.col("enabled"), "only_archive_can_be_enabled"),
        (archive & ~date_set, "date_column_not_configured"),
        (archive & date_set & F.col("date_type").isNull(), "date_column_missing"),
        (archive & date_set & ~type_predicate(F.col("date_type")), "date_column_not_temporal"),
        (archive & (F.coalesce("key_columns", F.lit(0)) == 0), "no_primary_key"),
        (archive & F.col("protected_months").isNull(), "protected_period_not_configured"),
        (archive & (F.col("protected_months") < 1), "protected_period_below_one_month"),
        (archive & F.col("target_rows").isNull(), "target_not_configured"),
        (archive & (F.col("target_rows") < 1), "target_not_positive"),
        (archive & grace.isNull(), "grace_period_not_configured"),
        (archive & (grace < 0), "grace_period_negative"),
        (archive & F.coalesce("time_zone", "app_time_zone").isNull(), "time_zone_not_configured"),
        (archive & unless(F.col("archive_format").isin(*formats)), "archive_format_unsupported"),
    )
    incomplete = archive & (F.size("reasons") > 0)
    return p.withColumn("reasons", found).select(
        "app_id", "schema_name", "table_name", "policy", "reasons",
        F.when(incomplete, "incomplete").otherwise("active").alias("status"),
    )


def group_preflight(members: DataFrame) -> DataFrame:
    """Blocking reasons per table of a group.

    ``members``: role, key_columns, date_column, date_type, reachable, on_cycle. Unknown values block; a table of
    unknown role is held to the rules of a root.
    """
    root = F.coalesce(F.col("role") == "root", F.lit(True))
    found = reasons(
        (unless(F.col("key_columns") == 1), "no_single_column_primary_key"),
        (root & F.col("date_type").isNull(), "date_column_missing"),
        (root & ~type_predicate(F.col("date_type")), "date_column_not_temporal"),
        (unless(F.col("reachable")), "not_reachable_from_root"),
        (unless(~F.col("on_cycle")), "cycle"),
    )
    return members.withColumn("reasons", found)


def removal_eligibility(
    jobs: DataFrame, now: Column, environments: tuple[str, ...], max_age_minutes: int, enabled: bool, kill_switch: bool
) -> DataFrame:
    """All reasons removal is refused. Whatever is unknown refuses it.

    ``jobs`` carries its application's environment, the latest verification, the hashes at freeze and now,
    the integrity of the frozen keys and the outcome of the approval chain.
    """
    has_verification = F.col("verified").isNotNull()
    age = F.timestamp_diff("SECOND", F.col("verified_at"), now) / F.lit(60.0)

    def changed(was: str, current: str) -> Column:
        return F.coalesce(F.col(was) != F.col(current), F.lit(True))

    found = reasons(
        (F.lit(not enabled), "removal_disabled"),
        (unless(F.col("environment").isin(*environments)), "environment_not_allowed"),
        (F.lit(kill_switch), "kill_switch_on"),
        (unless(F.col("mode") == REMOVAL_MODE), "verify_only_job"),
        (unless(F.col("status").isin("deletion_approved", "deleting")), "status_not_approved"),
        (~has_verification, "no_verification"),
        (~F.col("verified"), "verification_failed"),
        (has_verification & unless(F.col("verified_attempt") == F.col("attempt")), "verification_of_other_attempt"),
        (has_verification & unless(age <= max_age_minutes), "verification_too_old"),
        (changed("schema_hash", "live_schema_hash"), "schema_changed"),
        (changed("graph_hash", "live_graph_hash"), "graph_changed"),
        (~F.coalesce("candidate_set_intact", F.lit(False)), "candidate_set_damaged"),
        (~F.coalesce("authorized", F.lit(False)), "not_authorized"),
    )
    return jobs.withColumn("reasons", found).withColumn("allowed", F.size("reasons") == 0)


def removal_allowed(state: Column, verification: Column, checksum: Column, verified: Column, expected: Column) -> Column:
    """The job-level gate: an unknown value never allows removal."""
    ok = (state != "blocked") & (verification == "passed") & checksum & (verified == expected)
    return F.coalesce(ok, F.lit(False))


def removal_reviewable(status: Column, allowed: Column, state: Column) -> Column:
    return F.coalesce((status == "ready_for_deletion") & allowed & (state == "awaiting_review"), F.lit(False))


def removal_blockers(mode: Column, verified: Column, gaps: Column, kill_switch: Column) -> Column:
    """Why a job shown for review cannot remove anything; removal is switched off in every deployment."""
    return reasons(
        (F.lit(True), "removal_disabled"),
        (unless(mode == REMOVAL_MODE), "verify_only_job"),
        (unless(F.size(gaps) == 0), "approval_policy_incomplete"),
        (unless(~kill_switch), "kill_switch_on"),
        (~F.coalesce(verified, F.lit(False)), "verification_not_passed"),
    )


def schema_drift(stored: DataFrame, current: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Stored against current hashes; a subject that vanished counts as changed."""
    now = current.select(
        *by, F.col("schema_hash").alias("_schema_now"), F.col("graph_hash").alias("_graph_now")
    )
    joined = stored.join(now, list(by), "left")
    return joined.select(
        *by,
        (~F.coalesce(F.col("schema_hash") == F.col("_schema_now"), F.lit(False))).alias("schema_changed"),
        (~F.coalesce(F.col("graph_hash") == F.col("_graph_now"), F.lit(False))).alias("graph_changed"),
    )


def schedule_eligibility(candidates: DataFrame, scheduling_enabled: bool, allow_first_run: bool = False) -> DataFrame:
    """All reasons an automatic run would be refused."""
    usable = F.coalesce((F.col("policy") == "ARCHIVE") & F.col("enabled"), F.lit(False))
    found = reasons(
        (F.lit(not scheduling_enabled), "scheduling_disabled"),
        (~usable, "policy_not_enabled_archive"),
        (usable & F.col("date_column").isNull(), "date_column_not_configured"),
        (usable & F.col("protected_months").isNull(), "protected_period_not_configured"),
        (usable & F.col("target_rows").isNull(), "target_not_configured"),
        (F.col("grace_days").isNull(), "grace_period_not_configured"),
        (F.col("time_zone").isNull(), "time_zone_not_configured"),
        (unless(F.col("storage_available")), "storage_unavailable"),
        (F.col("previous_verification") == "failed", "previous_verification_failed"),
        (F.col("previous_verification").isNull(), "previous_verification_unknown"),
        ((F.col("previous_verification") == "none") & F.lit(not allow_first_run), "no_previous_verification"),
        (F.col("active_job").isNotNull(), "active_job_for_group"),
        (F.coalesce("capacity_level", F.lit("UNKNOWN")) == "UNKNOWN", "capacity_unknown"),
        (unless(F.col("credentials_valid")), "credentials_invalid"),
    )
    return candidates.withColumn("reasons", found).withColumn("eligible", F.size("reasons") == 0)


def approval_policy_gaps(settings: DataFrame) -> DataFrame:
    """Undecided approval values."""
    names = (
        "required_approvers", "approval_validity_minutes", "excludes_creator", "authorization_validity_minutes",
        "removal_window",
    )
    return settings.withColumn("gaps", reasons(*((F.col(n).isNull(), n) for n in names)))


def threshold_order_check(settings: DataFrame) -> DataFrame:
    """Thresholds must rise, and capacity levels stay within 100 percent."""
    low, medium, high = F.col("low"), F.col("medium"), F.col("high")
    c_low, c_medium, c_high = F.col("capacity_low"), F.col("capacity_medium"), F.col("capacity_high")
    rising = (c_low > 0) & (c_low < c_medium) & (c_medium < c_high) & (c_high <= 100)
    found = reasons(
        (unless(low > 0), "low_not_positive"),
        (unless(medium > low), "medium_not_above_low"),
        (unless(high > medium), "high_not_above_medium"),
        (unless(rising), "capacity_levels_not_rising"),
    )
    return settings.withColumn("reasons", found)


def archive_hints(tables: DataFrame) -> DataFrame:
    """Signs that a table is worth archiving; only for a single key column and at least one date column."""
    eligible = (F.col("key_columns") == 1) & (F.col("date_candidates") > 0)
    found = reasons(
        (eligible & F.col("table_name").rlike(ARCHIVE_NAMES), "event_like_name"),
        (eligible & (F.coalesce("row_count", F.lit(0)) >= LARGE_TABLE_ROWS), "large"),
    )
    return tables.withColumn("hints", found)


def protection_hints(tables: DataFrame, edges: DataFrame, by: tuple[str, ...] = ("app_id",)) -> DataFrame:
    """Signs that a table should stay: master data, parents, missing keys, identity-like names."""
    keys = list(by)
    children = edges.where("child <> parent").groupBy(*keys, F.col("parent").alias("table_name")).agg(
        F.count(F.lit(1)).alias("_children")
    )
    t = tables.join(children, [*keys, "table_name"], "left")
    referenced = F.coalesce("_children", F.lit(0)) > 0
    found = reasons(
        (referenced & (F.col("date_candidates") == 0), "referenced_master_data"),
        (referenced & (F.col("date_candidates") > 0), "parent_of_others"),
        (F.col("key_columns") == 0, "no_primary_key"),
        (F.col("key_columns") > 1, "composite_primary_key"),
        (F.col("table_name").rlike(PROTECTED_NAMES), "identity_like_name"),
    )
    return t.withColumn("hints", found).withColumn("children", F.coalesce("_children", F.lit(0))).drop("_children")


def blocking_union(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Concatenate reasons from several checks: each part is ``(source, df with app_id, table_name, reasons)``."""
    merged = None
    for source, df in parts:
        exploded = df.select("app_id", "table_name", F.explode("reasons").alias("reason"))
        exploded = exploded.withColumn("source", F.lit(source))
        merged = exploded if merged is None else merged.unionByName(exploded)
    return merged

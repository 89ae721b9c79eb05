"""Dashboard rollups: counts, top lists, attention ranking and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.severity import level_rank, megabytes, round_to
from tideline.operators.intervals import days_held, days_in_ranges, merged_ranges
from tideline.operators.jobs import ACTIVE_STATES, ATTENTION_STATES, FINISHED_STATES


def overview_kpis(apps: DataFrame, jobs: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: applications, attention, jobs, alerts and the latest check.

    Each input collapses to one partial row before they are added up.
    """
    zero = F.lit(0).cast("long")
    no_check = F.lit(None).cast("string")
    names = ("applications", "needs_attention", "active_jobs", "awaiting_review", "failed_jobs", "active_alerts")

    def part(df: DataFrame, **values) -> DataFrame:
        latest = values.pop("latest_check", no_check)
        return df.agg(*(values.get(n, zero).alias(n) for n in names), latest.alias("latest_check"))

    parts = [
        part(
            apps,
            applications=F.count(F.lit(1)),
            needs_attention=F.count_if(F.col("status") != "healthy"),
            latest_check=F.max(F.col("last_check").cast("string")),
        ),
        part(
            jobs,
            active_jobs=F.count_if(F.col("status").isin(*ACTIVE_STATES)),
            awaiting_review=F.count_if(F.col("status") == "ready_for_deletion"),
            failed_jobs=F.count_if(F.col("status") == "failed"),
        ),
        part(alerts, active_alerts=F.count_if(F.col("state") == "active")),
    ]
    merged = reduce(DataFrame.unionByName, parts)
    return merged.agg(*(F.sum(n).alias(n) for n in names), F.max("latest_check").alias("latest_check"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    active = F.col("state") == "active"
    return alerts.agg(
        F.count_if(active & (F.col("level") == "HIGH")).alias("high"),
        F.count_if(active & (F.col("level") == "MEDIUM")).alias("medium"),
        F.count_if(active & (F.col("level") == "LOW")).alias("low"),
        F.count_if(F.col("state") == "resolved").alias("resolved"),
    )


def policy_counts(policies: DataFrame) -> DataFrame:
    """Policies per kind and enabled ones, per application."""
    kind = F.col("policy")
    return policies.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("tables"),
        F.count_if(kind == "REVIEW_REQUIRED").alias("review_required"),
        F.count_if(kind == "ARCHIVE").alias("archive"),
        F.count_if(kind == "DO_NOT_ARCHIVE").alias("dont_archive"),
        F.count_if((kind == "ARCHIVE") & F.col("enabled")).alias("enabled_archive"),
    )


def present_policies(policies: DataFrame, tables: DataFrame) -> DataFrame:
    """Policies of tables that still exist."""
    key = ["app_id", "schema_name", "table_name"]
    return policies.join(tables.where("is_present").select(*key), key)


def history_totals(jobs: DataFrame) -> DataFrame:
    """Rows archived with a passed verification, and rows removed, over finished runs."""
    finished = jobs.where(F.col("status").isin(*FINISHED_STATES))
    return finished.agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.sum(F.when(F.col("verified"), F.col("selected_rows"))), F.lit(0)).alias("archived_rows"),
        F.coalesce(F.sum("deleted"), F.lit(0)).alias("removed_rows"),
    )


def index_size_sum(health: DataFrame) -> DataFrame:
    """Index size per application: table sizes rounded first, then their sum to one decimal."""
    return health.groupBy("app_id").agg(
        round_to(F.sum(megabytes(F.col("index_bytes")).cast("decimal(20,2)")).cast("double"), 1).alias("index_mb")
    )


def newest(df: DataFrame, at: str, tie: str, k: int) -> DataFrame:
    """The k newest rows; each task keeps k rows, so nothing is sorted as a whole."""
    return df.orderBy(F.desc(at), F.desc(tie)).limit(k)


def attention_rank(health: DataFrame, apps: DataFrame, jobs: DataFrame) -> DataFrame:
    """Everything that needs a look, most urgent first."""
    tables = health.where("severity <> 'NONE'").select(
        F.concat_ws("-", F.lit("t"), "app_id", "table_name").alias("item"),
        (level_rank(F.col("severity")) * 10).alias("rank"),
    )
    capacity = apps.where("db_severity <> 'NONE'").select(
        F.concat_ws("-", F.lit("db"), "app_id").alias("item"),
        (level_rank(F.col("db_severity")) * 10 - 1).alias("rank"),
    )
    waiting = jobs.where(F.col("status").isin(*ATTENTION_STATES)).select(
        F.concat_ws("-", F.lit("j"), "job_id").alias("item"),
        F.when(F.col("status") == "failed", 25).otherwise(15).alias("rank"),
    )
    review = (
        health.where("policy = 'review_required'")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("is_new").alias("new"))
        .where("n > 0")
        .select(F.format_string("review-%d-%d", "n", "new").alias("item"), F.lit(5).alias("rank"))
    )
    items = reduce(DataFrame.unionByName, (tables, capacity, waiting, review))
    return items.orderBy(F.desc("rank"), "item")


def restore_lookup(covered: DataFrame, days: DataFrame) -> DataFrame:
    """Which jobs hold a wanted day: ``covered`` has one row per job and archived day; overlaps are all returned."""
    wanted = days.select("day").distinct()
    return covered.select("job_id", "table_name", "day").distinct().join(wanted, "day")


def restore_lookup_ranges(covered: DataFrame, days: DataFrame, counted: bool = False) -> DataFrame:
    """The same of ``covered(job_id, table_name, first_day, last_day)``, one row per job and boundary, never one per day.

    A job's ranges are merged first, so each of its days is found once. ``counted`` gives ``(table_name, day, jobs, first_job,
    last_job)`` instead, without making a row per job and day.
    """
    merged = merged_ranges(covered, ["job_id", "table_name"])
    if counted:
        return days_held(merged, days, "job_id", ["table_name"]).withColumnsRenamed({"n": "jobs", "low": "first_job", "high": "last_job"})
    return days_in_ranges(merged, days).select("job_id", "table_name", "day")


def oldest_keys(df: DataFrame, date_column: str, key: str, k: int) -> DataFrame:
    return df.where(F.col(date_column).isNotNull()).orderBy(date_column, key).limit(k)

"""Physical plans: what is read, what is shuffled, and what must never appear."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from compare import FOLDER
from tideline import session
from tideline.queries.registry import Inputs

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")

RUNS = contract.queries()
# Queries that only build a plan; the others write or stream first.
LAZY = (
    "scan_table", "root_predicate", "table_predicate", "fk_chain_join", "split_group_detection", "daily_totals",
    "whole_day_selection", "preview_exclusions", "candidate_status", "selection_totals", "row_fingerprint",
    "referenced_guard", "orphan_check", "set_equality", "column_fidelity", "data_vs_keys", "stage_passed",
    "table_health", "app_health_rollup", "largest_tables", "alert_transitions", "growth_average", "net_growth",
    "lateness_percentiles", "overview_kpis", "attention_rank", "job_progress", "job_steps", "job_evidence_join",
    "approval_quorum", "candidate_context_join", "policy_validation", "removal_eligibility", "schedule_eligibility",
    "redact_text", "catalog_join", "new_tables", "restore_lookup", "reconcile_table",
)


def plan(spark, name):
    return RUNS[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairs_and_no_python(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert bad not in text


def read_schema(text, table):
    scan = next(line for line in text.splitlines() if "FileScan" in line and f"{table}.parquet" in line)
    return re.search(r"ReadSchema: struct<(.*)>", scan)[1], scan


def test_day_totals_read_only_keys_and_the_date(spark):
    text = plan(spark, "daily_totals")
    assert read_schema(text, "lineitem")[0] == "l_orderkey:bigint"
    columns, scan = read_schema(text, "orders")
    assert columns == "o_orderkey:bigint,o_orderdate:timestamp_ntz"
    assert "LessThan(o_orderdate,2001-02-08T00:00)" in scan
    assert text.count("FileScan") == 2  # each table once


def test_children_are_counted_before_their_shuffle(spark):
    lines = plan(spark, "daily_totals").splitlines()
    shuffle = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(l_orderkey" in line)
    assert "partial_count(1)" in lines[shuffle + 1]


def test_top_lists_keep_few_rows_per_task(spark):
    assert "TakeOrderedAndProject" in plan(spark, "recent_jobs")
    assert "WindowGroupLimit" in plan(spark, "largest_tables")


def test_only_aggregates_meet_in_one_task(spark):
    """Whatever is sent to a single task has been aggregated before: day totals or partial results."""
    for name in ("whole_day_selection", "preview_exclusions", "overview_kpis", "data_vs_keys", "column_fidelity"):
        lines = plan(spark, name).splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert "Aggregate" in lines[i + 1], f"{name}: {lines[i + 1][:120]}"


def test_grouped_tables_are_dealt_once_in_parts_of_bounded_size(spark, folder, monkeypatch):
    rows = "SELECT CASE WHEN id < 10 THEN NULL ELSE id DIV 4 END AS l_orderkey, id % 7 AS l_partkey, CAST(id % 3 AS INT) AS l_linenumber, 1.5D AS l_quantity, 2.25D AS l_extendedprice, TIMESTAMP'2001-01-01' AS l_shipdate FROM range(400)"
    spark.sql(rows).write.parquet(f"{folder}/lineitem.parquet")
    monkeypatch.setattr(session, "DEALT_BYTES", 100)
    inputs = Inputs(spark, folder)
    for df in (inputs.order_lines, inputs.edges):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and df.rdd.getNumPartitions() > 4
    assert inputs.edges.distinct().count() == inputs.edges.count()
    assert inputs.order_lines.agg(F.sum("pieces")).first()[0] == 400
    assert inputs.order_lines.where("order_id IS NULL").count() == 3


def test_many_narrow_rows_are_dealt_in_parts_of_bounded_number(spark, folder, monkeypatch):
    rows = "SELECT id DIV 4 AS l_orderkey, id % 7 AS l_partkey, CAST(id % 3 AS INT) AS l_linenumber, 1.5D AS l_quantity, 2.25D AS l_extendedprice, TIMESTAMP'2001-01-01' AS l_shipdate FROM range(4000)"
    spark.sql(rows).write.parquet(f"{folder}/lineitem.parquet")
    monkeypatch.setattr(session, "DEALT_ROWS", 100)
    inputs = Inputs(spark, folder)
    for df in (inputs.order_lines, inputs.edges):
        assert df.rdd.getNumPartitions() == 40

"""Fingerprints, frozen keys, exact removal and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.fingerprint import row_fingerprint, row_fingerprint_md5
from tideline.operators import digesttree, freeze
from tideline.operators.closure import mark_referenced, orphan_counts
from tideline.operators.removal import (
    exact_matches,
    exact_removal,
    job_final_status,
    late_rows,
    live_keys,
    outcome_counts,
    range_delete_risk,
    reconcile_tables,
    row_outcomes,
    still_present,
    stragglers,
)
from tideline.operators.verify import multiset_difference
from tideline.queries.groups import (
    CENTS,
    LINE_EDGE,
    ORDER_FP,
    ORDER_TEXT,
    ZONE,
    keyed_end_day,
    keyed_group,
    live_group,
)
from tideline.queries.registry import Inputs, query
from tideline.session import in_parallel, materialize, scratch_path


def frozen(inputs: Inputs) -> dict[str, DataFrame]:
    """The frozen keys, written once: everything after the freeze is derived from them."""
    plan, tables = keyed_group(inputs)
    end_day = keyed_end_day(plan, tables)

    def freeze_table(table: str) -> DataFrame:
        return materialize(freeze.frozen_keys(plan, tables, table, end_day, CENTS), "frozen")

    return dict(zip(plan.export_order, in_parallel(inputs.spark, freeze_table, plan.export_order)))


def removal(inputs: Inputs, keys: dict[str, DataFrame] | None = None):
    """Outcomes and survivors of the frozen group against the live tables."""
    plan, _ = keyed_group(inputs)
    derived = live_group(inputs)
    stored = in_parallel(inputs.spark, lambda df: materialize(df, "live"), derived.values())
    return exact_removal(plan, keys or frozen(inputs), dict(zip(derived, stored)), CENTS)


def labelled(frames: dict[str, DataFrame]) -> DataFrame:
    """The rows of several tables with the table's name."""
    merged = None
    for table, df in frames.items():
        part = df.withColumn("table_name", F.lit(table))
        merged = part if merged is None else merged.unionByName(part)
    return merged


@query("row_fingerprint", f"SELECT o_orderkey, {ORDER_FP} AS fp FROM {{dated_orders}}")
def fingerprints(inputs: Inputs) -> DataFrame:
    orders = inputs.dated_orders
    return orders.select("o_orderkey", row_fingerprint(orders, double_as=CENTS).alias("fp"))


@query("fingerprint_md5", f"SELECT o_orderkey, md5({ORDER_TEXT}) AS fp FROM {{dated_orders}}")
def fingerprints_md5(inputs: Inputs) -> DataFrame:
    orders = inputs.dated_orders
    return orders.select("o_orderkey", row_fingerprint_md5(orders, double_as=CENTS).alias("fp"))


_LINEITEM_FP = "to_base64(unhex(sha256({})))".format(
    " || ".join(
        f"coalesce(length({p}) || ':' || {p}, '-')"
        for p in (
            "CAST(l_orderkey AS VARCHAR)", "CAST(l_partkey AS VARCHAR)", "CAST(l_suppkey AS VARCHAR)",
            "CAST(l_linenumber AS VARCHAR)", "CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR)",
            "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)",
            "CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR)", "CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR)",
            "l_returnflag", "l_linestatus", "CAST(l_shipdate AS VARCHAR)",
        )
    )
)


@query(
    "distinct_fingerprints",
    f"SELECT count(*) AS n, count(DISTINCT {_LINEITEM_FP}) AS distinct_fp FROM {{lineitem}}",
)
def distinct_fps(inputs: Inputs) -> DataFrame:
    lines = inputs.lineitem
    return freeze.distinct_fingerprints(lines.select(row_fingerprint(lines, double_as=CENTS).alias("fp")))


@query(
    "chunk_number",
    """
SELECT table_name, pk, fp, parent_key, rn, (rn - 1) // 2000 AS chunk_no
FROM (SELECT 'orders' AS table_name, * FROM {numbered_orders} UNION ALL SELECT 'order_lines', * FROM {numbered_lines})
""",
)
def chunk_numbers(inputs: Inputs) -> DataFrame:
    keys = frozen(inputs)
    return labelled(dict(zip(keys, in_parallel(inputs.spark, freeze.number_chunks, keys.values()))))


def chunked(inputs: Inputs) -> DataFrame:
    return freeze.chunk_digests(chunk_numbers(inputs), ["table_name"])


@query("chunk_digest", "SELECT table_name, chunk_no, row_count, digest FROM {chunks}")
def digests(inputs: Inputs) -> DataFrame:
    return chunked(inputs)


@query(
    "candidate_digest",
    """
WITH placed AS (
  SELECT row_number() OVER (ORDER BY table_name, chunk_no) - 1 AS seq, table_name || ':' || chunk_no || ':' || digest AS entry
  FROM {chunks}
), runs AS (
  SELECT seq // 4 AS run, sha256(string_agg(entry, ',' ORDER BY seq)) AS entry FROM placed GROUP BY 1
)
SELECT sha256(string_agg(entry, ',' ORDER BY run)) AS candidate_digest FROM runs
""",
)
def digest_of_candidate(inputs: Inputs) -> DataFrame:
    """Runs of four chunks, so that both levels have work at every scale."""
    return freeze.candidate_digest(materialize(chunked(inputs), "chunks"), fan_in=4)


@query(
    "candidate_integrity",
    """
WITH numbered AS (
  SELECT 'orders' AS table_name, pk, rn FROM {numbered_orders} UNION ALL SELECT 'order_lines', pk, rn FROM {numbered_lines}
), hit AS (
  SELECT table_name, (rn - 1) // 2000 AS chunk_no, bool_or(table_name = 'orders' AND pk % 1009 = 5) AS broken
  FROM numbered GROUP BY 1, 2
)
SELECT table_name, count(*) AS chunks, count(*) FILTER (broken) AS broken_chunks, NOT bool_or(broken) AS intact
FROM hit GROUP BY 1
""",
)
def integrity(inputs: Inputs) -> DataFrame:
    """The recorded digests against a copy of the keys in which some orders lost their fingerprint."""
    keys = materialize(chunk_numbers(inputs), "chunked")
    recorded = materialize(freeze.chunk_digests(keys, ["table_name"]), "recorded")
    lost = (F.col("table_name") == "orders") & (F.col("pk") % 1009 == 5)
    damaged = keys.withColumn("fp", F.when(lost, "").otherwise(F.col("fp")))
    return freeze.candidate_integrity(damaged, recorded, ["table_name"])


@query(
    "damaged_chunks",
    """
WITH numbered AS (
  SELECT 'orders' AS table_name, pk, rn FROM {numbered_orders} UNION ALL SELECT 'order_lines', pk, rn FROM {numbered_lines}
)
SELECT table_name, (rn - 1) // 2000 AS chunk_no, rn, pk, 'changed' AS state FROM numbered WHERE pk % 1009 = 5
""",
)
def damaged(inputs: Inputs) -> DataFrame:
    """Keys that lost their fingerprint in a copy, found by descending two stored hash trees, four chunks to a node."""
    spark, merged = inputs.spark, None
    for table, df in frozen(inputs).items():
        keys = materialize(freeze.number_chunks(df), "chunked")
        copy = keys.withColumn("fp", F.when(F.col("pk") % 1009 == 5, "").otherwise(F.col("fp")))
        paths = [scratch_path(spark, "tree") for _ in range(2)]
        levels = [digesttree.store_tree(freeze.chunk_digests(k), path, table, 4) for k, path in zip((keys, copy), paths)]
        found = digesttree.differing_chunks(spark, *paths, table, levels[0], 4)
        part = digesttree.damaged_keys(keys, copy, found.chunks).withColumn("table_name", F.lit(table))
        merged = part if merged is None else merged.unionByName(part)
    return merged.select("table_name", "chunk_no", "rn", "pk", "state")


@query(
    "batch_number",
    """
WITH roots AS (SELECT pk, (rn - 1) // 500 AS batch_no FROM {numbered_orders})
SELECT 'orders' AS table_name, pk, batch_no FROM roots
UNION ALL
SELECT 'order_lines', l.pk, r.batch_no FROM {frozen_lines} l JOIN roots r ON l.parent_key = CAST(r.pk AS VARCHAR)
""",
)
def batch_numbers(inputs: Inputs) -> DataFrame:
    plan, _ = keyed_group(inputs)
    batches = freeze.number_batches(plan, frozen(inputs), 500)
    return labelled({t: df.select("pk", "batch_no") for t, df in batches.items()})


@query(
    "exact_match_join",
    """
SELECT f.pk, f.fp FROM {frozen_orders} f JOIN {live_order_keys} v ON v.pk = f.pk AND v.fp = f.fp
""",
)
def matches(inputs: Inputs) -> DataFrame:
    keys = frozen(inputs)["orders"].select("pk", "fp")
    return exact_matches(keys, live_keys(inputs.live_orders, "o_orderkey", CENTS))


@query(
    "fp_only_still_matches",
    """
SELECT count(*) AS still_matching FROM {frozen_orders} WHERE fp IN (SELECT fp FROM {live_order_keys})
""",
)
def fp_matches(inputs: Inputs) -> DataFrame:
    """Rows a guard on fingerprints alone would still accept, whatever happened to the schema."""
    live = live_keys(inputs.live_orders, "o_orderkey", CENTS).select("fp").distinct()
    keys = frozen(inputs)["orders"]
    return keys.join(live, "fp", "left_semi").agg(F.count(F.lit(1)).alias("still_matching"))


@query("outcome_join", "SELECT pk, outcome FROM {line_outcomes}")
def outcomes_of_lines(inputs: Inputs) -> DataFrame:
    live = live_keys(inputs.live_lines, "line_id", CENTS)
    return row_outcomes(frozen(inputs)["order_lines"], live).select("pk", "outcome")


@query("exact_removal", "SELECT table_name, pk, outcome FROM {outcomes}")
def removed(inputs: Inputs) -> DataFrame:
    outcomes, _ = removal(inputs)
    return labelled({t: df.select("pk", "outcome") for t, df in outcomes.items()})


@query(
    "survivors",
    """
SELECT 'order_lines' AS table_name, line_id AS pk FROM {line_survivors}
UNION ALL
SELECT 'orders', o_orderkey FROM {live_orders}
WHERE o_orderkey NOT IN (SELECT pk FROM {order_outcomes} WHERE outcome = 'deleted')
""",
)
def remaining_rows(inputs: Inputs) -> DataFrame:
    plan, _ = keyed_group(inputs)
    _, remaining = removal(inputs)
    return labelled({t: df.select(F.col(plan.primary_key(t)).alias("pk")) for t, df in remaining.items()})


@query(
    "still_present",
    """
SELECT 'orders' AS table_name, count(*) AS n FROM {order_outcomes} WHERE outcome IN ('drifted', 'held')
UNION ALL SELECT 'order_lines', count(*) FROM {line_outcomes} WHERE outcome IN ('drifted', 'held')
""",
)
def present(inputs: Inputs) -> DataFrame:
    keys = frozen(inputs)
    return present_counts(inputs, keys, removal(inputs, keys)[1]).withColumnRenamed("still_present", "n")


def present_counts(inputs: Inputs, keys: dict, remaining: dict) -> DataFrame:
    plan, _ = keyed_group(inputs)
    found = {t: still_present(keys[t], remaining[t], plan.primary_key(t)).select("pk") for t in plan.spec.tables}
    counted = {t: df.agg(F.count(F.lit(1)).alias("still_present")) for t, df in found.items()}
    return labelled(counted)


@query(
    "reconciliation",
    """
SELECT table_name, count(*) AS frozen, count(*) AS requested, count(*) FILTER (outcome = 'deleted') AS deleted,
       count(*) FILTER (outcome IN ('drifted', 'held')) AS skipped, count(*) FILTER (outcome = 'missing') AS missing,
       CAST(0 AS BIGINT) AS missing_on_retry, count(*) FILTER (outcome IN ('drifted', 'held')) AS still_present,
       true AS reconciled
FROM {outcomes} GROUP BY 1
""",
)
def reconciliation(inputs: Inputs) -> DataFrame:
    keys = frozen(inputs)
    outcomes, remaining = removal(inputs, keys)
    counted = outcome_counts(labelled({t: df.select("outcome") for t, df in outcomes.items()}), ["table_name"])
    frozen_counts = labelled({t: df.agg(F.count(F.lit(1)).alias("frozen")) for t, df in keys.items()})
    return reconcile_tables(
        counted.withColumn("attempts", F.lit(1)), frozen_counts, present_counts(inputs, keys, remaining)
    )


_ROLLED = """
rolled AS (
  SELECT job_id, table_name, CAST(sum(requested) AS BIGINT) AS requested, CAST(sum(deleted) AS BIGINT) AS deleted,
         CAST(sum(drifted + held) AS BIGINT) AS skipped, CAST(sum(missing) AS BIGINT) AS missing,
         CAST(sum(CASE WHEN attempts > 1 THEN missing ELSE 0 END) AS BIGINT) AS missing_on_retry
  FROM {batches} GROUP BY 1, 2
), counted AS (
  SELECT job_id, table_name, CAST(sum(requested) AS BIGINT) + CASE WHEN job_id % 15 = 0 THEN 1 ELSE 0 END AS frozen,
         CAST(sum(drifted + held) AS BIGINT) + CASE WHEN job_id % 16 = 0 THEN 1 ELSE 0 END AS still_present
  FROM {batches} GROUP BY 1, 2
), verdict AS (
  SELECT r.*, frozen, still_present,
         requested = frozen AND deleted + skipped + missing = frozen AND still_present = skipped AS reconciled
  FROM rolled r JOIN counted c ON c.job_id = r.job_id AND c.table_name = r.table_name
)
"""


def reconciled_jobs(inputs: Inputs) -> DataFrame:
    batches, key = inputs.batches, ["job_id", "table_name"]
    frozen_counts = batches.groupBy(*key).agg(F.sum("requested").alias("_n")).select(
        *key, (F.col("_n") + F.when(F.col("job_id") % 15 == 0, 1).otherwise(0)).alias("frozen")
    )
    present_rows = batches.groupBy(*key).agg(F.sum(F.col("drifted") + F.col("held")).alias("_n")).select(
        *key, (F.col("_n") + F.when(F.col("job_id") % 16 == 0, 1).otherwise(0)).alias("still_present")
    )
    return reconcile_tables(batches, frozen_counts, present_rows, key)


@query(
    "reconcile_table",
    f"""
WITH {_ROLLED}
SELECT job_id, table_name, frozen, requested, deleted, skipped, missing, missing_on_retry, still_present, reconciled
FROM verdict
""",
)
def reconciled(inputs: Inputs) -> DataFrame:
    return reconciled_jobs(inputs)


@query("missing_on_retry", f"WITH {_ROLLED} SELECT job_id, table_name, missing_on_retry FROM verdict")
def retried_missing(inputs: Inputs) -> DataFrame:
    return reconciled_jobs(inputs).select("job_id", "table_name", "missing_on_retry")


@query(
    "job_final_status",
    f"""
WITH {_ROLLED}
SELECT v.job_id, CASE WHEN NOT (bool_and(reconciled) AND max(done)) THEN 'requires_review'
                      WHEN bool_or(skipped > 0) THEN 'completed_with_exceptions' ELSE 'completed' END AS final_status
FROM verdict v JOIN (SELECT job_id, bool_and(state = 'done') AS done FROM {{batches}} GROUP BY 1) d
  ON d.job_id = v.job_id
GROUP BY v.job_id
""",
)
def final_status(inputs: Inputs) -> DataFrame:
    return job_final_status(reconciled_jobs(inputs), inputs.batches)


@query(
    "late_rows",
    """
SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM {live_orders}, {keyed_picked}
WHERE CAST(o_orderdate AS DATE) <= boundary_day AND o_orderkey NOT IN (SELECT pk FROM {frozen_orders})
""",
)
def late(inputs: Inputs) -> DataFrame:
    plan, tables = keyed_group(inputs)
    end_day = keyed_end_day(plan, tables)
    keys = freeze.frozen_keys(plan, tables, "orders", end_day, CENTS)
    return late_rows(inputs.live_orders, "o_orderkey", "o_orderdate", end_day, keys, ZONE).select(
        "o_orderkey", "o_orderdate"
    )


@query(
    "range_delete_risk",
    """
SELECT v.pk, CASE WHEN f.pk IS NULL THEN 'not_archived' ELSE 'archived_copy_stale' END AS risk
FROM {live_order_keys} v JOIN {live_orders} o ON o.o_orderkey = v.pk LEFT JOIN {frozen_orders} f ON f.pk = v.pk,
     {keyed_picked}
WHERE CAST(o_orderdate AS DATE) <= boundary_day AND (f.pk IS NULL OR f.fp <> v.fp)
""",
)
def risk(inputs: Inputs) -> DataFrame:
    plan, tables = keyed_group(inputs)
    end_day = keyed_end_day(plan, tables)
    keys = freeze.frozen_keys(plan, tables, "orders", end_day, CENTS)
    return range_delete_risk(inputs.live_orders, "o_orderkey", "o_orderdate", end_day, keys, ZONE, CENTS)


@query(
    "stragglers",
    """
SELECT o_orderkey, o_custkey FROM {live_orders}, {keyed_picked}
WHERE CAST(o_orderdate AS DATE) <= boundary_day AND o_orderkey NOT IN (SELECT pk FROM {frozen_orders})
""",
)
def straggling(inputs: Inputs) -> DataFrame:
    from tideline.operators.selection import daily_totals, select_candidate

    plan, tables = keyed_group(inputs)
    boundary = select_candidate(daily_totals(plan, tables), plan.spec.target).first()
    keys = freeze.frozen_keys(plan, tables, "orders", str(boundary["end_day"]), CENTS)
    return stragglers(
        inputs.live_orders, "o_orderkey", "o_orderdate", str(boundary["boundary_day"]), keys, ZONE
    ).select("o_orderkey", "o_custkey")


@query(
    "referenced_guard",
    """
SELECT o_orderkey, o_orderkey IN (SELECT order_id FROM {live_lines}) AS held FROM {live_orders}
""",
)
def guard(inputs: Inputs) -> DataFrame:
    return mark_referenced(inputs.live_orders.select("o_orderkey"), inputs.live_lines, LINE_EDGE)


@query(
    "orphan_check",
    """
SELECT order_id, count(*) AS n FROM {live_lines} WHERE order_id NOT IN (SELECT o_orderkey FROM {live_orders}) GROUP BY 1
""",
)
def orphans(inputs: Inputs) -> DataFrame:
    return orphan_counts(inputs.live_lines, inputs.live_orders, LINE_EDGE)




@query(
    "set_equality",
    """
WITH a AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY 1, 2),
     b AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} WHERE l_partkey % 101 <> 0 GROUP BY 1, 2)
SELECT a.l_orderkey, a.l_linenumber, a.n AS copies_left, coalesce(b.n, 0) AS copies_right
FROM a LEFT JOIN b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber
WHERE a.n <> coalesce(b.n, 0)
""",
)
def equality(inputs: Inputs) -> DataFrame:
    """A table with repeated keys against a copy that lost some rows."""
    lines = inputs.lineitem
    damaged = lines.where(F.col("l_partkey") % 101 != 0)
    return multiset_difference(lines, damaged, ["l_orderkey", "l_linenumber"])


@query(
    "oldest_keys",
    """
SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM {dated_orders} WHERE o_orderdate IS NOT NULL
ORDER BY o_orderdate, o_orderkey LIMIT 2500
""",
)
def oldest(inputs: Inputs) -> DataFrame:
    from tideline.operators.rollups import oldest_keys

    return oldest_keys(inputs.dated_orders, "o_orderdate", "o_orderkey", 2500).select("o_orderkey", "o_orderdate")

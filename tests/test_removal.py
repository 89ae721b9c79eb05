"""Freezing, numbering, digests, exact removal and reconciliation."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions.fingerprint import canonical_row, row_fingerprint, row_fingerprint_md5
from tideline.operators import freeze, removal
from tideline.operators.verify import multiset_difference
from tideline.plans.group import FkEdge, GroupSpec, PlanBlocked, plan_group

EDGE = FkEdge("line_order", "lines", ("order_id",), "orders", ("id",))


def group(spark, orders=20, lines=60):
    tables = {
        "orders": spark.sql(f"SELECT id, DATE '2025-01-01' AS placed, 'o' || id AS label FROM range({orders})"),
        "lines": spark.sql(f"SELECT id, id % {orders} AS order_id, id * 2 AS amount FROM range({lines})"),
    }
    spec = GroupSpec("s", "orders", "placed", ("orders", "lines"), {"orders": ("id",), "lines": ("id",)}, "UTC",
                     "2025-06-01", 1)
    return plan_group(spec, {t: df.schema for t, df in tables.items()}, (EDGE,)), tables


def frozen_of(plan, tables):
    return {t: freeze.frozen_keys(plan, tables, t, "2025-02-01") for t in plan.spec.tables}


def test_fingerprint_length_and_text(spark):
    rows = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, 'xy' AS c")
    row = rows.select(canonical_row(rows), row_fingerprint(rows), row_fingerprint_md5(rows)).first()
    assert row[0] == "1:1-2:xy" and len(row[1]) == 44
    assert row[2] == hashlib.md5(row[0].encode()).hexdigest()


def test_fingerprints_tell_neighbouring_rows_apart(spark):
    rows = spark.createDataFrame(
        [("a", None), (None, "a"), ("", None), (None, ""), ("a", "bc"), ("ab", "c"), ("1:a", "-")], "x string, y string"
    )
    assert rows.select(row_fingerprint(rows)).distinct().count() == 7


def test_fingerprints_cover_every_type(spark):
    rows = spark.sql(
        """SELECT id, array(id, NULL) AS a, map('k', id) AS m, named_struct('x', id, 'y', NULL) AS s,
                  CAST(CAST(id AS STRING) AS BINARY) AS b, CAST(id AS DECIMAL(20,6)) AS d, id / 3 AS f, id = 1 AS t,
                  TIMESTAMP '2025-01-01 00:00:00.000001' AS ts, parse_json('{"big": 9007199254740993}') AS v
           FROM range(3)"""
    )
    assert rows.select(row_fingerprint(rows)).distinct().count() == 3


@pytest.mark.parametrize("partitions", [1, 5, 16])
def test_global_numbers_equal_one_window(spark, partitions):
    rows = spark.sql("SELECT (id * 7919) % 10007 AS k FROM range(5000)")
    numbered = freeze.global_row_number(rows, ["k"], "rn", partitions)
    expected = rows.withColumn("want", F.row_number().over(Window.orderBy("k")))
    assert numbered.join(expected, "k").where("rn = want").count() == 5000


def test_global_numbers_of_text_keys(spark):
    rows = spark.sql("SELECT 'k' || lpad(id, 5, '0') AS k FROM range(1000)")
    got = freeze.global_row_number(rows, ["k"], "rn").orderBy("rn").collect()
    assert [r["rn"] for r in got] == list(range(1, 1001)) and got[0]["k"] == "k00000"


def test_chunks_and_digests(spark):
    keys = spark.sql("SELECT id AS pk, 'f' || id AS fp, CAST(NULL AS STRING) AS parent_key FROM range(4500)")
    numbered = freeze.number_chunks(keys)
    chunks = {r["chunk_no"]: r for r in freeze.chunk_digests(numbered).collect()}
    assert {k: r["row_count"] for k, r in chunks.items()} == {0: 2000, 1: 2000, 2: 500}
    text = "".join(f"{i}\tf{i}\t\n" for i in range(4000, 4500))
    assert chunks[2]["digest"] == hashlib.sha256(text.encode()).hexdigest()


def test_integrity_notices_one_changed_key(spark):
    keys = spark.sql("SELECT id AS pk, 'f' || id AS fp, CAST(NULL AS STRING) AS parent_key FROM range(4500)")
    numbered = freeze.number_chunks(keys)
    recorded = freeze.chunk_digests(numbered)
    assert freeze.candidate_integrity(numbered, recorded).first()["intact"]
    changed = numbered.withColumn("fp", F.when(F.col("pk") == 2345, "x").otherwise(F.col("fp")))
    row = freeze.candidate_integrity(changed, recorded).first()
    assert (row["broken_chunks"], row["intact"]) == (1, False)
    lost = numbered.where("chunk_no <> 2")
    assert not freeze.candidate_integrity(lost, recorded).first()["intact"]


def test_candidate_digest_levels(spark):
    chunks = spark.createDataFrame(
        [("a", i, f"d{i}") for i in range(5)] + [("b", i, f"e{i}") for i in range(3)],
        "table_name string, chunk_no long, digest string",
    )
    entries = [f"a:{i}:d{i}" for i in range(5)] + [f"b:{i}:e{i}" for i in range(3)]

    def sha(texts):
        return hashlib.sha256(",".join(texts).encode()).hexdigest()

    assert freeze.candidate_digest(chunks).first()[0] == sha([sha(entries)])  # two levels at every size
    level = [sha(entries[i:i + 3]) for i in range(0, 8, 3)]
    assert freeze.candidate_digest(chunks, fan_in=3).first()[0] == sha(level)


def test_batches_take_children_along(spark):
    plan, tables = group(spark, 5, 15)
    batches = freeze.number_batches(plan, frozen_of(plan, tables), 2)
    roots = {r["pk"]: r["batch_no"] for r in batches["orders"].collect()}
    assert roots == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    assert all(r["batch_no"] == roots[r["pk"] % 5] for r in batches["lines"].collect())
    assert batches["lines"].count() == 15


def test_every_outcome(spark):
    plan, tables = group(spark)
    frozen = frozen_of(plan, tables)
    live = {
        # order 3 edited, order 4 gone; order 5 gets a new line, line 6 edited (so order 6 is held), line 7 gone
        "orders": tables["orders"].where("id <> 4").withColumn(
            "label", F.when(F.col("id") == 3, "edited").otherwise(F.col("label"))
        ),
        "lines": tables["lines"].where("id <> 7").withColumn(
            "amount", F.when(F.col("id") == 6, -1).otherwise(F.col("amount"))
        ).unionByName(spark.sql("SELECT 1000L AS id, 5L AS order_id, 1L AS amount")),
    }
    outcomes, remaining = removal.exact_removal(plan, frozen, live)
    got = {t: {r["pk"]: r["outcome"] for r in df.collect()} for t, df in outcomes.items()}
    assert {k: v for k, v in got["lines"].items() if v != "deleted"} == {6: "drifted", 7: "missing"}
    assert {k: v for k, v in got["orders"].items() if v != "deleted"} == {
        3: "drifted", 4: "missing", 5: "held", 6: "held"
    }
    left = {t: {r["id"] for r in df.select("id").collect()} for t, df in remaining.items()}
    assert left == {"orders": {3, 5, 6}, "lines": {6, 1000}}
    # no orphans: every remaining line still has its order
    assert remaining["lines"].join(remaining["orders"], F.col("order_id") == remaining["orders"]["id"], "left_anti").count() == 0
    again, _ = removal.exact_removal(plan, frozen, remaining)
    assert removal.outcome_counts(again["lines"]).first()["deleted"] == 0  # a second run removes nothing


def test_rows_outside_the_key_range_stay(spark):
    plan, tables = group(spark)
    frozen = {t: df.where("pk BETWEEN 4 AND 9") for t, df in frozen_of(plan, tables).items()}
    _, remaining = removal.exact_removal(plan, frozen, tables)
    assert {r["id"] for r in remaining["lines"].collect()} == set(range(60)) - set(range(4, 10))
    assert remaining["orders"].count() == 20  # every order still has lines
    none = {t: df.where("pk < 0") for t, df in frozen.items()}
    _, remaining = removal.exact_removal(plan, none, tables)
    assert remaining["lines"].count() == 60


def test_a_blocked_plan_and_a_missing_table_are_refused(spark):
    plan, tables = group(spark)
    frozen = frozen_of(plan, tables)
    with pytest.raises(ValueError, match="rows of lines"):
        removal.exact_removal(plan, frozen, {"orders": tables["orders"]})
    loop = FkEdge("line_line", "lines", ("amount",), "lines", ("id",))
    outside = FkEdge("audit_order", "audit", ("order_id",), "orders", ("id",))
    for edge in (loop, outside):
        blocked = plan_group(plan.spec, {t: df.schema for t, df in tables.items()}, [*plan.edges, edge])
        assert blocked.blocking
        with pytest.raises(PlanBlocked):
            removal.exact_removal(blocked, frozen, tables)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_outcomes_partition_the_frozen_rows(spark, seed):
    random.seed(seed)
    plan, tables = group(spark, 30, 200)
    frozen = frozen_of(plan, tables)
    dropped, edited = random.sample(range(200), 20), random.sample(range(200), 20)
    lines = tables["lines"].where(~F.col("id").isin(dropped)).withColumn(
        "amount", F.when(F.col("id").isin(edited), -5).otherwise(F.col("amount"))
    )
    live = {"orders": tables["orders"], "lines": lines}
    outcomes, remaining = removal.exact_removal(plan, frozen, live)
    for table in plan.spec.tables:
        counts = removal.outcome_counts(outcomes[table]).first()
        assert counts["requested"] == sum(counts[k] for k in ("deleted", "drifted", "held", "missing"))
        assert remaining[table].count() + counts["deleted"] == live[table].count()
    gone_lines = set(range(200)) - set(dropped) - (set(edited) - set(dropped))
    held = {i % 30 for i in set(edited) - set(dropped)}
    assert removal.outcome_counts(outcomes["lines"]).first()["deleted"] == len(gone_lines)
    assert removal.outcome_counts(outcomes["orders"]).first()["held"] == len(held)


def test_range_delete_is_dangerous(spark):
    plan, tables = group(spark)
    frozen = frozen_of(plan, tables)["orders"]
    live = tables["orders"].withColumn(
        "label", F.when(F.col("id") == 2, "edited").otherwise(F.col("label"))
    ).unionByName(spark.sql("SELECT 900L AS id, DATE '2025-01-01' AS placed, 'late' AS label"))
    live = live.unionByName(spark.sql("SELECT 901L AS id, DATE '2021-06-01' AS placed, 'backdated' AS label"))
    risk = removal.range_delete_risk(live, "id", "placed", "2025-02-01", frozen, "UTC")
    assert {r["pk"]: r["risk"] for r in risk.collect()} == {
        2: "archived_copy_stale", 900: "not_archived", 901: "not_archived"
    }
    late = removal.late_rows(live, "id", "placed", "2025-02-01", frozen, "UTC")
    assert {r["id"] for r in late.collect()} == {900, 901}
    assert removal.stragglers(live, "id", "placed", "2025-01-31", frozen, "UTC").count() == 2


def test_reconciliation(spark):
    batches = spark.createDataFrame(
        [("j", "t", 10, 7, 1, 1, 1, 2), ("j", "t", 10, 10, 0, 0, 0, 1), ("k", "t", 5, 5, 0, 0, 0, 1)],
        "job_id string, table_name string, requested long, deleted long, drifted long, held long, missing long, attempts int",
    )
    frozen = spark.createDataFrame([("j", "t", 20), ("k", "t", 5)], "job_id string, table_name string, frozen long")
    present = spark.createDataFrame([("j", "t", 2)], "job_id string, table_name string, still_present long")
    rows = removal.reconcile_tables(batches, frozen, present, ["job_id", "table_name"])
    got = {r["job_id"]: r for r in rows.collect()}
    assert got["j"]["reconciled"] and got["j"]["missing_on_retry"] == 1 and got["k"]["reconciled"]
    states = spark.createDataFrame([("j", "done"), ("k", "started")], "job_id string, state string")
    final = {r[0]: r[1] for r in removal.job_final_status(rows, states).collect()}
    assert final == {"j": "completed_with_exceptions", "k": "requires_review"}


def test_copies_are_counted(spark):
    rows = spark.sql("SELECT CASE WHEN id < 4000 THEN 0 ELSE id END AS k FROM range(10000)")  # one value fills 40 %
    assert multiset_difference(rows, rows, ["k"]).isEmpty()
    fewer = rows.where("k > 0").unionByName(spark.sql("SELECT 0L AS k FROM range(3999)"))
    row = multiset_difference(rows, fewer, ["k"]).collect()
    assert [(r["k"], r["copies_left"], r["copies_right"]) for r in row] == [(0, 4000, 3999)]

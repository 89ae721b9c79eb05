"""File formats, export, verification and damage of every kind."""

import dataclasses
import glob
import gzip
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tideline.functions.hashes import schema_columns, schema_hash
from tideline.operators.verify import STAGES, gate_verdict, run_gate, stage_results
from tideline.plans.group import FkEdge, GroupSpec, plan_group
from tideline.sources import archive

AWKWARD = """
SELECT id,
       CAST(id / 7 AS DECIMAL(20,6)) AS n_exact,
       CASE WHEN id % 5 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN id % 5 = 1 THEN CAST('-Infinity' AS DOUBLE)
            WHEN id % 5 = 2 THEN CAST('NaN' AS DOUBLE) ELSE id / 3 END AS n_float,
       TIMESTAMP '2025-01-01 00:00:00.000001+00:00' + make_dt_interval(0, 0, 0, id) AS ts,
       TIMESTAMP_NTZ '2025-01-01 23:59:59.999999' AS ts_local,
       date_add(DATE '1969-12-30', CAST(id AS INT)) AS d,
       id % 2 = 0 AS flag,
       CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(concat('b', id) AS BINARY) END AS blob,
       element_at(array('पनीर टिक्का', 'மசாலா தோசை', 'Filter Coffee ☕🙂', 'مرحبا', 'tab\\tand\\nnewline',
                        'back\\\\slash "quote", comma', ' blanks ', 'cr\\rlf\\r\\n'), CAST(1 + id % 8 AS INT)) AS txt,
       CASE WHEN id % 100 = 0 THEN repeat('large block of text, ', 3000) ELSE 'short' END AS txt_large,
       CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN NULL ELSE 'value' END AS empty_vs_null
FROM range(500)
"""


@pytest.mark.parametrize("fmt", ["parquet", "csv.gz", "jsonl.gz"])
def test_formats_give_back_every_value(spark, folder, fmt):
    rows = spark.sql(AWKWARD)
    copy = archive.format_round_trip(rows, fmt, f"{folder}/{fmt}")
    found = archive.column_fidelity(rows, copy, "id").first().asDict()
    assert found.pop("source_rows") == found.pop("restored_rows") == 500
    assert {c: n for c, n in found.items() if n} == {}
    assert copy.schema == rows.schema or [f.dataType for f in copy.schema] == [f.dataType for f in rows.schema]


def test_nested_and_variant_columns(spark, folder):
    rows = spark.sql(
        """SELECT id, array('plain', 'with,comma', NULL) AS arr, map('k', id) AS m,
                  parse_json('{"big": 9007199254740993, "nested": [1, "x", null]}') AS j FROM range(50)"""
    )
    copy = archive.format_round_trip(rows, "parquet", f"{folder}/p")
    found = archive.column_fidelity(rows, copy, "id").first()
    assert (found["arr"], found["m"], found["j"]) == (0, 0, 0)
    with pytest.raises(archive.UnfaithfulFormat):
        archive.write_csv_gz(rows, f"{folder}/c")


def test_csv_refuses_text_that_reads_as_null(spark, folder):
    with pytest.raises(archive.UnfaithfulFormat):
        archive.write_csv_gz(spark.sql(r"SELECT 1 AS id, '\\N' AS t"), f"{folder}/c")


def test_truncated_csv_fails_the_read(spark, folder):
    rows = spark.sql("SELECT id, 'x' || id AS t FROM range(20000)")
    archive.write_csv_gz(rows.coalesce(1), f"{folder}/c")
    part = glob.glob(f"{folder}/c/*.gz")[0]
    damaged = bytearray(open(part, "rb").read())
    for i in range(16):
        damaged[len(damaged) // 2 + i] ^= 0xFF
    open(part, "wb").write(damaged)
    os.remove(part.replace("part-", ".part-") + ".crc")
    with pytest.raises(Exception, match="FAILED_READ_FILE|corrupt|MALFORMED|invalid"):
        archive.read_csv_gz(spark, f"{folder}/c", rows.schema).agg(F.sum("id")).collect()


def test_column_fidelity_counts_differences(spark):
    rows = spark.sql("SELECT id, 'a' AS t, CAST(NULL AS STRING) AS n FROM range(10)")
    copy = rows.where("id < 8").withColumn("t", F.when(F.col("id") == 3, "b").otherwise(F.col("t")))
    found = archive.column_fidelity(rows, copy, "id").first()
    assert (found["restored_rows"], found["t"], found["n"]) == (8, 3, 0)  # a missing row reads as NULL


EDGE = FkEdge("line_order", "lines", ("order_id",), "orders", ("id",))


def group(spark):
    tables = {
        "orders": spark.sql(
            "SELECT id, date_add(DATE '2025-01-01', CAST(id % 50 AS INT)) AS placed, 'o' || id AS label FROM range(500)"
        ),
        "lines": spark.sql("SELECT id, id % 500 AS order_id, id * 2 AS amount FROM range(3000)"),
    }
    spec = GroupSpec("shop", "orders", "placed", ("orders", "lines"), {"orders": ("id",), "lines": ("id",)}, "UTC",
                     "2025-02-10", 1000)
    return plan_group(spec, {t: df.schema for t, df in tables.items()}, (EDGE,)), tables


@pytest.fixture(scope="module")
def good(spark, tmp_path_factory):
    plan, tables = group(spark)
    root = str(tmp_path_factory.mktemp("archive"))
    return plan, tables, archive.freeze_and_export(plan, tables, root, "job-9", 2)


def copy_of(record, folder):
    path = f"{folder}/copy"
    shutil.copytree(record.path, path)
    return dataclasses.replace(record, path=path)


def gate(spark, plan, record, schema=None):
    return run_gate(spark, plan, record, schema or record.schema_hash)


def test_good_archive_is_verified(spark, good):
    plan, tables, record = good
    assert record.path.endswith("app=shop/job=job-9/attempt=2")
    result = gate(spark, plan, record)
    assert result.verified and result.failed_stage is None
    assert {r["stage"] for r in result.checks.collect()} == set(STAGES)
    assert record.rows_by_table["lines"] == 6 * record.rows_by_table["orders"]
    schemas = archive.read_schema_doc(spark, f"{record.path}/schema")
    restored = archive.read_archive(spark, record.path, "orders", schemas["orders"])
    expected = tables["orders"].where(F.col("placed") < F.lit(record.end_day).cast("date"))
    assert restored.exceptAll(expected).isEmpty() and expected.exceptAll(restored).isEmpty()


def files(record, part):
    return sorted(glob.glob(f"{record.path}/{part}/part-*"))


def no_crc(path):
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)


def rehash(spark, record):
    return dataclasses.replace(record, objects=archive.object_checksums(spark, record.path))


def rewrite(spark, record, table, change):
    """Change rows of one data folder and keep the object record consistent with the new files."""
    path = f"{record.path}/data/{table}"
    stored = spark.read.parquet(path)
    change(stored).coalesce(1).write.parquet(f"{path}-new")
    for old in glob.glob(f"{path}/*.parquet"):
        no_crc(old)
        os.remove(old)
    for new in glob.glob(f"{path}-new/*.parquet"):
        shutil.copy(new, path)
    shutil.rmtree(f"{path}-new")
    spark.catalog.clearCache()
    return rehash(spark, record)


def test_flipped_bytes(spark, good, folder):
    plan, _, record = good
    record = copy_of(record, folder)
    part = files(record, "data/lines")[0]
    data = bytearray(open(part, "rb").read())
    data[len(data) // 2] ^= 0xFF
    no_crc(part)
    open(part, "wb").write(data)
    assert gate(spark, plan, record).failed_stage == "archive_integrity"


def test_wrong_recorded_digest(spark, good):
    plan, _, record = good
    first = record.objects.orderBy("object").first()["object"]
    wrong = record.objects.withColumn("sha256", F.when(F.col("object") == first, "0").otherwise(F.col("sha256")))
    assert gate(spark, plan, dataclasses.replace(record, objects=wrong)).failed_stage == "archive_integrity"


def test_missing_object(spark, good, folder):
    plan, _, record = good
    record = copy_of(record, folder)
    os.remove(files(record, "keys/orders")[0])
    assert gate(spark, plan, record).failed_stage == "archive_created"


def test_lost_row_with_consistent_files(spark, good, folder):
    plan, _, record = good
    record = rewrite(spark, copy_of(record, folder), "lines", lambda df: df.where("id <> 7"))
    assert gate(spark, plan, record).failed_stage == "archive_row_count"


def test_repeated_row_with_consistent_files(spark, good, folder):
    plan, _, record = good
    record = rewrite(
        spark, copy_of(record, folder), "lines",
        lambda df: df.where("id <> 7").unionByName(df.where("id = 8")),
    )
    assert gate(spark, plan, record).failed_stage == "archive_key_set"


def test_changed_value_is_found_only_by_restoring(spark, good, folder):
    plan, _, record = good
    record = rewrite(
        spark, copy_of(record, folder), "lines",
        lambda df: df.withColumn("amount", F.when(F.col("id") == 8, 1).otherwise(F.col("amount"))),
    )
    result = gate(spark, plan, record)
    assert result.failed_stage == "restore_fingerprint" and not result.verified


def edit_manifest(spark, record, change, recorded):
    part = files(record, "manifest")[0]
    manifest = json.loads(open(part).read())
    change(manifest)
    text = json.dumps(manifest, sort_keys=True)
    no_crc(part)
    open(part, "w").write(text + "\n")
    record = rehash(spark, record)
    return dataclasses.replace(record, manifest_sha256=archive.text_digest(text)) if recorded else record


def test_edited_boundary(spark, good, folder):
    plan, _, record = good
    record = edit_manifest(
        spark, copy_of(record, folder), lambda m: m["boundary"].update(last_day="2099-01-01"), False
    )
    assert gate(spark, plan, record).failed_stage == "archive_created"


def test_edited_manifest_with_stale_digest(spark, good, folder):
    plan, _, record = good
    record = edit_manifest(spark, copy_of(record, folder), lambda m: m["tables"]["orders"].update(rows=1), False)
    assert gate(spark, plan, record).failed_stage == "archive_integrity"


def test_edited_rows_with_recorded_digest(spark, good, folder):
    plan, _, record = good
    record = edit_manifest(spark, copy_of(record, folder), lambda m: m["tables"]["orders"].update(rows=1), True)
    assert gate(spark, plan, record).failed_stage == "archive_row_count"


DRIFTS = {
    "added_column": lambda s: s.add("source", "string"),
    "removed_column": lambda s: type(s)(s.fields[:-1]),
    "renamed_column": lambda s: type(s)(s.fields[:-1]).add("remark", "string"),
    "changed_type": lambda s: type(s)(s.fields[:-1]).add("label", "binary"),
}


@pytest.mark.parametrize("drift", DRIFTS)
def test_schema_drift_after_the_freeze(spark, good, drift):
    plan, tables, record = good
    schemas = {t: df.schema for t, df in tables.items()}
    copied = type(schemas["orders"])(list(schemas["orders"].fields))
    schemas["orders"] = DRIFTS[drift](copied)
    now = schema_hash(schema_columns(spark, schemas, plan.spec.primary_keys)).first()[0]
    assert gate(spark, plan, record, now).failed_stage == "schema_hash"


def test_key_change_is_schema_drift(spark, good):
    plan, tables, record = good
    schemas = {t: df.schema for t, df in tables.items()}
    now = schema_hash(schema_columns(spark, schemas, {"orders": ("label",), "lines": ("id",)})).first()[0]
    assert now != record.schema_hash


def test_record_of_an_earlier_session(spark, good, folder):
    plan, _, record = good
    archive.save_record(record, f"{folder}/record")
    loaded = archive.load_record(spark, f"{folder}/record")
    assert loaded.rows_by_table == record.rows_by_table and loaded.candidate_digest == record.candidate_digest
    assert gate(spark, plan, loaded).verified


def test_target_not_reached(spark, folder):
    plan, tables = group(spark)
    far = dataclasses.replace(plan, spec=dataclasses.replace(plan.spec, target=10**9))
    with pytest.raises(archive.TargetNotReached):
        archive.freeze_and_export(far, tables, folder, "job-1")
    assert os.listdir(folder) == []


def test_attempts_do_not_mix(spark, folder):
    plan, tables = group(spark)
    one = archive.freeze_and_export(plan, tables, folder, "job-1", 1)
    fewer = dict(tables, lines=tables["lines"].where("id % 2 = 0"))
    two = archive.freeze_and_export(plan, fewer, folder, "job-1", 2)
    assert two.rows_by_table["lines"] * 2 != two.rows_by_table["orders"]
    assert gate(spark, plan, one).verified and gate(spark, plan, two).verified
    again = archive.freeze_and_export(plan, fewer, folder, "job-1", 2)
    assert gate(spark, plan, again).verified
    assert again.candidate_digest == two.candidate_digest != one.candidate_digest


def test_stages_need_checks(spark):
    checks = spark.createDataFrame(
        [("a", s, True) for s in STAGES] + [("b", s, s != STAGES[1]) for s in STAGES[:3]] + [("c", STAGES[0], True)],
        "job_id string, stage string, pass boolean",
    )
    assert stage_results(checks, ["job_id"]).count() == 18
    got = {r["job_id"]: (r["verified"], r["failed_stage"]) for r in gate_verdict(checks, ["job_id"]).collect()}
    assert got == {"a": (True, None), "b": (False, STAGES[1]), "c": (False, None)}


def test_gzip_is_plain_gzip(spark, folder):
    archive.write_csv_gz(spark.sql("SELECT 1 AS id, 'a,b' AS t").coalesce(1), f"{folder}/c")
    text = gzip.open(glob.glob(f"{folder}/c/*.gz")[0], "rt").read()
    assert text == 'id,t\n1,"a,b"\n'

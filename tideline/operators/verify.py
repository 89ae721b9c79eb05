"""Verification of an archive: six ordered stages, each made of small aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.fingerprint import row_fingerprint
from tideline.plans.group import GroupPlan
from tideline.session import in_parallel, small_frame
from tideline.sources.archive import (
    KEYS_SCHEMA,
    ArchiveRecord,
    read_archive,
    read_manifest,
    read_schema_doc,
)
from tideline.sources.objects import read_digests, read_sizes

# Fixed order of the stages.
STAGES = (
    "archive_created",
    "archive_integrity",
    "archive_row_count",
    "archive_key_set",
    "restore_fingerprint",
    "schema_hash",
)
CHECK_SCHEMA = "stage: string, name: string, pass: boolean, detail: string"


@dataclass(frozen=True)
class GateResult:
    verified: bool
    failed_stage: str | None
    checks: DataFrame


def _copies(columns: Sequence[str], *sides: DataFrame) -> DataFrame:
    """Copies of every value per side, as columns ``_0``, ``_1``, …: a union and one hash aggregate.

    Only counts are kept per value, so the aggregate needs no sort and combines before the shuffle.
    """
    tagged = (df.select(*columns, F.lit(i).alias("_side")) for i, df in enumerate(sides))
    rows = reduce(DataFrame.unionByName, tagged)
    return rows.groupBy(*columns).agg(*(F.count_if(F.col("_side") == i).alias(f"_{i}") for i in range(len(sides))))


def _keyed(df: DataFrame, key: str = "pk", fp: Column | None = None) -> DataFrame:
    text = F.col(key).cast("string").alias("pk")
    return df.select(text) if fp is None else df.select(text, fp.alias("fp"))


def _unequal() -> Column:
    return F.col("_0") != F.col("_1")


def key_set_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Compare two ``(pk, fp)`` sets: keys on one side only, and keys whose fingerprints differ."""
    pairs = _copies(["pk", "fp"], _keyed(left, fp=F.col("fp")), _keyed(right, fp=F.col("fp")))
    keys = pairs.where(_unequal()).groupBy("pk").agg(F.sum("_0").alias("_0"), F.sum("_1").alias("_1"))
    return keys.agg(
        F.count_if(F.col("_1") == 0).alias("only_left"),
        F.count_if(F.col("_0") == 0).alias("only_right"),
        F.count_if((F.col("_0") > 0) & (F.col("_1") > 0)).alias("different_fp"),
    )


def data_vs_keys(data: DataFrame, primary_key: str, keys: DataFrame) -> DataFrame:
    """Primary keys of the data against the frozen keys, and repeated keys on either side."""
    per_key = _copies(["pk"], _keyed(data, primary_key), _keyed(keys))
    return per_key.agg(
        F.coalesce(F.sum("_0"), F.lit(0)).alias("data_rows"),
        F.coalesce(F.sum("_1"), F.lit(0)).alias("key_rows"),
        F.count_if(F.col("_1") == 0).alias("only_data"),
        F.count_if(F.col("_0") == 0).alias("only_keys"),
        F.count_if((F.col("_0") > 1) | (F.col("_1") > 1)).alias("repeated_keys"),
    )


def multiset_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose number of copies differs, with both numbers. Empty means equal with multiplicity.

    Counting copies instead of numbering them keeps a value that fills a third of the table to one row
    per task.
    """
    names = {"_0": "copies_left", "_1": "copies_right"}
    return _copies(columns, left, right).where(_unequal()).withColumnsRenamed(names)


def restore_reconcile(restored: DataFrame, primary_key: str, frozen: DataFrame, double_as: str | None = None) -> DataFrame:
    """Hash every restored row again and compare it with its frozen fingerprint."""
    stamp = row_fingerprint(restored, double_as=double_as)
    pairs = _copies(["pk", "fp"], _keyed(restored, primary_key, stamp), _keyed(frozen, fp=F.col("fp")))
    return pairs.agg(
        F.coalesce(F.sum("_0"), F.lit(0)).alias("restored_rows"),
        F.coalesce(F.sum("_1"), F.lit(0)).alias("frozen_rows"),
        F.countDistinct(F.when(_unequal(), F.col("pk"))).alias("mismatches"),
    )


def day_sum_vs_rows(days: DataFrame, rows: DataFrame) -> DataFrame:
    """The sum of all day totals must equal the sum of all table rows."""
    sums = days.select(F.col("n").alias("_d"), F.lit(0).cast("long").alias("_r")).unionByName(
        rows.select(F.lit(0).cast("long").alias("_d"), F.col("n").alias("_r"))
    )
    return sums.agg(F.sum("_d").alias("day_sum"), F.sum("_r").alias("row_sum")).withColumn(
        "equal", F.col("day_sum") == F.col("row_sum")
    )


def stage_results(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A stage passed only if it has checks and all of them passed; every stage appears.

    One aggregate per subject with a pair of numbers per stage, unfolded afterwards.
    """
    counted, stages = [], []
    for i, name in enumerate(STAGES):
        here = F.col("stage") == name
        counted += [F.count_if(here).alias(f"_n{i}"), F.bool_and(F.when(here, F.col("pass"))).alias(f"_p{i}")]
        stages.append(
            F.struct(
                F.lit(i + 1).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"_n{i}").alias("checks"),
                F.coalesce(f"_p{i}", F.lit(False)).alias("passed"),
            )
        )
    return checks.groupBy(*by).agg(*counted).select(*by, F.inline(F.array(*stages)))


def gate_verdict(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Verified when all six stages passed; otherwise the first stage with a failing check."""
    staged = stage_results(checks, by)
    failing = (F.col("checks") > 0) & ~F.col("passed")
    return staged.groupBy(*by).agg(
        F.bool_and("passed").alias("verified"),
        F.min_by("stage", F.when(failing, F.col("stage_no"))).alias("failed_stage"),
    )


def run_gate(
    spark: SparkSession,
    plan: GroupPlan,
    record: ArchiveRecord,
    current_schema_hash: str,
    double_as: str | None = None,
) -> GateResult:
    """Run the stages in order and stop after the first one with a failing check.

    Expected values come from the record kept at export, never from files beside the archive. Only the
    outcome of each check reaches the driver.
    """
    checks: list[tuple[str, str, bool, str]] = []

    def add(stage: str, name: str, passed: bool, detail: object = "") -> None:
        checks.append((stage, name, bool(passed), str(detail)))

    def finish() -> GateResult:
        failed = next((s for s in STAGES if any(c[0] == s and not c[2] for c in checks)), None)
        complete = all(any(c[0] == s for c in checks) for s in STAGES)
        rows = [dict(zip(("stage", "name", "pass", "detail"), c)) for c in checks]
        return GateResult(failed is None and complete, failed, small_frame(spark, rows, CHECK_SCHEMA))

    def failing() -> bool:
        return any(not c[2] for c in checks)

    steps = (_created, _integrity, _row_counts, _key_sets, _restore, _schema)
    context = {"spark": spark, "plan": plan, "record": record, "double_as": double_as, "current": current_schema_hash}
    for stage, step in zip(STAGES, steps):
        try:
            step(context, lambda name, ok, detail="": add(stage, name, ok, detail))
        except Exception as error:  # an unreadable object is a failed check, anything else a failed run
            if not _unreadable(error):
                raise
            add(stage, "readable", False, f"{type(error).__name__}: {error}")
        if failing():
            break
    return finish()


# How Spark and the file systems say that a stored object cannot be read or parsed.
UNREADABLE = (
    "FAILED_READ_FILE", "MALFORMED", "PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ", "FileNotFoundException",
    "is not a Parquet file", "EOFException", "ZipException", "incorrect header check", "not a gzip file", "BadRecordException",
)


def _unreadable(error: Exception) -> bool:
    """Is the archive at fault? A lost executor or a full disk says nothing about it."""
    text = str(error)
    if "ExecutorLost" in text or "OutOfMemory" in text or "No space left" in text:
        return False
    return isinstance(error, (ValueError, KeyError, TypeError)) or any(x in text for x in UNREADABLE)


def _created(c: dict, check) -> None:
    record: ArchiveRecord = c["record"]
    stored = read_sizes(record.objects, record.path).withColumnRenamed("bytes", "_stored")
    sizes = record.objects.join(stored, "object", "left").agg(
        F.count_if(F.col("_stored").isNull()).alias("missing"),
        F.count_if(F.col("_stored") != F.col("bytes")).alias("resized"),
    ).first()
    check("all objects exist", sizes["missing"] == 0, f"{sizes['missing']} missing")
    if sizes["missing"]:
        return
    check("object sizes as recorded", sizes["resized"] == 0, f"{sizes['resized']} differ")
    manifest, sha = read_manifest(c["spark"], record.path)
    c["manifest"], c["manifest_sha"] = manifest, sha
    identity = (manifest["job_id"], manifest["attempt"], manifest["application"])
    check("manifest names this job and attempt", identity == (record.job_id, record.attempt, record.application))
    boundary = (manifest["boundary"]["first_day"], manifest["boundary"]["last_day"])
    check("boundary as recorded", boundary == (record.first_day, record.last_day), boundary)


def _integrity(c: dict, check) -> None:
    record: ArchiveRecord = c["record"]
    check("manifest digest as recorded", c["manifest_sha"] == record.manifest_sha256, c["manifest_sha"])
    now = read_digests(record.objects, record.path).select("object", F.col("sha256").alias("_now"))
    changed = record.objects.join(now, "object", "left").where(~F.col("sha256").eqNullSafe(F.col("_now"))).count()
    check("object digests as recorded", changed == 0, f"{changed} differ")
    c["schemas"] = read_schema_doc(c["spark"], f"{record.path}/schema")


def _stored(c: dict, table: str) -> tuple[DataFrame, DataFrame]:
    record, plan = c["record"], c["plan"]
    data = read_archive(c["spark"], record.path, table, c["schemas"][table])
    return data, c["spark"].read.schema(KEYS_SCHEMA).parquet(f"{record.path}/keys/{table}")


def _per_table(c: dict, measure: Callable) -> list[tuple[str, object]]:
    """One small aggregate per table, all submitted at once."""
    order = c["plan"].export_order
    return list(zip(order, in_parallel(c["spark"], measure, order)))


def _row_counts(c: dict, check) -> None:
    record, manifest = c["record"], c["manifest"]
    for table, (n_data, n_keys) in _per_table(c, lambda t: [df.count() for df in _stored(c, t)]):
        want = record.rows_by_table.get(table, 0)
        check(f"{table}: data rows as recorded", n_data == want, f"{n_data} vs {want}")
        check(f"{table}: key rows as recorded", n_keys == want, f"{n_keys} vs {want}")
        listed = manifest["tables"].get(table, {}).get("rows", 0)
        check(f"{table}: manifest rows as recorded", listed == want, f"{listed} vs {want}")
    day_sum, row_sum = sum(d[2] for d in manifest["days"]), sum(record.rows_by_table.values())
    check("day totals add up to the rows", day_sum == row_sum, f"{day_sum} vs {row_sum}")


def _key_sets(c: dict, check) -> None:
    def measure(table: str):
        data, keys = _stored(c, table)
        own = data_vs_keys(data, c["plan"].primary_key(table), keys).first()
        return own, key_set_diff(keys, c["record"].candidates[table]).first()

    for table, (own, recorded) in _per_table(c, measure):
        clean = own["only_data"] == own["only_keys"] == own["repeated_keys"] == 0
        check(f"{table}: data keys = frozen keys, none twice", clean, own.asDict())
        check(f"{table}: archived keys = recorded candidates", sum(recorded) == 0, recorded.asDict())


def _restore(c: dict, check) -> None:
    def measure(table: str):
        data, _ = _stored(c, table)
        return restore_reconcile(
            data, c["plan"].primary_key(table), c["record"].candidates[table], c["double_as"]
        ).first()

    for table, r in _per_table(c, measure):
        check(f"{table}: all rows restored", r["restored_rows"] == r["frozen_rows"], r["restored_rows"])
        check(f"{table}: every fingerprint matches", r["mismatches"] == 0, f"{r['mismatches']} mismatches")


def _schema(c: dict, check) -> None:
    record = c["record"]
    check("manifest schema hash as recorded", c["manifest"]["schema_hash"] == record.schema_hash)
    check("live schema unchanged", c["current"] == record.schema_hash, c["current"])

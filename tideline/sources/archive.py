"""Archive files: three formats, object records, schema document, manifest, and the export of a group."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, fields
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.fingerprint import FINGERPRINT_ALGORITHM, row_fingerprint
from tideline.functions.hashes import graph_hash, schema_columns, schema_hash
from tideline.operators.closure import edge_condition, group_rows
from tideline.operators.freeze import (
    PART,
    POSITION,
    candidate_digest,
    chunk_digests,
    chunk_of,
    number_placed,
    place_rows,
)
from tideline.operators.selection import Tables, daily_totals, selected_days
from tideline.plans.group import GroupPlan, edges_frame, require_plannable
from tideline.session import hadoop_path, in_parallel, materialize
from tideline.sources.objects import list_folders, list_objects, read_digests

# Files are cut by about so many bytes, as measured on some rows. Nothing depends on it: objects are read in blocks.
FILE_BYTES, WIDTH_ROWS = 256 * 1024 * 1024, 1_000

CSV_NULL = "\\N"
CSV_OPTIONS = {
    "header": "true",
    "nullValue": CSV_NULL,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "dateFormat": "yyyy-MM-dd",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}

FROZEN_FP = "_frozen_fp"
KEYS_SCHEMA = "rn long, chunk_no long, pk string, fp string, parent_key string"


class TargetNotReached(RuntimeError):
    """The selection never crossed its target, so there is nothing to freeze."""


class UnfaithfulFormat(ValueError):
    """The rows hold values the text format cannot give back exactly."""


def attempt_path(root: str, application: str, job_id: str, attempt: int) -> str:
    """Every attempt has its own folder, so a superseded one can be replaced but never mixed in."""
    return f"{root}/app={application}/job={job_id}/attempt={attempt}"


def discard_attempt(spark: SparkSession, path: str) -> None:
    """Remove what an earlier run of the same attempt left; other attempts are not touched."""
    found, file_system = hadoop_path(spark, path)
    file_system.delete(found, True)


# --- formats -----------------------------------------------------------------------------------------------


def rows_per_file(df: DataFrame) -> int:
    """How many rows as wide as the widest of ``WIDTH_ROWS`` make a file of ``FILE_BYTES``."""
    width = df.limit(WIDTH_ROWS).agg(F.max(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return max(1, FILE_BYTES // max(1, width or 1))


def write_parquet(df: DataFrame, path: str, like: DataFrame | None = None) -> None:
    """``like`` has rows as wide, for a ``df`` that is too costly to look at twice."""
    rows = rows_per_file(df if like is None else like)
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _nested_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


CSV_CLASH = "text equal to the NULL marker in: "


def csv_text(name: str) -> Column:
    """A text column that fails the write where it equals the marker that stands for NULL."""
    column = F.col(f"`{name}`")
    return F.when(column == CSV_NULL, F.raise_error(F.lit(CSV_CLASH + name))).otherwise(column)


def _csv_text_schema(schema: T.StructType) -> T.StructType:
    as_text = (T.BinaryType, T.VariantType)
    fields = [
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, as_text) else f.dataType, True)
        for f in schema.fields
    ]
    return T.StructType(fields)


def write_csv_gz(df: DataFrame, path: str) -> None:
    """Refuses what CSV cannot carry: nested values, and, while writing, text equal to the NULL marker."""
    nested = _nested_columns(df.schema)
    if nested:
        raise UnfaithfulFormat(f"CSV cannot hold nested columns: {', '.join(nested)}")
    columns = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            column = F.base64(column)
        elif isinstance(f.dataType, T.VariantType):
            column = F.to_json(column)
        elif isinstance(f.dataType, T.StringType):
            column = csv_text(f.name)
        columns.append(column.alias(f.name))
    writer = df.select(*columns).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file(df))
    try:
        writer.options(**CSV_OPTIONS).option("compression", "gzip").csv(path)
    except Exception as error:
        if CSV_CLASH not in str(error):
            raise
        raise UnfaithfulFormat(CSV_CLASH + str(error).split(CSV_CLASH, 1)[1].split()[0]) from error


def read_csv_gz(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read back with the archived types; a malformed record fails the read."""
    reader = spark.read.schema(_csv_text_schema(schema)).options(**CSV_OPTIONS)
    rows = reader.option("multiLine", "true").option("mode", "FAILFAST").csv(path)
    columns = []
    for f in schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            column = F.unbase64(column)
        elif isinstance(f.dataType, T.VariantType):
            column = F.parse_json(column)
        columns.append(column.alias(f.name))
    return rows.select(*columns)


_JSON_TIMES = {
    "timestampFormat": CSV_OPTIONS["timestampFormat"],
    "timestampNTZFormat": CSV_OPTIONS["timestampNTZFormat"],
}


def write_jsonl_gz(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file(df)).options(**_JSON_TIMES)
    writer.option("ignoreNullFields", "false").option("compression", "gzip").json(path)


def read_jsonl_gz(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**_JSON_TIMES).option("mode", "FAILFAST").json(path)


FORMATS = {
    "parquet": (write_parquet, read_parquet),
    "csv.gz": (write_csv_gz, read_csv_gz),
    "jsonl.gz": (write_jsonl_gz, read_jsonl_gz),
}


# --- objects -----------------------------------------------------------------------------------------------


def object_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(object, bytes)``; listing only, no object is opened."""
    return list_objects(spark, path)


def object_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``(object, bytes, sha256)`` of the stored bytes."""
    return read_digests(list_objects(spark, path), path)


def archive_bytes(objects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bytes of the data objects only."""
    return objects.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.concat(F.lit("/"), "object").contains("/data/"), F.col("bytes"))), F.lit(0)).alias(
            "data_bytes"
        )
    )


def write_document(spark: SparkSession, path: str, text: str) -> None:
    """One small text document."""
    spark.range(1, numPartitions=1).select(F.lit(text).alias("value")).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", "true").text(path).first()[0].rstrip("\n")


def write_schema_doc(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> None:
    write_document(spark, path, json.dumps({t: s.jsonValue() for t, s in schemas.items()}, sort_keys=True))


def read_schema_doc(spark: SparkSession, path: str) -> dict[str, T.StructType]:
    return {t: T.StructType.fromJson(s) for t, s in json.loads(read_document(spark, path)).items()}


# --- export ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ArchiveRecord:
    """What was recorded at export, kept apart from the archive: later checks trust only this."""

    path: str
    job_id: str
    attempt: int
    application: str
    first_day: str
    last_day: str
    end_day: str
    rows_by_table: dict[str, int]
    manifest_sha256: str
    candidate_digest: str
    schema_hash: str
    graph_hash: str
    objects: DataFrame
    candidates: dict[str, DataFrame]
    chunks: DataFrame


def save_record(record: ArchiveRecord, path: str) -> None:
    """Keep an export record at a place of its own, for checks in a later session."""
    spark = record.objects.sparkSession
    write_parquet(record.objects, f"{path}/objects")
    write_parquet(record.chunks, f"{path}/chunks")
    for table, keys in record.candidates.items():
        write_parquet(keys, f"{path}/candidates/{table}")
    frames = ("objects", "chunks", "candidates")
    scalars = {f.name: getattr(record, f.name) for f in fields(record) if f.name not in frames}
    write_document(spark, f"{path}/record", json.dumps({**scalars, "tables": list(record.candidates)}))


def load_record(spark: SparkSession, path: str) -> ArchiveRecord:
    scalars = json.loads(read_document(spark, f"{path}/record"))
    candidates = {t: spark.read.parquet(f"{path}/candidates/{t}") for t in scalars.pop("tables")}
    objects, chunks = (spark.read.parquet(f"{path}/{name}") for name in ("objects", "chunks"))
    return ArchiveRecord(**scalars, objects=objects, candidates=candidates, chunks=chunks)


def export_table(
    plan: GroupPlan, tables: Tables, table: str, rows: DataFrame, path: str, double_as: str | None = None
) -> None:
    """Write one table's selected ``rows`` in key order.

    Each row carries its place in that order and the fingerprint of its source row. Hashing comes after
    the sort, so sampling the key ranges does not hash every row a second time.
    """
    placed = place_rows(rows, [plan.primary_key(table)])
    stamp = row_fingerprint(rows, double_as=double_as)
    write_parquet(placed.withColumn(FROZEN_FP, stamp), f"{path}/data/{table}", tables[table])


def selected_rows(plan: GroupPlan, tables: Tables, end_day: str) -> dict[str, DataFrame]:
    """The rows of every table of the group. The keys that a table's children ask for are written once."""
    rows: dict[str, DataFrame] = {}
    keys: dict[str, DataFrame] = {}
    for table in plan.export_order:
        if table == plan.spec.root:
            rows[table] = group_rows(plan, tables, table, end_day)
        else:
            edge = plan.links[table]
            parents = keys[edge.parent].select(*edge.parent_columns)
            rows[table] = tables[table].join(parents, edge_condition(tables[table], parents, edge), "left_semi")
        asked = list(dict.fromkeys(c for e in plan.children(table) for c in e.parent_columns))
        if asked:
            keys[table] = materialize(rows[table].select(*asked), "selected")
    return rows


def record_keys(spark: SparkSession, plan: GroupPlan, schema: T.StructType, table: str, path: str) -> DataFrame:
    """Record ``(table_name, rn, chunk_no, pk, fp, parent_key)`` of one exported table.

    Only the key columns of the data files are read, and their recorded order is used as it is: no second
    sort. The record lives outside the archive; the archived keys are a copy of it.
    """
    pk = plan.primary_key(table)
    link = plan.links.get(table)
    parent = link.child_columns[0] if link else None
    wanted = [pk, *([parent] if parent and parent != pk else [])]
    narrow = T.StructType([schema[c] for c in wanted])
    narrow = narrow.add(FROZEN_FP, T.StringType()).add(PART, T.IntegerType()).add(POSITION, T.LongType())
    numbered = number_placed(read_parquet(spark, f"{path}/data/{table}", narrow), "rn")
    keys = numbered.select(
        F.lit(table).alias("table_name"),
        "rn",
        chunk_of(F.col("rn")).alias("chunk_no"),
        F.col(pk).cast("string").alias("pk"),
        F.col(FROZEN_FP).alias("fp"),
        (F.col(parent).cast("string") if parent else F.lit(None).cast("string")).alias("parent_key"),
    )
    return materialize(keys, "candidates")


def one_value(df: DataFrame):
    return df.first()[0]


def freeze_and_export(
    plan: GroupPlan, tables: Tables, root_path: str, job_id: str, attempt: int = 1, double_as: str | None = None
) -> ArchiveRecord:
    """Select, freeze and export a group from one unchanging set of input files.

    Only the selected days (at most one small row per calendar day and table) and counts reach the driver.
    """
    require_plannable(plan)
    spec = plan.spec
    spark = tables[spec.root].sparkSession
    days = day_rows(selected_days(daily_totals(plan, tables), spec.target))
    selected = sum(n for _, _, n in days)
    if selected < spec.target:
        raise TargetNotReached(f"{selected} eligible rows are below the target {spec.target}")
    first_day, last_day = days[0][0], days[-1][0]
    end_day = str(date.fromisoformat(last_day) + timedelta(days=1))
    path = attempt_path(root_path, spec.application, job_id, attempt)
    discard_attempt(spark, path)
    schemas = {t: tables[t].schema for t in spec.tables}

    write_schema_doc(spark, f"{path}/schema", schemas)
    rows = selected_rows(plan, tables, end_day)

    def export(table: str) -> tuple[DataFrame, DataFrame]:
        export_table(plan, tables, table, rows[table], path, double_as)
        recorded = record_keys(spark, plan, schemas[table], table, path)
        write_parquet(recorded.drop("table_name"), f"{path}/keys/{table}")
        return recorded, materialize(chunk_digests(recorded, ["table_name"]), "chunks")

    exported = dict(zip(plan.export_order, in_parallel(spark, export, plan.export_order)))
    candidates = {t: recorded for t, (recorded, _) in exported.items()}
    chunks = reduce(DataFrame.unionByName, (found for _, found in exported.values()))

    def describe() -> tuple[str, str]:
        described = schema_columns(spark, schemas, spec.primary_keys)
        return one_value(schema_hash(described)), one_value(graph_hash(edges_frame(spark, plan.edges)))

    def count_rows() -> dict[str, int]:
        return {r[0]: r[1] for r in chunks.groupBy("table_name").agg(F.sum("row_count")).collect()}

    def list_objects() -> tuple[DataFrame, dict]:
        folders = ["schema", *(f"{part}/{t}" for t in plan.export_order for part in ("data", "keys"))]
        objects = materialize(read_digests(list_folders(spark, path, folders), path), "objects")
        table = F.regexp_extract("object", "^(data|keys)/([^/]+)/", 2).alias("table_name")
        per_table = objects.groupBy(table).agg(F.count(F.lit(1)).alias("objects"), F.sum("bytes").alias("bytes"))
        return objects, {r["table_name"]: r for r in per_table.collect() if r["table_name"]}

    hashes, rows_by_table, digest, (objects, sizes) = in_parallel(
        spark, lambda step: step(),
        [describe, count_rows, lambda: one_value(candidate_digest(chunks)), list_objects],
    )
    manifest = {
        "job_id": job_id,
        "attempt": attempt,
        "application": spec.application,
        "root": spec.root,
        "date_column": spec.date_column,
        "time_zone": spec.time_zone,
        "cutoff_day": spec.cutoff_day,
        "target": spec.target,
        "archive_format": "parquet",
        "boundary": {"first_day": first_day, "last_day": last_day, "end_day": end_day},
        "days": days,
        "tables": {
            t: {
                "rows": rows_by_table.get(t, 0),
                "objects": sizes[t]["objects"] if t in sizes else 0,
                "bytes": sizes[t]["bytes"] if t in sizes else 0,
                "primary_key": plan.primary_key(t),
                "parent": plan.links[t].parent if t in plan.links else None,
            }
            for t in plan.export_order
        },
        "fingerprint": FINGERPRINT_ALGORITHM,
        "candidate_digest": digest,
        "schema_hash": hashes[0],
        "graph_hash": hashes[1],
        "removal_order": list(plan.removal_order),
    }
    manifest_sha = write_manifest(spark, path, manifest)
    return ArchiveRecord(
        path=path, job_id=job_id, attempt=attempt, application=spec.application, first_day=first_day,
        last_day=last_day, end_day=end_day, rows_by_table=rows_by_table, manifest_sha256=manifest_sha,
        candidate_digest=digest, schema_hash=hashes[0], graph_hash=hashes[1], objects=objects,
        candidates=candidates, chunks=chunks,
    )


def day_rows(days: DataFrame) -> list[list]:
    """Day totals for the manifest: as many entries as there are calendar days and tables."""
    return [[str(r["day"]), r["table_name"], r["n"]] for r in days.orderBy("day", "table_name").collect()]


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> str:
    """Write the manifest and return the digest of its text. File lists stay in the object record, not in here."""
    text = json.dumps(manifest, sort_keys=True)
    write_document(spark, f"{path}/manifest", text)
    return text_digest(text)


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def read_manifest(spark: SparkSession, path: str) -> tuple[dict, str]:
    text = read_document(spark, f"{path}/manifest")
    return json.loads(text), text_digest(text)


def read_archive(spark: SparkSession, path: str, table: str, schema: T.StructType) -> DataFrame:
    """Restore one table with its archived column types; damaged files fail the read."""
    return read_parquet(spark, f"{path}/data/{table}", schema)


def format_round_trip(df: DataFrame, fmt: str, path: str) -> DataFrame:
    """Write in one format and read back with the same schema."""
    write, read = FORMATS[fmt]
    write(df, path)
    return read(df.sparkSession, path, df.schema)


def column_fidelity(source: DataFrame, restored: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Restored rows and, per column, how many values differ (NULL-safe), in one pass over one join."""
    columns = [c for c in (columns or source.columns) if c != key]
    copy = restored.select(F.col(key), F.lit(True).alias("_restored"), *(F.col(c).alias(f"_r_{c}") for c in columns))
    joined = source.join(copy, key, "left")

    def differs(c: str) -> Column:
        left, right = F.col(c), F.col(f"_r_{c}")
        if isinstance(source.schema[c].dataType, (T.MapType, T.VariantType)):
            left, right = F.to_json(left), F.to_json(right)
        return ~left.eqNullSafe(right)

    return joined.agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count("_restored").alias("restored_rows"),
        *(F.count_if(differs(c)).alias(c) for c in columns),
    )

"""Archives: formats, objects, documents, restore and verification."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions.fingerprint import row_fingerprint
from tideline.functions.hashes import graph_hash, schema_hash
from tideline.operators import verify
from tideline.operators.freeze import candidate_counts
from tideline.operators.jobs import latest_per_key
from tideline.queries.groups import CENTS, keyed_group
from tideline.queries.registry import Inputs, query
from tideline.session import materialize, scratch_path
from tideline.sources import archive
from tideline.sources.objects import object_state, read_digests, read_sizes, store_of

_DONE: dict[tuple, archive.ArchiveRecord] = {}


def exported(inputs: Inputs) -> tuple[archive.ArchiveRecord, object]:
    """The group's archive, exported once per session and scale."""
    plan, tables = keyed_group(inputs)
    key = (inputs.spark.sparkContext.applicationId, inputs.folder)
    if key not in _DONE:
        # The keyed lines are derived, and counted, measured and exported; a source table would simply be there.
        tables = tables | {"order_lines": materialize(tables["order_lines"], "lines")}
        _DONE[key] = archive.freeze_and_export(
            plan, tables, scratch_path(inputs.spark, "archive"), "job-1", 1, CENTS
        )
    return _DONE[key], plan


_PICKED_LINES = "order_id IN (SELECT pk FROM {frozen_orders})"


@query("export_data", "SELECT pk, fp FROM {frozen_orders}")
def export_data(inputs: Inputs) -> DataFrame:
    record, _ = exported(inputs)
    stored = inputs.spark.read.parquet(f"{record.path}/data/orders")
    return stored.select(F.col("o_orderkey").alias("pk"), F.col(archive.FROZEN_FP).alias("fp"))


@query("export_keys", "SELECT rn, (rn - 1) // 2000 AS chunk_no, pk, fp, parent_key FROM {numbered_lines}")
def export_keys(inputs: Inputs) -> DataFrame:
    record, _ = exported(inputs)
    keys = inputs.spark.read.parquet(f"{record.path}/keys/order_lines")
    return keys.withColumn("pk", F.col("pk").cast("long"))


@query(
    "ordered_export",
    "SELECT count(*) AS n, CAST(0 AS BIGINT) AS overlapping_files FROM {frozen_lines}",
)
def ordered_export(inputs: Inputs) -> DataFrame:
    """Rows in the archived files, and files whose key range runs into that of the next file."""
    record, _ = exported(inputs)
    stored = inputs.spark.read.parquet(f"{record.path}/data/order_lines")
    files = stored.groupBy(F.input_file_name().alias("object")).agg(
        F.min("line_id").alias("first_key"), F.max("line_id").alias("last_key"), F.count(F.lit(1)).alias("n")
    )
    following = F.lead("first_key").over(Window.partitionBy(F.lit(0)).orderBy("first_key"))  # one row per file
    return files.withColumn("_next", following).agg(
        F.sum("n").alias("n"), F.count_if(F.col("last_key") >= F.col("_next")).alias("overlapping_files")
    )


@query(
    "write_schema_doc",
    """
SELECT table_name, unnest(string_split(columns, ',')) AS column_name FROM (
  SELECT 'orders' AS table_name, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns
  UNION ALL SELECT 'order_lines', 'line_id,order_id,pieces,quantity,price,shipped')
""",
)
def schema_doc(inputs: Inputs) -> DataFrame:
    """The columns named by the schema document beside the archive of the orders."""
    record, _ = exported(inputs)
    document = inputs.spark.read.option("wholetext", "true").text(f"{record.path}/schema")
    tables = F.from_json("value", "map<string, struct<fields: array<struct<name: string>>>>")
    listed = document.select(F.explode(tables).alias("table_name", "described"))
    return listed.select("table_name", F.explode("described.fields.name").alias("column_name"))


@query(
    "write_manifest",
    """
SELECT 'job-1' AS job_id, 'orders' AS root, CAST(oldest_day AS VARCHAR) AS first_day,
       CAST(boundary_day AS VARCHAR) AS last_day, (SELECT count(*) FROM {frozen_orders}) AS root_rows,
       (SELECT count(*) FROM {frozen_lines}) AS child_rows
FROM {keyed_picked}
""",
)
def manifest(inputs: Inputs) -> DataFrame:
    record, _ = exported(inputs)
    document = inputs.spark.read.option("wholetext", "true").text(f"{record.path}/manifest")

    def field(path: str):
        return F.get_json_object("value", f"$.{path}")

    return document.select(
        field("job_id").alias("job_id"), field("root").alias("root"),
        field("boundary.first_day").alias("first_day"), field("boundary.last_day").alias("last_day"),
        field("tables.orders.rows").cast("long").alias("root_rows"),
        field("tables.order_lines.rows").cast("long").alias("child_rows"),
    )


@query(
    "attempt_prefix",
    """
SELECT 'shop' AS app, 'job-1' AS job, unnest([1, 2]) AS attempt, count(*) AS n FROM {orders}
""",
)
def attempts(inputs: Inputs) -> DataFrame:
    """Two attempts of one job side by side; the second one is written again without touching the first."""
    root = scratch_path(inputs.spark, "attempts")
    orders = inputs.orders
    for attempt in (1, 2, 2):
        archive.write_parquet(orders, archive.attempt_path(root, "shop", "job-1", attempt))
    rows = inputs.spark.read.option("basePath", root).parquet(f"{root}/app=*/job=*/attempt=*")
    return rows.groupBy("app", "job", "attempt").agg(F.count(F.lit(1)).alias("n"))


@query(
    "read_archive",
    f"""
SELECT line_id, order_id, pieces, CAST(quantity AS VARCHAR) AS quantity, CAST(price AS VARCHAR) AS price,
       CAST(shipped AS VARCHAR) AS shipped FROM {{order_lines}} WHERE {_PICKED_LINES}
""",
)
def restored_lines(inputs: Inputs) -> DataFrame:
    record, _ = exported(inputs)
    schemas = archive.read_schema_doc(inputs.spark, f"{record.path}/schema")
    rows = archive.read_archive(inputs.spark, record.path, "order_lines", schemas["order_lines"])
    return rows.withColumn("quantity", F.col("quantity").cast("string")).withColumn(
        "price", F.col("price").cast("string")
    )


@query(
    "restore_table",
    """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
FROM {orders}, {keyed_picked} WHERE CAST(o_orderdate AS DATE) <= boundary_day
""",
)
def restored_orders(inputs: Inputs) -> DataFrame:
    record, _ = exported(inputs)
    schemas = archive.read_schema_doc(inputs.spark, f"{record.path}/schema")
    return archive.read_archive(inputs.spark, record.path, "orders", schemas["orders"])


def yearly_objects(inputs: Inputs) -> tuple[DataFrame, str]:
    """The record of an archive with one object of orders for each year, and its path, after some objects were damaged.

    Of every four years one lost its object, one has a byte too many, and in one a byte was turned.
    """
    path = scratch_path(inputs.spark, "yearly")
    dated = inputs.orders.withColumn("year", F.year("o_orderdate"))
    dated.repartition("year").sortWithinPartitions("o_orderkey").write.partitionBy("year").parquet(path)
    recorded = materialize(archive.object_checksums(inputs.spark, path).select("*", object_year()), "recorded")

    def damage(batches):
        store, top = store_of(path)
        for batch in batches:
            for name, sha, year in zip(*(c.to_pylist() for c in batch.columns)):
                place = f"{top}/{name}"
                if year % 4 == 0:
                    if store.get_file_info(place).type.name == "File":
                        store.delete_file(place)
                    continue
                with store.open_input_stream(place, compression=None) as stream:
                    raw = stream.read()
                # A task that runs again finds its work done.
                if year % 4 < 3 and hashlib.sha256(raw).hexdigest() == sha:
                    raw = raw + b"x" if year % 4 == 1 else raw[:9] + bytes([raw[9] ^ 1]) + raw[10:]
                    with store.open_output_stream(place, compression=None) as stream:
                        stream.write(raw)
            yield batch

    recorded.select("object", "sha256", "year").mapInArrow(damage, "object string, sha256 string, year int").count()
    return recorded, path


def object_year() -> Column:
    return F.regexp_extract("object", "year=([0-9]+)/", 1).cast("int").alias("year")


_YEARS = """
SELECT CAST(year AS INT) AS year, CASE year % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'resized' WHEN 2 THEN '{}' ELSE 'present' END AS state
FROM (SELECT DISTINCT year(o_orderdate) AS year FROM {{orders}})
"""


@query("object_metadata", _YEARS.format("present"))
def metadata(inputs: Inputs) -> DataFrame:
    recorded, path = yearly_objects(inputs)
    state = object_state(recorded.select("object", "bytes"), read_sizes(recorded, path))
    return state.select(object_year(), "state")


@query("object_checksum", _YEARS.format("changed"))
def checksums(inputs: Inputs) -> DataFrame:
    recorded, path = yearly_objects(inputs)
    return object_state(recorded, read_digests(recorded, path)).select(object_year(), "state")


@query(
    "archive_bytes",
    """
SELECT job_id, coalesce(CAST(sum(bytes) FILTER (contains('/' || object, '/data/')) AS BIGINT), 0) AS data_bytes
FROM {objects} GROUP BY 1
""",
)
def data_bytes(inputs: Inputs) -> DataFrame:
    return archive.archive_bytes(inputs.objects, ["job_id"])


_ZERO = "CAST(0 AS BIGINT)"
_FIDELITY = f"""
SELECT count(*) AS source_rows, count(*) AS restored_rows, {_ZERO} AS ts, {_ZERO} AS user_id, {_ZERO} AS event_type,
       {_ZERO} AS value, {_ZERO} AS props FROM {{events}}
"""


def round_trip(inputs: Inputs, fmt: str) -> DataFrame:
    events = inputs.events
    copy = archive.format_round_trip(events, fmt, scratch_path(inputs.spark, "format"))
    return archive.column_fidelity(events, copy, "event_id")


@query("format_csv_gz", _FIDELITY)
def csv_gz(inputs: Inputs) -> DataFrame:
    return round_trip(inputs, "csv.gz")


@query("format_jsonl_gz", _FIDELITY)
def jsonl_gz(inputs: Inputs) -> DataFrame:
    return round_trip(inputs, "jsonl.gz")


@query("format_parquet", _FIDELITY)
def parquet(inputs: Inputs) -> DataFrame:
    return round_trip(inputs, "parquet")


@query(
    "column_fidelity",
    """
SELECT count(*) AS source_rows, count(*) FILTER (o_orderkey % 103 <> 0) AS restored_rows,
       count(*) FILTER (o_orderkey % 103 = 0) AS o_custkey, count(*) FILTER (o_orderkey % 103 = 0) AS o_orderstatus,
       count(*) FILTER (o_orderkey % 103 = 0 OR o_orderkey % 101 = 0) AS o_totalprice,
       count(*) FILTER (o_orderkey % 103 = 0) AS o_orderdate, count(*) FILTER (o_orderkey % 103 = 0) AS o_orderpriority
FROM {orders}
""",
)
def fidelity(inputs: Inputs) -> DataFrame:
    return archive.column_fidelity(inputs.orders, inputs.live_orders, "o_orderkey")


def live_fps(inputs: Inputs) -> DataFrame:
    live = inputs.live_orders
    return live.select(F.col("o_orderkey").alias("pk"), row_fingerprint(live, double_as=CENTS).alias("fp"))


@query(
    "key_set_diff",
    """
WITH f AS (SELECT pk, fp FROM {frozen_orders}), v AS (SELECT pk, fp FROM {live_order_keys})
SELECT count(*) FILTER (v.pk IS NULL) AS only_left, count(*) FILTER (f.pk IS NULL) AS only_right,
       count(*) FILTER (f.fp <> v.fp) AS different_fp
FROM f FULL JOIN v ON f.pk = v.pk
""",
)
def key_diff(inputs: Inputs) -> DataFrame:
    from tideline.queries.removal import frozen

    return verify.key_set_diff(frozen(inputs)["orders"], live_fps(inputs))


@query(
    "data_vs_keys",
    """
WITH d AS (SELECT l_orderkey * 8 + l_linenumber AS pk, count(*) AS n FROM {lineitem} GROUP BY 1),
     k AS (SELECT line_id AS pk FROM {live_lines})
SELECT CAST(sum(d.n) AS BIGINT) AS data_rows, count(k.pk) AS key_rows, count(*) FILTER (k.pk IS NULL) AS only_data,
       count(*) FILTER (d.pk IS NULL) AS only_keys, count(*) FILTER (d.n > 1) AS repeated_keys
FROM d FULL JOIN k ON d.pk = k.pk
""",
)
def data_keys(inputs: Inputs) -> DataFrame:
    data = inputs.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"))
    return verify.data_vs_keys(data, "line_id", inputs.live_lines.select(F.col("line_id").alias("pk")))


@query(
    "restore_reconcile",
    """
SELECT count(*) AS restored_rows, count(*) AS frozen_rows, CAST(0 AS BIGINT) AS mismatches FROM {frozen_lines}
""",
)
def reconcile_restore(inputs: Inputs) -> DataFrame:
    record, plan = exported(inputs)
    schemas = archive.read_schema_doc(inputs.spark, f"{record.path}/schema")
    rows = archive.read_archive(inputs.spark, record.path, "order_lines", schemas["order_lines"])
    frozen = record.candidates["order_lines"]
    return verify.restore_reconcile(rows, plan.primary_key("order_lines"), frozen, CENTS)


@query(
    "day_sum_vs_rows",
    """
SELECT CAST(sum(n) AS BIGINT) AS day_sum, (SELECT count(*) FROM {frozen_orders}) + (SELECT count(*) FROM {frozen_lines})
         AS row_sum, sum(n) = (SELECT count(*) FROM {frozen_orders}) + (SELECT count(*) FROM {frozen_lines}) AS equal
FROM {keyed_marked} WHERE selected
""",
)
def day_sums(inputs: Inputs) -> DataFrame:
    from tideline.operators.selection import daily_totals, selected_days

    record, plan = exported(inputs)
    _, tables = keyed_group(inputs)
    days = selected_days(daily_totals(plan, tables), plan.spec.target)
    return verify.day_sum_vs_rows(days, record.chunks.select(F.col("row_count").alias("n")))


@query(
    "verification_gate",
    """
WITH t AS (SELECT unnest(['orders', 'order_lines']) AS t)
SELECT 'archive_created' AS stage, unnest(['all objects exist', 'object sizes as recorded',
       'manifest names this job and attempt', 'boundary as recorded']) AS name, true AS pass
UNION ALL SELECT 'archive_integrity', unnest(['manifest digest as recorded', 'object digests as recorded']), true
UNION ALL SELECT 'archive_row_count', t || ': data rows as recorded', true FROM t
UNION ALL SELECT 'archive_row_count', t || ': key rows as recorded', true FROM t
UNION ALL SELECT 'archive_row_count', t || ': manifest rows as recorded', true FROM t
UNION ALL SELECT 'archive_row_count', 'day totals add up to the rows',
  (SELECT sum(n) FROM {keyed_marked} WHERE selected)
   = (SELECT count(*) FROM {frozen_orders}) + (SELECT count(*) FROM {frozen_lines})
UNION ALL SELECT 'archive_key_set', t || ': data keys = frozen keys, none twice', true FROM t
UNION ALL SELECT 'archive_key_set', t || ': archived keys = recorded candidates', true FROM t
UNION ALL SELECT 'restore_fingerprint', t || ': all rows restored', true FROM t
UNION ALL SELECT 'restore_fingerprint', t || ': every fingerprint matches', true FROM t
UNION ALL SELECT 'schema_hash', unnest(['manifest schema hash as recorded', 'live schema unchanged']), true
""",
)
def gate(inputs: Inputs) -> DataFrame:
    record, plan = exported(inputs)
    result = verify.run_gate(inputs.spark, plan, record, record.schema_hash, CENTS)
    return result.checks.select("stage", "name", "pass")


_STAGES_SQL = """
stages AS (
  SELECT unnest([1, 2, 3, 4, 5, 6]) AS stage_no,
         unnest(['archive_created', 'archive_integrity', 'archive_row_count', 'archive_key_set',
                 'restore_fingerprint', 'schema_hash']) AS stage
), staged AS (
  SELECT j.job_id, s.stage_no, s.stage, count(c.stage) AS checks, coalesce(bool_and(c.pass), false) AS passed
  FROM (SELECT DISTINCT job_id FROM {checks}) j CROSS JOIN stages s
  LEFT JOIN {checks} c ON c.job_id = j.job_id AND c.stage = s.stage GROUP BY 1, 2, 3
)
"""


@query("stage_passed", f"WITH {_STAGES_SQL} SELECT job_id, stage_no, stage, checks, passed FROM staged")
def stages(inputs: Inputs) -> DataFrame:
    return verify.stage_results(inputs.checks, ["job_id"])


@query(
    "gate_verdict",
    f"""
WITH {_STAGES_SQL}
SELECT job_id, bool_and(passed) AS verified,
       arg_min(stage, stage_no) FILTER (checks > 0 AND NOT passed) AS failed_stage FROM staged GROUP BY 1
""",
)
def verdicts(inputs: Inputs) -> DataFrame:
    return verify.gate_verdict(inputs.checks, ["job_id"])


@query(
    "candidate_counts",
    """
SELECT job_id, attempt, table_name, CAST(sum(row_count) AS BIGINT) AS n, bool_and(key_count = row_count) AS intact
FROM {candidates} GROUP BY 1, 2, 3
""",
)
def counts(inputs: Inputs) -> DataFrame:
    return candidate_counts(inputs.candidates, ["job_id", "attempt"])


@query(
    "latest_per_key",
    """
SELECT job_id, attempt, verification_id, verified, failed_stage, CAST(verified_at AS VARCHAR) AS verified_at
FROM {verifications}
QUALIFY row_number() OVER (PARTITION BY job_id, attempt ORDER BY verification_id DESC) = 1
""",
)
def latest(inputs: Inputs) -> DataFrame:
    return latest_per_key(inputs.verifications, ["job_id", "attempt"], ["verification_id"])


_COLUMN_JSON = """'{"table_name":"' || table_name || '","ordinal":' || ordinal || ',"column_name":"' || column_name ||
  '","data_type":"' || data_type || '","default_expr":' || coalesce('"' || default_expr || '"', 'null') || '}'"""


@query(
    "schema_hash",
    f"""
SELECT app_id, sha256('[' || string_agg({_COLUMN_JSON}, ',' ORDER BY table_name, ordinal, column_name) || ']')
         AS schema_hash
FROM {{table_columns}} GROUP BY 1
""",
)
def schema_hashes(inputs: Inputs) -> DataFrame:
    return schema_hash(inputs.table_columns, ["app_id"])


@query(
    "graph_hash",
    """
SELECT app_id, sha256('[' || string_agg('{"name":"' || name || '","child":"' || child || '","on_delete":"' ||
         on_delete || '","parent":"' || parent || '"}', ',' ORDER BY name) || ']') AS graph_hash
FROM {edges} GROUP BY 1
""",
)
def graph_hashes(inputs: Inputs) -> DataFrame:
    return graph_hash(inputs.edges, ["app_id"])

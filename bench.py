"""Headline timings on the driver's tables; prints one JSON line.

The steps follow the measured work of a retention run: hash every row, select and count whole days, freeze and
export, verify with a full restore, remove exactly, and round-trip each file format. Registered queries of the
other areas follow.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.fingerprint import row_fingerprint, row_fingerprint_md5
from tideline.operators.freeze import distinct_fingerprints
from tideline.operators.removal import exact_removal
from tideline.operators.verify import run_gate
from tideline.queries import load
from tideline.queries.groups import CENTS, keyed_group, live_group
from tideline.queries.registry import QUERIES, Inputs
from tideline.session import build_session, in_parallel, scratch_path
from tideline.sources import archive

QUERY_NAMES = (
    "whole_day_selection", "preview_exclusions", "split_group_detection", "row_fingerprint", "chunk_digest",
    "range_delete_risk", "growth_average", "lateness_percentiles", "table_health", "app_health_rollup",
    "attention_rank", "alert_transitions", "job_progress", "job_steps", "approval_quorum", "policy_validation",
    "removal_eligibility", "redact_text", "stream_daily_totals", "stream_alerts",
)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def retention_run(inputs: Inputs, timed: Callable) -> dict[str, int]:
    """Freeze, export, verify and remove one group; returns the rows of each step."""
    spark = inputs.spark
    plan, tables = keyed_group(inputs)
    # The keyed lines are derived; a source table would simply be there.
    tables = {name: stored(inputs, df) for name, df in tables.items()}
    live = {name: stored(inputs, df) for name, df in live_group(inputs).items()}
    record = timed(
        "freeze_export",
        lambda: archive.freeze_and_export(plan, tables, scratch_path(spark, "bench"), "bench", 1, CENTS),
    )
    gate = timed("verify_with_restore", lambda: run_gate(spark, plan, record, record.schema_hash, CENTS))
    if not gate.verified:
        raise RuntimeError(f"archive not verified: {gate.failed_stage}")
    frozen = {
        t: keys.select(F.col("pk").cast("long").alias("pk"), "fp") for t, keys in record.candidates.items()
    }

    def remove() -> None:
        _, remaining = exact_removal(plan, frozen, live, CENTS)
        in_parallel(spark, lambda rows: rows.write.parquet(scratch_path(spark, "survivors")), remaining.values())

    timed("exact_removal", remove)
    return dict(record.rows_by_table)


def stored(inputs: Inputs, df: DataFrame) -> DataFrame:
    """A copy in as many files as there are cores, as a real table would have many."""
    path = scratch_path(inputs.spark, "input")
    df.repartition(inputs.spark.sparkContext.defaultParallelism).write.parquet(path)
    return inputs.spark.read.schema(df.schema).parquet(path)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load()
    spark = build_session(
        "bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
        {"spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    inputs = Inputs(spark, folder)
    seconds: dict[str, float] = {}

    def timed(name: str, run: Callable):
        started = time.perf_counter()
        result = run()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
        return result

    drain(inputs.orders.select(row_fingerprint(inputs.orders)))  # starts the executor threads and the compiler
    lines = stored(inputs, inputs.lineitem)
    for name, expression in (("sha256", row_fingerprint), ("md5", row_fingerprint_md5)):
        timed(
            f"fingerprint_{name}",
            lambda e=expression: distinct_fingerprints(lines.select(e(lines).alias("fp"))).collect(),
        )
    rows = retention_run(inputs, timed)
    for fmt, (write, read) in archive.FORMATS.items():
        path = scratch_path(spark, "format")
        timed(f"export_{fmt}", lambda: write(lines, path))
        timed(f"restore_{fmt}", lambda: drain(read(spark, path, lines.schema)))
    for name in QUERY_NAMES:
        timed(name, lambda n=name: drain(QUERIES[n].run(inputs)))
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "rows": {"fingerprinted": lines.count(), **{f"frozen_{t}": n for t, n in rows.items()}},
            }
        )
    )


if __name__ == "__main__":
    main()

"""Stored objects of an archive: listed and read by tasks, block by block.

Folders are listed level by level, each by a task, so no list of files is made in the driver; paths reach the tasks as rows
of a table. An object is read in blocks of ``BLOCK_BYTES`` and its SHA-256 carried from block to block, so an object of any size
costs one block of memory. A task gets about ``TASK_BYTES`` of objects; one digest is never cut between tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import materialize

BLOCK_BYTES, TASK_BYTES, LISTED = 8 << 20, 1 << 30, 10_000


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (local, file:, hdfs:, s3:, gs:) and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies directly in each folder: its name below the archive, whether it is a folder, and its size."""
    for batch in batches:
        for root, folder in zip(*(c.to_pylist() for c in batch.columns)):
            store, inner = store_of(root)
            top = inner.rstrip("/")
            found = store.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"), allow_not_found=True))
            rows = [
                {"object": x.path[len(top) :].lstrip("/"), "folder": x.type == fs.FileType.Directory, "bytes": x.size or 0}
                for x in found
                if not x.base_name.startswith((".", "_"))
            ]
            for at in range(0, len(rows), LISTED):
                yield pa.RecordBatch.from_pylist(rows[at : at + LISTED], schema=_LISTED)


_LISTED = pa.schema([("object", pa.string()), ("folder", pa.bool_()), ("bytes", pa.int64())])


def list_folders(spark: SparkSession, path: str, folders: Sequence[str]) -> DataFrame:
    """``(object, bytes)`` of what lies directly in some folders below ``path``, each listed by a task of its own."""
    level = spark.createDataFrame([(path, f) for f in folders], "root string, folder string").repartition(len(folders), "folder")
    listed = materialize(level.mapInArrow(_entries, "object string, folder boolean, bytes long"), "listed")
    return listed.where("NOT folder").select("object", "bytes")


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """``(object, bytes)`` of every stored object below ``path``; no object is opened.

    Names that begin with a dot or an underscore are the writers' own marks and no objects. A folder that is not
    there has no objects. Each level of folders is one job.
    """
    level = spark.range(1).select(F.lit(path).alias("root"), F.lit("").alias("folder"))
    found = None
    while True:
        listed = materialize(level.mapInArrow(_entries, "object string, folder boolean, bytes long"), "listed")
        objects = listed.where("NOT folder").select("object", "bytes")
        found = objects if found is None else found.unionByName(objects)
        folders = listed.where("folder")
        count = folders.count()
        if not count:
            return found
        below = folders.select(F.lit(path).alias("root"), F.col("object").alias("folder"))
        level = below.repartition(min(count, LISTED), "folder")


def block_digest(stream, block_bytes: int = BLOCK_BYTES) -> tuple[int, str]:
    """Size and SHA-256 of a stream, in memory of one block."""
    state, size = hashlib.sha256(), 0
    while block := stream.read(block_bytes):
        state.update(block)
        size += len(block)
    return size, state.hexdigest()


def read_digests(objects: DataFrame, path: str, task_bytes: int = TASK_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(object, bytes, sha256)`` of ``objects(object, bytes)`` as they are stored below ``path`` now.

    An object that is not there has null bytes and a null digest. ``bytes`` only deals the objects out; the size
    returned is what was read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    with store.open_input_stream(f"{top.rstrip('/')}/{name}", compression=None, buffer_size=0) as stream:
                        size, digest = block_digest(stream, block_bytes)
                except FileNotFoundError:
                    size, digest = None, None
                yield pa.RecordBatch.from_pylist([{"object": name, "bytes": size, "sha256": digest}], schema=_READ)

    dealt = objects.select("object", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    total = dealt.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    floor = int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(total[1], max(floor, -(-total[0] // task_bytes))))
    spread = dealt.withColumn("_turn", F.pmod(F.xxhash64("object"), F.lit(tasks)))
    return spread.repartition(tasks, "_turn").select("object").mapInArrow(run, "object string, bytes long, sha256 string")


_READ = pa.schema([("object", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())])


def read_sizes(objects: DataFrame, path: str) -> DataFrame:
    """``(object, bytes)`` of ``objects(object)`` as they are stored below ``path`` now; null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(path)
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = store.get_file_info([f"{top.rstrip('/')}/{name}" for name in names])
            sizes = [x.size if x.type == fs.FileType.File else None for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["object", "bytes"])

    return objects.select("object").mapInArrow(run, "object string, bytes long")


def object_state(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """``(object, state)`` of recorded and stored objects: present, missing, resized, changed, or unrecorded.

    ``recorded`` is ``(object, bytes)``, and ``now`` too; where both have ``sha256``, contents are compared as well.
    """
    digests = "sha256" in recorded.columns and "sha256" in now.columns
    columns = ["bytes", *(["sha256"] if digests else [])]
    kept = recorded.select("object", *columns, F.lit(True).alias("_recorded"))
    stored = now.select("object", *(F.col(c).alias(f"_now_{c}") for c in columns))
    both = kept.join(stored, "object", "full_outer")
    state = (
        F.when(F.col("_recorded").isNull(), "unrecorded")
        .when(F.col("_now_bytes").isNull(), "missing")
        .when(F.col("bytes") != F.col("_now_bytes"), "resized")
    )
    if digests:
        state = state.when(F.col("sha256") != F.col("_now_sha256"), "changed")
    return both.select("object", state.otherwise("present").alias("state"))

"""Stored objects: listing, sizes and digests by tasks."""

import hashlib
import io
import os

import pytest

from tideline.sources import objects


def put(folder, name, raw):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as file:
        file.write(raw)


@pytest.fixture
def stored(folder):
    raws = {f"data/t{i % 3}/part-{i}": os.urandom(i * 997) for i in range(12)} | {"schema/part-0": b"{}", "top": b"x" * 5000}
    for name, raw in raws.items():
        put(folder, name, raw)
    put(folder, "data/t0/_SUCCESS", b"")
    put(folder, "data/t0/.part-0.crc", b"1")
    return raws


def test_listing(spark, folder, stored):
    found = {r.object: r.bytes for r in objects.list_objects(spark, folder).collect()}
    assert found == {n: len(raw) for n, raw in stored.items()}
    some = objects.list_folders(spark, f"file:{folder}", ["data/t1", "schema", "gone"])
    assert {r.object for r in some.collect()} == {n for n in stored if n.startswith(("data/t1/", "schema/"))}
    assert objects.list_objects(spark, f"{folder}/nothing").collect() == []


@pytest.mark.parametrize("block", [1, 1000, 8 << 20])
def test_digests_in_blocks(spark, folder, stored, block):
    listed = objects.list_objects(spark, folder)
    found = {r.object: (r.bytes, r.sha256) for r in objects.read_digests(listed, folder, block_bytes=block).collect()}
    assert found == {n: (len(raw), hashlib.sha256(raw).hexdigest()) for n, raw in stored.items()}


def test_an_object_larger_than_memory_allows():
    """Three gigabytes are read with one block held at a time."""

    class Zeros(io.RawIOBase):
        left, most = 3 << 30, 0

        def read(self, n):
            n = min(n, self.left)
            self.left, self.most = self.left - n, max(self.most, n)
            return memoryview(BLOCK)[:n]

    BLOCK = bytes(objects.BLOCK_BYTES)
    stream = Zeros()
    size, _ = objects.block_digest(stream)
    assert size == 3 << 30 and stream.most == objects.BLOCK_BYTES


def test_states(spark, folder, stored):
    recorded = spark.createDataFrame(objects.read_digests(objects.list_objects(spark, folder), folder).collect())
    os.remove(f"{folder}/data/t1/part-1")
    put(folder, "data/t2/part-2", stored["data/t2/part-2"] + b"x")
    put(folder, "data/t0/part-3", b"\x01" + stored["data/t0/part-3"][1:] if stored["data/t0/part-3"][0] != 1 else b"\x02" + stored["data/t0/part-3"][1:])
    put(folder, "data/t0/part-99", b"new")
    want = {"data/t1/part-1": "missing", "data/t2/part-2": "resized", "data/t0/part-3": "changed", "data/t0/part-99": "unrecorded"}
    listed = objects.list_objects(spark, folder)
    found = {r.object: r.state for r in objects.object_state(recorded, objects.read_digests(listed, folder)).collect()}
    assert {n: s for n, s in found.items() if s != "present"} == want and set(found) == {*stored, "data/t0/part-99"}
    sizes = objects.object_state(recorded.select("object", "bytes"), objects.read_sizes(recorded, folder))
    found = {r.object: r.state for r in sizes.collect()}
    assert {n: s for n, s in found.items() if s != "present"} == {"data/t1/part-1": "missing", "data/t2/part-2": "resized"}
    again = {r.object: r.sha256 for r in objects.read_digests(recorded, folder).collect()}
    assert again["data/t1/part-1"] is None and len(again) == len(stored)


def test_no_objects(spark, folder):
    none = spark.createDataFrame([], "object string, bytes long")
    assert objects.read_digests(none, folder).collect() == [] and objects.read_sizes(none, folder).collect() == []

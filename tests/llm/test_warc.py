"""Archives read back as they were written, whole and by selection."""

import base64
import gzip
import hashlib

import pytest

from tideline.llm import warc
from tideline.llm.files import open_file

SCHEMA = "page_id long, url string, html string, path string, offset long"


def rows():
    texts = ["<p>a</p>", None, "", "<p>a</p>", "é\r\n\r\nWARC/1.1", "x" * 300_000, "<p>a</p>", "é\r\n\r\nWARC/1.1"]
    made = [(i, f"http://h/ü?{i}" if i % 3 else None, t, "clash", 5) for i, t in enumerate(texts)]
    return [*made, (7, "again", "<p>a</p>", "c", 1), (None, "n", "<p>a</p>", "c", 1), (None, "n", "only null", "c", 1), (0, "twice", "<p>a</p>", "c", 1)]


def want(min_bytes):
    out = []
    for page_id, _, html, *_ in rows():
        data = (html or "").encode()
        same = [p for p, _, h, *_ in rows() if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        revisit = len(data) >= min_bytes and first is not None and (page_id is None or page_id > first)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    got = warc.round_trip(spark.createDataFrame(rows(), SCHEMA), min_bytes).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == want(min_bytes)


def test_selection_by_byte_ranges(spark, folder):
    index = warc.write(spark.createDataFrame(rows(), SCHEMA), folder, file_bytes=600)
    listed = index.collect()
    assert len({r.path for r in listed}) > 1
    for r in listed:
        with open_file(r.path) as file:
            file.seek(r.offset)
            assert gzip.decompress(file.read(r.length)).startswith(b"WARC/1.1\r\n")
    some = warc.read(index.where("page_id % 2 = 0")).collect()
    by_id = {}
    for p, u, h, *_ in rows():
        by_id.setdefault(p, []).append((u, (h or "").encode()))
    assert len(some) == sum(1 for p, *_ in rows() if p is not None and p % 2 == 0)
    for r in some:
        assert any(r.url == u and (r.payload is None or bytes(r.payload) == h) for u, h in by_id[r.page_id])


def test_damage_is_noticed():
    good = warc.make_record(1, "u", b"payload", warc.payload_digest(b"payload"), None, False)
    assert warc.parse_record(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(warc.make_record(1, "u", b"payload", warc.payload_digest(b"other"), None, False))


def test_no_rows(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0

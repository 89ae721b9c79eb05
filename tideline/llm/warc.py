"""WARC archives: writing with an index of every record, and reading selected records by coalesced byte ranges.

The index comes first: file, offset, length, URL and payload digest of each record, as the writing tasks report them.
Reading starts from any selection of index rows, sorts them by file and offset, joins neighbours into one range read when
the gap is at most ``GAP`` bytes and the range at most ``RANGE``, and cuts the records out of it. Records are gzip members of
their own, so a range of members decodes without the rest of the file.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.files import AtomicFile, open_file
from tideline.session import materialize, scratch_path

GAP, RANGE = 64 * 1024, 8 * 1024 * 1024
FILE_BYTES, TASK_BYTES = 256 * 1024 * 1024, 16 * 1024 * 1024
MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "path string, offset long, length long, url string, digest string, record_type string, page_id long"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the response's HTTP head and leaves its payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=-._~''')}")
    fields += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    fields.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> dict:
    """A record's fields and payload; a revisit's payload is None, its size that of the response it stands for."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")

    def number(field: str) -> int | None:
        text = fields.get(field, "")[len("<urn:page:") : -1]
        return int(text) if text else None

    uri = fields.get("WARC-Target-URI")
    return {
        "page_id": number("WARC-Record-ID"), "url": None if uri is None else unquote(uri), "record_type": fields["WARC-Type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": number("WARC-Refers-To"), "payload": None if revisit else payload,
    }


def first_of_each(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, first`` of the pages that revisit another: same payload, of ``min_bytes`` or more, and a larger id.

    All pages with the smallest id of their payload are responses; null ids come after all others, and payloads that
    only have null ids revisit nothing.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    seen = pages.where(F.length(payload) >= min_bytes).select("page_id", F.sha1(payload).alias("sha1"))
    seen = materialize(seen, "payloads")
    firsts = seen.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    later = seen.join(firsts.select("sha1", "first"), "sha1")
    return later.where("page_id IS NULL OR page_id > first").select("page_id", "sha1", "first").distinct()


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The index of the archives written below ``folder`` from ``pages(page_id, url, html)``, a record per row."""
    chosen = pages.select("page_id", "url", "html")
    revisits = materialize(first_of_each(chosen, min_bytes), "revisits").select(F.col("page_id").alias("p"), F.col("sha1").alias("h"), "first")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    matched = chosen.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.sha1(payload) == F.col("h")), "left")
    ready = matched.select("page_id", "url", payload.alias("payload"), F.col("h").isNotNull().alias("revisit"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, serial, file = TaskContext.get().partitionId(), 0, None
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, revisit, first in zip(*batch.columns):
                    body, address = html.as_py(), url.as_py()
                    if file is None or file.offset >= file_bytes:
                        if file is not None:
                            file.close()
                        target = f"{folder}/pages-{number:06d}-{serial:04d}.warc.gz"
                        file, serial = AtomicFile(target), serial + 1
                    digest = payload_digest(body)
                    data = make_record(page_id.as_py(), address, body, digest, first.as_py(), revisit.as_py())
                    kind = "revisit" if revisit.as_py() else "response"
                    rows.append((target, file.offset, len(data), address, digest, kind, page_id.as_py()))
                    file.write(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, listed.types)], schema=listed)
            if file is not None:
                file.close()
        except BaseException:
            if file is not None:
                file.discard()
            raise

    strings, longs = pa.string(), pa.int64()
    listed = pa.schema(list(zip(["path", "offset", "length", "url", "digest", "record_type", "page_id"], [strings, longs, longs, strings, strings, strings, longs])))
    return materialize(ready.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` rows point to: ``page_id, url, record_type, payload_bytes, payload_digest, refers_to`` and
    ``payload`` (null for revisits), each checked against its digest."""
    lined = index.select("path", "offset", "length")
    # A stated number of tasks, by the bytes to read: the few bytes of the index would be coalesced to one task.
    tasks = 1 + (lined.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES
    lined = lined.repartition(tasks, "path", F.floor(F.col("offset") / RANGE)).sortWithinPartitions("path", "offset")
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, int]] = []
        names = [*(f.split()[0] for f in schema.split(", ")), *(["payload"] if payloads else [])]
        kinds = dict(page_id=pa.int64(), url=pa.string(), record_type=pa.string(), payload_bytes=pa.int64(), payload_digest=pa.string(), refers_to=pa.int64(), payload=pa.binary())
        stream, opened = None, None

        def flush() -> pa.RecordBatch:
            nonlocal stream, opened
            path, start = held[0][0], held[0][1]
            if path != opened:
                if stream is not None:
                    stream.close()
                stream, opened = open_file(path), path
            stream.seek(start)
            data = memoryview(stream.read(max(o + n for _, o, n in held) - start))
            found = [parse_record(data[o - start : o - start + n]) for _, o, n in held]
            return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], kinds[n]) for n in names], names=names)

        for batch in batches:
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if held:
                    last, at, size = held[-1]
                    if path != last or offset > at + size + GAP or offset + length - held[0][1] > RANGE:
                        yield flush()
                        held = []
                held.append((path, offset, length))
        if held:
            yield flush()
        if stream is not None:
            stream.close()

    return lined.mapInArrow(run, schema + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes all pages to the shared folder and reads every record back."""
    index = write(pages, scratch_path(pages.sparkSession, "warc"), min_bytes)
    return read(index, payloads=False)

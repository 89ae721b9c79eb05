"""Token ids in binary files: ids ranked by frequency, byte-aligned variable-length codes, control bytes apart.

Documents are laid out in ascending id order, null first, over numbered files. A file is a run of segments of about
``SEGMENT`` ids (a document is never split), each complete in itself, so that memory stays bounded and a lost task writes
its file again by itself. A segment has, all little-endian:

    8 bytes   magic and version
    5 x u32   documents, ids, distinct ids, control bytes, data bytes
    u32 each  the distinct ids, most frequent first (ties: smaller id); an id's code is its place
    i64, u8   document id, and 1 if it has one, per document
    u32 each  ids per document
    control   2 bits per code, 4 codes to a byte, low bits first: bytes of the code less one
    data      the codes, 1 to 4 bytes each

Decoding looks the control byte up in a table of byte places and gathers all codes at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.bpe import TOKENIZER, by_bytes
from tideline.llm.files import AtomicFile, open_file
from tideline.llm.tokens import library_text_encoder
from tideline.session import materialize, scratch_path

MAGIC = b"TIDTOK\x00\x01"
SEGMENT = 1 << 20
END_ID = 2

_SIZES = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)])
_TOTALS = _SIZES.sum(axis=1)
#: For each control byte, the place of each of the 4 x 4 bytes from where its codes begin; -1: a zero byte.
_PLACES = np.array(
    [[[sizes[:i].sum() + b if b < sizes[i] else -1 for b in range(4)] for i in range(4)] for sizes in _SIZES], np.int32
)


def encode_codes(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit codes."""
    codes = codes.astype("<u4")
    padded = np.concatenate((codes, np.zeros(-len(codes) % 4, "<u4")))
    sizes = 1 + (padded > 0xFF) + (padded > 0xFFFF) + (padded > 0xFFFFFF).astype(np.int64)
    control = ((sizes.reshape(-1, 4) - 1) << np.arange(0, 8, 2)).sum(axis=1).astype(np.uint8)
    data = padded.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]]
    return control.tobytes(), data.tobytes()


def decode_codes(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The first ``count`` codes."""
    own = np.frombuffer(control, np.uint8)
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(1, np.uint8)))
    ends = np.cumsum(_TOTALS[own])
    places = _PLACES[own]
    spots = np.where(places < 0, len(raw) - 1, places + (ends - _TOTALS[own]).astype(np.int32)[:, None, None])
    return raw[spots].reshape(-1, 4).copy().view("<u4").ravel()[:count]


def pack_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    present = np.flatnonzero(seen)
    ranked = present[np.lexsort((present, -seen[present]))].astype("<u4")
    code = np.zeros(len(seen), np.uint32)
    code[ranked] = np.arange(len(ranked))
    control, data = encode_codes(code[ids])
    head = np.array([len(doc_ids), len(ids), len(ranked), len(control), len(data)], "<u4")
    named = np.array([x or 0 for x in doc_ids], "<i8")
    has = np.array([x is not None for x in doc_ids], np.uint8)
    return b"".join([MAGIC, head.tobytes(), ranked.tobytes(), named.tobytes(), has.tobytes(), counts.astype("<u4").tobytes(), control, data])


def read_segments(stream) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Document ids, their numbers of ids, and all ids, segment by segment."""
    while head := stream.read(len(MAGIC)):
        if head != MAGIC:
            raise ValueError("not a segment of token ids")
        docs, total, distinct, controls, size = np.frombuffer(stream.read(20), "<u4").tolist()
        ranked = np.frombuffer(stream.read(4 * distinct), "<u4")
        named, has = np.frombuffer(stream.read(8 * docs), "<i8").tolist(), np.frombuffer(stream.read(docs), np.uint8).tolist()
        counts = np.frombuffer(stream.read(4 * docs), "<u4")
        codes = decode_codes(stream.read(controls), stream.read(size), total)
        yield [n if h else None for n, h in zip(named, has)], counts, ranked[codes] if total else codes


def write_files(docs: DataFrame, folder: str, path: str | None = None, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """``file, path, docs, ids`` of the files written below ``folder``, numbered in document order.

    Null text is empty; every document ends with ``end_id``. Repeated ids follow one another in order of their texts.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    lined = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = library_text_encoder(path), TaskContext.get().partitionId()
        target = f"{folder}/tokens-{number:06d}.bin"
        file = AtomicFile(target)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        waiting = written = total = 0

        def flush() -> None:
            nonlocal names, held, sizes, waiting, written, total
            if names:
                file.write(pack_segment(names, np.concatenate(sizes), np.concatenate(held)))
            written, total = written + len(names), total + waiting
            names, held, sizes, waiting = [], [], [], 0

        try:
            for whole in batches:
                for batch in by_bytes(whole, 1, 1 << 18):
                    ids, counts = encoder.batch(batch.column(1).to_pylist())
                    own = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                    names += batch.column(0).to_pylist()
                    held.append(own)
                    sizes.append(counts + 1)
                    waiting += len(own)
                    if waiting >= SEGMENT:
                        flush()
            flush()
        except BaseException:
            file.discard()
            raise
        file.close()
        yield pa.RecordBatch.from_pylist([{"file": number, "path": target, "docs": written, "ids": total}], schema=listed)

    listed = pa.schema([("file", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
    return materialize(lined.mapInArrow(run, "file int, path string, docs long, ids long"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in ``files``, read from the files themselves."""
    before = F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")
    # A stated number of tasks: a few rows of paths would be coalesced to one task that reads all files.
    placed = files.select("file", "path", before.alias("before")).repartition(max(1, files.count()), "file").select("path", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(path) as stream:
                    for names, counts, ids in read_segments(stream):
                        ends = np.cumsum(counts.astype(np.int64))
                        starts = ends - counts
                        raw = memoryview(ids.astype("<u4").tobytes())
                        sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                        columns = [pa.array(names, pa.int64()), pa.array(start + starts), pa.array(counts.astype(np.int64)), pa.array(sums, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(ends[-1])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    return read_files(write_files(docs, scratch_path(docs.sparkSession, "tokens"), path))

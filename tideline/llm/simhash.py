"""SimHash near-duplicates: fingerprints, generalised pigeonhole links, components.

Fingerprints of 64 bits link when they differ in at most ``bits`` bits. The bits are dealt into parts, correlated bits
together; part ``i`` is looked up with all values up to ``e_i`` bits away. If the ``e_i`` sum to ``bits - parts + 1``, two
fingerprints within ``bits`` agree within ``e_i`` in some part, so no link is missed. Dynamic programming picks the
``e_i`` (-1: the part is not looked up at all) from candidate counts estimated on a bounded sample; the sample only moves
cost, never results. Within a bucket, candidates are compared and only a minimum spanning forest of the links is kept, so
a large group of near copies yields as many links as it has members. Buckets over ``BUCKET`` rows are split into pairs of
blocks, which together still compare everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.components import components
from tideline.llm.files import AtomicFile, open_file
from tideline.session import materialize, scratch_path

SEED = 42
SAMPLE = 2048
BUCKET = 20_000
PROBE_COST, COMPARE_COST = 3.0, 0.01
#: Parts are planned for this many rows at least: small inputs are looked up as finely as middling ones.
PLAN_ROWS = 250_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
CHUNK = 1 << 20


def text_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; split at the ASCII blanks x20 and x09-x0D."""
    return text.translate(LOWER).split() if text else []


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words joined by a blank, repeats kept, as rows of 8 bytes, high byte first."""
    if not words:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(words)
    if len(words) <= width:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
        hashed = xxhash.xxh64_digest
        digests = b"".join([hashed(joined[s:e], SEED) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())])
    return np.frombuffer(digests, np.uint8).reshape(-1, 8)


def fingerprint(words: list[bytes], width: int) -> int:
    """A bit is set if it is set in over half of the hashes; no words give 0. Signed, as Spark's long."""
    hashes = shingle_hashes(words, width)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp``, one row per row of ``docs``; null text has no words."""
    chosen = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary())
            fps = [fingerprint(text_words(t.as_py()), width) for t in texts]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps, pa.int64())], names=[*(f"k{i}" for i in range(len(keep))), "fp"])

    schema = ", ".join([*(f"k{i} {chosen.schema[i].dataType.simpleString()}" for i in range(len(keep))), "fp long"])
    made = chosen.mapInArrow(run, schema)
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "fp")


@dataclass(frozen=True)
class Part:
    """Some of the 64 bits, and how many of them a look-up may miss."""

    bits: tuple[int, ...]
    miss: int

    def flips(self) -> tuple[np.ndarray, np.ndarray]:
        """Masks of 1 to ``miss`` bits, and the lowest bit of each."""
        sets = [s for n in range(1, self.miss + 1) for s in combinations(sorted(self.bits), n)]
        masks = np.array([sum(1 << b for b in s) for s in sets], np.uint64)
        return masks, np.array([1 << s[0] for s in sets], np.uint64)


def plan_parts(sample: np.ndarray, rows: int, bits: int) -> list[Part]:
    """The cheapest parts and misses for ``rows`` fingerprints, of which ``sample`` (unsigned) is an example."""
    ones = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    centred = ones - ones.mean(axis=0) if len(sample) else ones
    scale = np.sqrt((centred**2).sum(axis=0))
    scale[scale == 0] = 1
    tied = np.abs((centred / scale).T @ (centred / scale))
    best, chosen = float("inf"), []
    for count in range(1, min(bits + 1, 12) + 1):
        groups = _correlated(tied, count)
        costs = [_costs(g, sample, rows, bits) for g in groups]
        cost, misses = _allocate(costs, bits - count + 1)
        if cost < best:
            best, chosen = cost, [Part(tuple(g), e) for g, e in zip(groups, misses) if e >= 0]
    return chosen


def _correlated(tied: np.ndarray, count: int) -> list[list[int]]:
    """``count`` groups of nearly equal size; each grows by the bit most tied to it."""
    left, groups = set(range(64)), []
    for i in range(count):
        size = (64 - i + count - 1) // count
        group = [min(left)]
        left.remove(group[0])
        while len(group) < size:
            nearest = max(sorted(left), key=lambda b: tied[b, group].sum())
            group.append(nearest)
            left.remove(nearest)
        groups.append(group)
    return groups


def _costs(group: list[int], sample: np.ndarray, rows: int, bits: int) -> list[float]:
    """Cost of missing -1, 0, 1, ... bits in this part: rows looked up and candidates compared."""
    mask = np.uint64(sum(1 << b for b in group))
    own, n = sample & mask, len(sample)
    seen = np.zeros(65)
    for at in range(0, n, 256):
        apart = np.bitwise_count(own[at : at + 256, None] ^ own[None, :])
        seen += np.bincount(apart.ravel(), minlength=65)
    seen[0] -= n
    near = np.cumsum(seen) / max(1, n * (n - 1))
    costs = [0.0]
    for miss in range(0, bits + 1):
        probes = sum(comb(len(group), s) for s in range(miss + 1))
        even = probes / 2.0 ** len(group)
        costs.append(rows * (PROBE_COST * (probes + 1) / 2 + COMPARE_COST * rows * max(even, near[min(miss, 64)])))
    return costs


def _allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Misses of at least -1 that sum to ``total`` at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, misses) in best.items():
            for miss in range(-1, len(own) - 1):
                to, price = spent + miss, cost + own[miss + 1]
                if to not in step or price < step[to][0]:
                    step[to] = (price, [*misses, miss])
        best = step
    return best.get(total, (float("inf"), []))


def probes(fps: DataFrame, parts: list[Part]) -> DataFrame:
    """``key, fp, probe``: a row under each part's value, and one under each value nearby.

    Of two values that differ in a set of bits, only the one with a 0 in the lowest of them looks for the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for number, part in enumerate(parts):
                mask = np.uint64(sum(1 << b for b in part.bits))
                mixed = np.uint64(0x9E3779B97F4A7C15 * (2 * number + 1) & 0xFFFFFFFFFFFFFFFF)
                own = fp & mask
                yield _rows(own * mixed, fp, np.zeros(len(fp), bool))
                flips, lowest = part.flips()
                for flip, low in zip(flips, lowest):
                    from_zero = (fp & low) == 0
                    yield _rows((own[from_zero] ^ flip) * mixed, fp[from_zero], np.ones(from_zero.sum(), bool))

    return fps.select("fp").mapInArrow(run, "key long, fp long, probe boolean")


def _rows(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(probe)]
    return pa.RecordBatch.from_arrays(arrays, names=["key", "fp", "probe"])


def spanning(nodes: int, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which links make a minimum spanning forest; near ones come first."""
    parent, kept = np.arange(nodes), []
    for level in np.unique(apart):
        at = np.flatnonzero(apart == level)
        while len(at):
            x, y = parent[a[at]], parent[b[at]]
            apart_still = x != y
            at, x, y = at[apart_still], x[apart_still], y[apart_still]
            if not len(at):
                break
            high, first = np.unique(np.maximum(x, y), return_index=True)
            parent[high] = np.minimum(x, y)[first]
            kept.append(at[first])
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def closest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, near: int) -> np.ndarray:
    """Which links are among the ``near`` shortest of one of their ends; of equal ones the first by the other end."""
    ends, others = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.lexsort((others, np.concatenate((apart, apart)), ends))
    place = np.arange(len(order)) - np.searchsorted(ends[order], ends[order])
    return np.unique(order[place < near] % max(1, len(a)))


class _Forest:
    """Links met so far among the fingerprints of a chunk, reduced whenever they become many: to a spanning forest, and
    the ``near`` shortest links of each."""

    def __init__(self, nodes: int, near: int):
        self.nodes, self.near, self.parts, self.held = nodes, near, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> None:
        self.parts.append((a, b, apart))
        self.held += len(a)
        if self.held > 2 * CHUNK + 2 * (1 + self.near) * self.nodes:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, apart = (np.concatenate(x) if self.parts else np.zeros(0, np.int64) for x in (zip(*self.parts) if self.parts else ((), (), ())))
        _, once = np.unique(np.minimum(a, b) * self.nodes + np.maximum(a, b), return_index=True)
        a, b, apart = a[once], b[once], apart[once]
        kept = spanning(self.nodes, a, b, apart)
        if self.near and len(a):
            kept = np.union1d(kept, closest(a, b, apart, self.near))
        self.parts, self.held = [(a[kept], b[kept], apart[kept])], len(kept)
        return self.parts[0]


def bucket_links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, bits: int, near: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest of the links within buckets, and the ``near`` shortest of each; rows come sorted by key, buckets whole."""
    own, node = np.unique(fp, return_inverse=True)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    forest = _Forest(len(own), near)

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        apart = np.bitwise_count(fp[i] ^ fp[j])
        linked = (apart <= bits) & ~(probe[i] & probe[j]) & (fp[i] != fp[j])
        forest.add(node[i[linked]], node[j[linked]], apart[linked])

    size_of = np.repeat(sizes, sizes)
    place = np.arange(len(key)) - np.repeat(starts, sizes)
    small = size_of <= 1024
    rest, step = np.flatnonzero(small & (size_of > 1)), 1
    while len(rest):
        rest = rest[place[rest] + step < size_of[rest]]
        compare(rest, rest + step)
        step += 1
    for start, size in zip(starts[sizes > 1024], sizes[sizes > 1024]):
        rows = np.arange(start, start + size)
        block = max(1, CHUNK // size)
        for at in range(0, size, block):
            i, j = np.meshgrid(rows[at : at + block], rows, indexing="ij")
            after = j > i
            compare(i[after], j[after])
    a, b, apart = forest.reduce()
    return own[a], own[b], apart


def dealt(found: DataFrame, bucket: int, by: str) -> DataFrame:
    """``found`` with the keys of over ``bucket`` rows split into pairs of blocks by the digest of ``by``."""
    hot = found.groupBy("key").count().where(F.col("count") > bucket)
    hot = materialize(hot.select("key", F.ceil(F.col("count") / bucket).cast("long").alias("blocks")), "hot")
    if hot.isEmpty():
        return found
    own = F.pmod(F.xxhash64(by), F.col("blocks"))
    blocked = (
        found.join(hot, "key", "left")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    )
    split = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rest = [c for c in found.columns if c != "key"]
    return blocked.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(split).alias("key"), *rest)


def links(classes: DataFrame, bits: int = 4, bucket: int = BUCKET, near: int = 0) -> DataFrame:
    """``a, b, apart``: links between distinct fingerprints ``fp`` that connect all pairs within ``bits`` bits.

    For those who test links further, ``near`` more of the shortest links of each fingerprint are kept."""
    spark = classes.sparkSession
    rows = classes.count()
    share = min(0.5, SAMPLE / max(1, rows))
    drawn = classes.where((F.abs(F.xxhash64("fp", F.lit(7))) % 1_000_003) < int(share * 1_000_003)).select("fp").limit(2 * SAMPLE)
    sample = np.array([r.fp for r in drawn.collect()], np.int64).view(np.uint64)
    found = probes(classes, plan_parts(sample, max(rows, PLAN_ROWS), bits))
    found = dealt(found, bucket, "fp")
    lined = found.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush(last: bool):
            nonlocal held, count
            key, fp, probe = (np.concatenate(x) for x in zip(*held))
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))
            held, count = [(key[cut:], fp[cut:], probe[cut:])], len(key) - cut
            if cut:
                a, b, apart = bucket_links(key[:cut], fp[:cut].view(np.uint64), probe[:cut], bits, near)
                arrays = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(apart.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "apart"])

        limit = CHUNK
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            count += batch.num_rows
            if count > limit:
                yield from flush(False)
                limit = max(CHUNK, 2 * count)
        if count:
            yield from flush(True)

    return lined.mapInArrow(run, "a long, b long, apart int")


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fp, component_id`` of every row.

    Documents are linked if their fingerprints differ in at most ``bits`` bits; the component is named after the
    smallest id reachable. Texts without words have fingerprint 0 and link like any other; a repeated row links to
    itself; a null id takes part but names nothing, so a component of null ids only has a null name.
    """
    spark = docs.sparkSession
    rows = materialize(fingerprints(docs, width, text, (doc_id,)).withColumnRenamed(doc_id, "doc_id"), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    label = components(links(classes, bits))
    named = classes.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "label").select("fp", "component_id")
    return rows.join(by_class, "fp").select("doc_id", "fp", "component_id")


COMMON_DOCS, COMMON_SHARE, COMMON_SEEN, COMMON_MOST = 2000, 0.1, 3, 500_000
BLOCK_BYTES, FILE_BITS = 8 << 20, 33
#: Pairs that a bucket may name for each of its rows; rows of one with more are tested as a group.
SPARSE = 16


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    return np.unique(shingle_hashes(words, width).copy().view(">u8").ravel().astype(np.uint64))


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether whole sets share ``least`` of all they have; empty sets are alike."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= least * (len(x) + len(y) - common)


def prefix(own: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The hashes of which two sets similar to ``least`` share one: those before the last ``least`` of the set, and one
    more. All sets are in one order, ``common`` hashes last; which they are only moves cost. Empty sets share a 0."""
    if not len(own):
        return np.zeros(1, np.uint64)
    often = among(own, common)
    return np.concatenate((own[~often], own[often]))[: len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1]


def among(own: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which hashes are in a sorted list."""
    return listed[np.minimum(np.searchsorted(listed, own), len(listed) - 1)] == own if len(listed) else np.zeros(len(own), bool)


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """The shingles that most texts of a sample of ``docs(h1, text)`` have, in order.

    The sample is a share of all distinct texts, so the number of texts that may have a shingle which is not listed does
    not grow with the corpus, until the list is full. The list only moves cost.
    """
    texts = docs.where("text IS NOT NULL").select("h1", "text")
    share = max(COMMON_SHARE, min(1.0, COMMON_DOCS / max(1, texts.count())))
    drawn = texts.where(F.pmod(F.xxhash64("h1", F.lit(3)), F.lit(1_000_003)) < int(share * 1_000_003)).dropDuplicates(["h1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h1, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                own = shingle_set(text_words(text.as_py()), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), h1)), pa.array(own)], names=["h1", "key"])

    seen = drawn.mapInArrow(run, "h1 long, key long").groupBy("key").count().where(F.col("count") >= COMMON_SEEN)
    listed = seen.orderBy(F.col("count").desc(), "key").limit(COMMON_MOST).select("key").toArrow().column("key")
    return np.sort(listed.to_numpy().astype(np.int64).view(np.uint64))


def cells(own: np.ndarray) -> bytes:
    """How many hashes of a set end in each of 64 ways; 65,535 stands for so many or more."""
    return np.minimum(np.bincount((own & np.uint64(63)).astype(np.int64), minlength=64), 65_535).astype("<u2").tobytes()


def most_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most hashes that sets with these cells can share, row by row."""
    full = (x == 65_535) | (y == 65_535)
    return np.where(full, np.inf, np.minimum(x, y)).sum(axis=1)


def text_file(folder: str, number: int) -> str:
    return f"{folder}/texts-{number:08d}.bin"


def read_rows(docs: DataFrame, folder: str, common, width: int, least: float) -> DataFrame:
    """``no, doc_id, h1, h2, fp, n, prefix, cells, offset, length`` of every row of ``docs(doc_id, h1, h2, text)``.

    ``no`` numbers the rows; its high bits name the file below ``folder`` that holds the row's text, compressed by itself
    at ``offset``. Both are written once, and nothing else carries prefixes or texts from here on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at = TaskContext.get().partitionId(), 0
        packer, file = zstandard.ZstdCompressor(level=3), AtomicFile(text_file(folder, number))
        try:
            for batch in batches:
                fps, sizes, prefixes, counts, offsets, lengths = [], [], [], [], [], []
                for text in batch.column(3).cast(pa.binary()):
                    raw = text.as_py() or b""
                    words = text_words(raw)
                    own = shingle_set(words, width)
                    fps.append(fingerprint(words, 2))
                    sizes.append(len(own))
                    prefixes.append(prefix(own, common.value, least).tobytes())
                    counts.append(cells(own))
                    packed = packer.compress(raw)
                    offsets.append(file.offset)
                    lengths.append(len(packed))
                    file.write(packed)
                made = [pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.binary()), pa.array(counts, pa.binary())]
                places = [pa.array(offsets, pa.int64()), pa.array(lengths, pa.int32())]
                numbers = pa.array(np.arange(at, at + batch.num_rows) + (number << FILE_BITS))
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([numbers, *batch.columns[:3], *made, *places], names=names)
        except BaseException:
            file.discard()
            raise
        file.close()

    names = ["no", "doc_id", "h1", "h2", "fp", "n", "prefix", "cells", "offset", "length"]
    schema = "no long, doc_id long, h1 long, h2 long, fp long, n int, prefix binary, cells binary, offset long, length int"
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "h1", "h2", "text")
    return materialize(chosen.mapInArrow(run, schema), "fingerprints")


class _Sets:
    """Shingle sets of numbered rows, read from their files in order of place, those of one group of pairs at a time."""

    def __init__(self, folder: str, width: int):
        self.folder, self.width, self.held = folder, width, {}
        self.unpacker = zstandard.ZstdDecompressor()

    def load(self, places: dict[int, tuple[int, int]]) -> None:
        self.held = {no: own for no, own in self.held.items() if no in places}
        stream, number = None, None
        for no in sorted(set(places) - set(self.held)):
            if no >> FILE_BITS != number:
                if stream:
                    stream.close()
                number = no >> FILE_BITS
                stream = open_file(text_file(self.folder, number))
            offset, length = places[no]
            stream.seek(offset)
            raw = self.unpacker.decompress(stream.read(length))
            self.held[no] = shingle_set(text_words(raw), self.width)
        if stream:
            stream.close()


def linking(a: list[int], b: list[int], sets: dict[int, np.ndarray], least: float) -> list[int]:
    """Which pairs are similar, without those whose ends similar pairs before them connect already."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    found = []
    for i, (x, y) in enumerate(zip(a, b)):
        p, q = top(x), top(y)
        if p != q and similar(sets[x], sets[y], least):
            parent[p] = q
            found.append(i)
    return found


def held_pairs(pairs: DataFrame, rows: DataFrame, folder: str, width: int, least: float, block: int = BLOCK_BYTES) -> DataFrame:
    """``a, b``: pairs of row numbers with whole shingle sets similar to ``least`` that connect all such ``pairs``.

    Two sets share at most the smaller count of each of their ``cells``; pairs that even so stay below are left out first.
    The others are dealt out by the groups they make, so that a task reads each text of a group once and tests all its
    pairs. A group of over ``block`` bytes of sets is cut into pairs of blocks of its texts, which together still test everything.
    """
    spark = pairs.sparkSession
    counted = pairs.distinct()
    for x in ("a", "b"):
        own = [F.col(c).alias(f"{x}_{c}") for c in ("cells", "n", "offset", "length")]
        counted = counted.join(rows.select(F.col("no").alias(x), *own), x)

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.array([np.frombuffer(v.as_buffer(), "<u2") for v in batch.column(i)], np.int64).reshape(-1, 64) for i in (2, 3))
            both = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64) + batch.column(5).to_numpy(zero_copy_only=False)
            common = most_common(x, y)
            yield batch.select([0, 1, 4, 5, 6, 7, 8, 9]).filter(pa.array((common == np.inf) | (common * (1 + least) >= least * both - 1e-6)))

    counted = counted.select("a", "b", "a_cells", "b_cells", "a_n", "b_n", "a_offset", "a_length", "b_offset", "b_length")
    held = materialize(counted.mapInArrow(may, "a long, b long, a_n int, b_n int, a_offset long, a_length int, b_offset long, b_length int"), "pairs")
    label = materialize(components(held.select("a", "b")), "groups")
    sizes = rows.select(F.col("no").alias("node"), "n").join(label, "node").groupBy("label").agg(F.sum(F.col("n").cast("long")).alias("n"))
    blocks = sizes.select("label", F.greatest(F.lit(1), F.ceil(8 * F.col("n") / block)).cast("long").alias("blocks"))
    dealt_out = held.join(label.withColumnRenamed("node", "a"), "a").join(blocks, "label")
    one, two = (F.pmod(F.xxhash64(x, F.lit(13)), F.col("blocks")) for x in ("a", "b"))
    dealt_out = dealt_out.withColumn("part", F.xxhash64("label", F.least(one, two), F.greatest(one, two)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lined = dealt_out.repartition(tasks, "part").sortWithinPartitions("part", "a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(folder, width)

        def tested(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            group = pa.Table.from_batches(held)
            a, b, at, size, other_at, other_size = (group.column(i).to_pylist() for i in range(1, 7))
            sets.load(dict(zip(a, zip(at, size))) | dict(zip(b, zip(other_at, other_size))))
            kept = linking(a, b, sets.held, least)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for i in kept], pa.int64()) for x in (a, b)], names=["a", "b"])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:]):
                if waiting and start < end and waiting[0].column(0)[0].as_py() != int(part[start]):
                    yield tested(waiting)
                    waiting = []
                if start < end:
                    waiting.append(batch.slice(start, end - start))
        if waiting:
            yield tested(waiting)

    return lined.select("part", "a", "b", "a_offset", "a_length", "b_offset", "b_length").mapInArrow(verify, "a long, b long")


def open_pairs(label: np.ndarray, n: np.ndarray, place: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one bucket that may be similar to ``least`` and are not connected yet.

    A similar pair has sizes within ``least`` of each other and, in the bucket of the first hash that both have, enough
    hashes left on both sides.
    """
    labels, group, sizes = np.unique(label, return_inverse=True, return_counts=True)
    if len(labels) < 2:
        return
    # Rows of the largest label only meet the others.
    largest = group == sizes.argmax()
    rows = np.concatenate((np.flatnonzero(~largest), np.flatnonzero(largest)))
    group, n, left, first = group[rows], n[rows], (n - place)[rows], int((~largest).sum())
    block = max(1, CHUNK // len(rows))
    for at in range(0, first, block):
        i = np.arange(at, min(first, at + block))
        fits = (np.arange(len(rows))[None, :] > i[:, None]) & (group[i, None] != group[None, :])
        fits &= np.minimum(n[i, None], n[None, :]) >= least * np.maximum(n[i, None], n[None, :]) - 1e-6
        fits &= np.minimum(left[i, None], left[None, :]) >= least / (1 + least) * (n[i, None] + n[None, :]) - 1e-6
        x, y = np.nonzero(fits)
        yield rows[i[x]], rows[y]


def shared_keys(rows: DataFrame, common) -> DataFrame:
    """``key, no, place`` of prefix hashes that more than one row has, and where in its prefix a row has them.

    Common hashes surely are shared, and stay where they are; the others meet once, with nothing but their row's number.
    """

    def keys(often: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    own = [np.frombuffer(v.as_buffer(), np.int64) for v in some.column(1)]
                    times = np.array([len(x) for x in own])
                    numbers = np.repeat(some.column(0).to_numpy(zero_copy_only=False), times)
                    place = np.concatenate([np.arange(x) for x in times]).astype(np.int32)
                    key = np.concatenate(own)
                    chosen = among(key.view(np.uint64), common.value) == often
                    arrays = [pa.array(key[chosen]), pa.array(numbers[chosen]), pa.array(place[chosen])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "no", "place"])

        return rows.select("no", "prefix").mapInArrow(run, "key long, no long, place int")

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.RecordBatch | None = None
        for batch in batches:
            table = pa.Table.from_batches([before, batch] if before is not None else [batch]).combine_chunks()
            key = table.column(0).to_numpy()
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield from _shared(table.slice(0, cut))
            left = table.slice(cut)
            before = left.combine_chunks().to_batches()[0] if left.num_rows else None
        if before is not None:
            yield from _shared(pa.Table.from_batches([before]))

    lined = keys(False).repartition("key").sortWithinPartitions("key")
    return lined.mapInArrow(several, "key long, no long, place int").unionByName(keys(True))


def _shared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted table whose key another row has."""
    key = table.column(0).to_numpy()
    if len(key) > 1:
        same = key[1:] == key[:-1]
        kept = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        yield from table.filter(pa.array(kept)).combine_chunks().to_batches()


def bucket_pairs(label: np.ndarray, n: np.ndarray, place: np.ndarray, least: float, sparse: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The ``open_pairs`` of one bucket, and False; if they are over ``sparse`` a row, links that connect them all, and True."""
    held, count, forest = [], 0, None
    for i, j in open_pairs(label, n, place, least):
        held.append((i, j))
        count += len(i)
        if count > sparse * len(label):
            forest = forest or _Forest(len(label), 0)
            for x, y in held:
                forest.add(x, y, np.zeros(len(x), np.int64))
            held = []
    if forest:
        i, j, _ = forest.reduce()
        return i, j, True
    i, j = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
    return i, j, False


def missing_pairs(texts: DataFrame, keys: DataFrame, least: float, bucket: int = BUCKET, sparse: int = SPARSE) -> DataFrame:
    """``a, b, dense``: pairs of ``texts(no, label, n)`` with different labels; among them, or among the rows that dense
    ones connect, are all similar to ``least``.

    ``keys`` are the ``shared_keys`` of these texts and of any others, which are left out here. No bucket makes more than
    ``sparse`` pairs a row, however many of its rows may be similar: beyond that its links only tell which rows go together.
    """
    made = keys.join(texts.select("no", "label", "n"), "no").select("key", "no", "label", "n", "place")
    lined = dealt(materialize(made, "keys"), bucket, "no").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told(found: list[tuple[np.ndarray, np.ndarray, bool]]) -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in list(zip(*found))[:2])
            dense = np.repeat([x[2] for x in found], [len(x[0]) for x in found])
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(dense)], names=["a", "b", "dense"])

        def flush(last: bool):
            nonlocal held
            columns = [np.concatenate(x) for x in zip(*held)]
            key = columns[0]
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))
            held = [tuple(c[cut:] for c in columns)]
            if not cut:
                return
            edges = np.flatnonzero(np.concatenate(([True], key[1:cut] != key[: cut - 1], [True])))
            low, high = (f.reduceat(columns[2][:cut], edges[:-1]) for f in (np.minimum, np.maximum))
            several = np.flatnonzero(low != high)
            found, count = [], 0
            for start, end in zip(edges[several], edges[several + 1]):
                _, ids, label, n, place = (c[start:end] for c in columns)
                i, j, dense = bucket_pairs(label, n, place, least, sparse)
                if len(i):
                    found.append((ids[i], ids[j], dense))
                    count += len(i)
                if count > CHUNK // 4:
                    yield told(found)
                    found, count = [], 0
            if found:
                yield told(found)

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            if sum(len(x[0]) for x in held) > CHUNK:
                yield from flush(False)
        if held:
            yield from flush(True)

    return lined.mapInArrow(run, "a long, b long, dense boolean")


def group_links(sets: list[np.ndarray], label: np.ndarray, later: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links of similar sets that connect all such of different labels; if some are ``later``, between those and the others only.

    Each set in turn meets those that nothing connects to it yet, by counting in lists of the sets that have a hash.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    row, ends = np.repeat(np.arange(len(sets)), n), np.cumsum(n)
    _, hashed = np.unique(np.concatenate(sets), return_inverse=True)
    having = row[np.argsort(hashed, kind="stable")]
    times = np.bincount(hashed)
    starts = np.cumsum(times) - times
    group, found = np.unique(label, return_inverse=True)[1], []
    for i in np.flatnonzero(~later):
        others = group != group[i]
        others &= later if later.any() else np.arange(len(sets)) > i
        others &= np.minimum(n, n[i]) >= least * np.maximum(n, n[i]) - 1e-6
        if not others.any():
            continue
        own = hashed[ends[i] - n[i] : ends[i]]
        shift = np.repeat(starts[own] - (np.cumsum(times[own]) - times[own]), times[own])
        common = np.bincount(having[shift + np.arange(len(shift))], minlength=len(sets))
        alike = np.flatnonzero(others & (common >= least * (n[i] + n - common)))
        for other, first in zip(*np.unique(group[alike], return_index=True)):
            found.append((int(i), int(alike[first])))
            group[group == other] = group[i]
    return found


def dense_links(near: DataFrame, texts: DataFrame, rows: DataFrame, folder: str, width: int, least: float, block: int = BLOCK_BYTES) -> DataFrame:
    """``a, b``: links with whole shingle sets similar to ``least`` that connect all such pairs of ``texts(no, label)`` within
    what ``near(a, b)`` connects and with different labels.

    No pair is ever a row: a task reads the texts of a group and tests them against each other. A group of over ``block``
    bytes of sets is cut into blocks of its texts, and each pair of blocks is tested.
    """
    spark = near.sparkSession
    group = materialize(components(near), "dense").select(F.col("node").alias("no"), F.col("label").alias("group"))
    held = texts.select("no", "label").join(group, "no").join(rows.select("no", "n", "offset", "length"), "no")
    sizes = held.groupBy("group").agg(F.sum(F.col("n").cast("long")).alias("size"))
    blocks = sizes.select("group", F.greatest(F.lit(1), F.ceil(8 * F.col("size") / block)).cast("long").alias("blocks"))
    own = held.join(blocks, "group").withColumn("own", F.pmod(F.xxhash64("no", F.lit(13)), F.col("blocks")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("group", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("later"), "no", "label", "offset", "length")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lined = met.repartition(tasks, "group", "x", "y").sortWithinPartitions("group", "x", "y", "no")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(folder, width)

        def tested(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            _, _, _, later, no, label, offset, length = (np.concatenate(x) for x in zip(*held))
            sets.load(dict(zip(no.tolist(), zip(offset.tolist(), length.tolist()))))
            kept = group_links([sets.held[x] for x in no.tolist()], label, later, least)
            return pa.RecordBatch.from_arrays([pa.array(no[[k[e] for k in kept]].astype(np.int64)) for e in (0, 1)], names=["a", "b"])

        waiting: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            part = np.stack(columns[:3])
            edges = [0, *(np.flatnonzero((part[:, 1:] != part[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:]):
                if waiting and start < end and any(waiting[0][k][0] != part[k, start] for k in range(3)):
                    yield tested(waiting)
                    waiting = []
                if start < end:
                    waiting.append(tuple(c[start:end] for c in columns))
        if waiting:
            yield tested(waiting)

    return lined.mapInArrow(verify, "a long, b long")


def drop_near_duplicates(docs: DataFrame, bits: int = 9, width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of near duplicates of ``docs(doc_id, text, ...)``: that with the smallest id.

    Texts are linked if their whole sets of ``width``-word shingles are similar to ``least``, and groups are all that
    links connect. Fingerprints of word pairs within ``bits`` bits come first: a spanning forest of them is tested, which
    joins most of every large group. What may still be missing between two groups so found comes from shingles: two similar texts share one of the first fifth of their hashes,
    so every such pair is met and tested, whatever its fingerprints are: as a pair, or where a hash has many such pairs, within
    the group of texts that these connect. Equal texts (told by 128 bits) are one text;
    texts without words are alike. Null ids come last; of rows equal in id and text one stays.
    """
    spark = docs.sparkSession
    hashes = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    named = docs.select("doc_id", *hashes, "text")
    common = spark.sparkContext.broadcast(common_shingles(named, width))
    folder = scratch_path(spark, "texts")
    rows = read_rows(named, folder, common, width, least)
    # One row stands for each text.
    texts = rows.groupBy("h1", "h2").agg(F.min(F.struct("no", "fp", "n")).alias("t"))
    texts = materialize(texts.select("h1", "h2", "t.*"), "texts")
    # A fingerprint that several texts have is stood for by two of them here.
    text = F.struct("no", "n")
    classes = materialize(texts.groupBy("fp").agg(F.array_distinct(F.array(F.min(text), F.max(text))).alias("shown")), "classes")
    within = texts.select(text.alias("left"), "fp").join(classes, "fp").select("left", F.explode("shown").alias("right"))
    near = links(classes.select("fp"), bits).select("a", "b").distinct()
    ends = [classes.select(F.col("fp").alias(x), F.col("shown").alias(f"{x}_shown")) for x in ("a", "b")]
    between = near.join(ends[0], "a").join(ends[1], "b").select(F.explode("a_shown").alias("left"), "b_shown")
    pairs = within.unionByName(between.select("left", F.explode("b_shown").alias("right")))
    pairs = pairs.where(F.least("left.n", "right.n") >= least * F.greatest("left.n", "right.n") - 1e-6)
    pairs = pairs.select(F.least("left.no", "right.no").alias("a"), F.greatest("left.no", "right.no").alias("b"))
    label = components(held_pairs(pairs.where("a <> b"), rows, folder, width, least)).withColumnRenamed("node", "no")
    texts = materialize(texts.select("h1", "h2", "no", "n").join(label, "no", "left").withColumn("label", F.coalesce("label", "no")), "labelled")
    missing = materialize(missing_pairs(texts, shared_keys(rows, common), least), "missing")
    rest = held_pairs(missing.where("NOT dense").select("a", "b"), rows, folder, width, least)
    rest = rest.unionByName(dense_links(missing.where("dense").select("a", "b"), texts, rows, folder, width, least))
    for x in ("a", "b"):
        rest = rest.join(texts.select(F.col("no").alias(x), F.col("label").alias(f"{x}_label")), x)
    whole = components(rest.select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("to"))
    label = texts.join(whole, "label", "left").select("h1", "h2", F.coalesce("to", "label").alias("label"))
    members = rows.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("copies")).join(label, ["h1", "h2"])
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h1", "h2", "copies")
    winners = members.groupBy("label").agg(F.min(order).alias("w")).select("w.doc_id", "w.h1", "w.h2", "w.copies")
    winners = materialize(winners.select(F.col("doc_id").alias("d"), F.col("h1").alias("t1"), F.col("h2").alias("t2"), "copies"), "winners")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(row, F.col("doc_id"), *hashes)
    won = packed.join(winners, (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")) & F.col("doc_id").eqNullSafe(F.col("d")))
    single = won.where("copies = 1").select("row")
    first = Window.partitionBy("t1", "t2", "d").orderBy(F.lit(1))
    several = won.where("copies > 1").withColumn("n", F.row_number().over(first)).where("n = 1").select("row")
    return single.unionByName(several).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

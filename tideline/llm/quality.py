"""Document quality: base counts, and hashed n-gram log-likelihood ratios between a trusted target and the raw corpus.

Words and pairs of words fall into ``BUCKETS`` buckets by a fixed hash. The raw multinomial counts every document; the
target multinomial counts a bounded sample of trusted documents. A document's score is the mean over its n-grams of the
log ratio of the two, so length does not matter. The threshold is fitted once on the bounded sample, between trusted and
distrusted documents, and then every document of any size is held against it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import by_bytes
from tideline.session import materialize

BUCKETS = 1 << 16
SAMPLE_DOCS = 4000
SMOOTHING = 0.5
LOST = 0.001
WINDOW_WORDS = 8
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
#: What the base rule calls symbols; fixed values.
SYMBOLS = b"#*$%&|<>"
_DROP_OTHERS = bytes(b for b in range(256) if b not in SYMBOLS)
_CONTINUED = bytes(range(128, 192))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def base_counts(text: bytes | None) -> dict:
    """Counts of one text in UTF-8; null has no words."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else []
    return {
        "n_words": len(words),
        "word_chars": len((joined := b"".join(words))) - (len(joined) - len(joined.translate(None, _CONTINUED))),
        "n_symbols": len(text.translate(None, _DROP_OTHERS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
    }


def repeated_words(words: list[bytes], size: int = WINDOW_WORDS) -> int:
    """Words inside windows of ``size`` words that occur at least twice."""
    count = len(words) - size + 1
    if count < 2:
        return 0
    numbers: dict[bytes, int] = {}
    own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    if len(numbers) == len(words):
        return 0
    mixed = np.zeros(count, np.uint64)
    for i in range(size):
        mixed = (mixed ^ own[i : i + count]) * _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(count, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def grams(text: bytes | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words and word pairs of a text, in lower case where A-Z."""
    words = (text or b"").lower().split()
    own = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = own[:-1] * np.uint64(0x9E3779B1) + own[1:]
    return (np.concatenate((own * _MULTIPLIER, pairs * _MULTIPLIER)) >> np.uint64(40)).astype(np.int64) % buckets


def count_grams(docs: DataFrame, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """How often each bucket occurs in all of ``docs``: summed within tasks, then by bucket; the result is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                sums += np.bincount(grams(value.as_py(), buckets), minlength=buckets)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], names=["bucket", "n"])

    counted = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total


@dataclass(frozen=True)
class Quality:
    """Log ratio of every bucket, and the least score of a kept document."""

    ratios: np.ndarray
    threshold: float

    def score(self, text: bytes | None) -> float:
        """Mean log ratio; no words score 0."""
        own = grams(text, len(self.ratios))
        return float(self.ratios[own].mean()) if len(own) else 0.0


def bounded(rows: DataFrame, most: int, by: str) -> DataFrame:
    """At most ``most`` rows, those with the smallest digests of ``by``, whatever the partitioning."""
    return rows.orderBy(F.xxhash64(by), by).limit(most)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, buckets: int = BUCKETS) -> Quality:
    """The model: raw counts from all ``docs``, the rest from at most ``sample_docs`` labelled rows of each kind.

    Trusted is ``quality = 1`` and not toxic, distrusted ``quality = 0`` or toxic. Half of the trusted make the target
    counts; the other half, which the ratios have not seen, and the distrusted set the threshold. Without trusted rows
    the ratios are 0, and without rows of either kind the threshold is minus infinity: only the base rules reject then.
    """
    raw = count_grams(docs, buckets)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))).otherwise(2)
    known = known.where("quality IS NOT NULL").select("doc_id", kind.cast("int").alias("kind"))
    drawn = bounded(known.where("kind < 2"), sample_docs, "doc_id").unionByName(bounded(known.where("kind = 2"), sample_docs, "doc_id"))
    chosen = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")
    texts = materialize(chosen.select("kind", "text"), "labelled")
    trusted = count_grams(texts.where("kind = 0"), buckets)

    def chances(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * buckets))

    scored = Quality(chances(trusted) - chances(raw) if trusted.any() else np.zeros(buckets), -np.inf)
    shown = score(texts.where("kind > 0"), scored, ("kind",)).where("NOT base_failed").select("kind", "score").collect()
    bad, good = (np.array([r.score for r in shown if r.kind == k]) for k in (2, 1))
    return Quality(scored.ratios, _cut(bad, good))


def _cut(bad: np.ndarray, good: np.ndarray, lost: float = LOST) -> float:
    """The cut that rejects most of the bad and at most ``lost`` of the good."""
    if not len(bad) or not len(good):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    ceiling = good[int(lost * len(good))]
    caught = bad[bad < ceiling]
    return float((caught[-1] + ceiling) / 2) if len(caught) else -np.inf


def fails_base(counts: dict) -> bool:
    words = counts["n_words"]
    return words < MIN_WORDS or 100 * counts["n_repeat_words"] > MAX_REPEATED_PERCENT * words


def kept_rows(docs: DataFrame, model: Quality, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and reach the threshold."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in (part for whole in batches for part in by_bytes(whole, place)):
            texts = (v.as_py() for v in batch.column(place).cast(pa.binary()))
            yield batch.filter(pa.array([not fails_base(base_counts(t)) and held.score(t) >= held.threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Quality, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, base counts, ``base_failed, score, kept`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            texts = [v.as_py() for v in batch.column(len(keep)).cast(pa.binary())]
            counts = list(map(base_counts, texts))
            failed = list(map(fails_base, counts))
            scores = [held.score(t) for t in texts]
            kept = [not f and s >= held.threshold for f, s in zip(failed, scores)]
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array([c[n] for c in counts], pa.int64()) for n in names]
            columns += [pa.array(failed), pa.array(scores), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"k{i}" for i in range(len(keep))), *names, "base_failed", "score", "kept"])

    schema = ", ".join(
        [*(f"k{i} {chosen.schema[i].dataType.simpleString()}" for i in range(len(keep))), *(f"{n} long" for n in names)]
        + ["base_failed boolean, score double, kept boolean"]
    )
    made = chosen.mapInArrow(run, schema)
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names, "base_failed", "score", "kept")

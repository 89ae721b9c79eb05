"""Language identification by unigram pieces, summed over all segmentations.

Pieces come from a fixed public vocabulary. Every language has a chance for each piece; the chance of a word is the sum
over all ways to cut it into pieces, which a forward pass adds up, and a text's is the product over its words. The chances
are trained by expectation maximisation on a bounded sample per language. Words repeat, so each is scored once per worker
and looked up from then on; the table is emptied when it has ``UNITS`` words.

A word is a run of letters, in lower case, after a word mark; words over ``LONGEST`` characters are scored in runs of that
length. A character that is no piece has the same small chance in every language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.bpe import by_bytes
from tideline.llm.tokens import UNITS, Units

VOCABULARY = "piece_bpe_32k.model"
SAMPLE_DOCS, SAMPLE_WORDS, ROUNDS = 400, 40_000, 4
PIECE, LONGEST = 6, 32
UNKNOWN, SMOOTHING = 1e-7, 0.01
UNDETERMINED = "und"
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x100000001B3)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[np.ndarray, ...]:
    """For each length, the sorted hashes of its pieces and their numbers."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    shown = (processor.id_to_piece(i).lower() for i in range(processor.get_piece_size()) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i)))
    pieces = sorted({p for p in shown if 0 < len(p) <= PIECE and (p == MARK or p.removeprefix(MARK).isalpha())})
    tables = []
    for size in range(1, PIECE + 1):
        own = [(i, p) for i, p in enumerate(pieces) if len(p) == size]
        hashes = np.zeros(len(own), np.uint64)
        for at in range(size):
            hashes = hashes * _BASE + np.array([ord(p[at]) for _, p in own], np.uint64)
        order = np.argsort(hashes)
        tables.append((hashes[order], np.array([i for i, _ in own], np.int64)[order]))
    return len(pieces), tables


def letter_words(text: str | None) -> list[str]:
    """Words of a text; none if it has no letter."""
    words = LETTERS.findall(text.lower()) if text else []
    if all(map(str.isnumeric, words)) and not any(c.isalpha() for w in words for c in w):
        return []
    return words


def _runs(word: str) -> list[str]:
    marked = MARK + word
    return [marked] if len(marked) <= LONGEST else [marked[i : i + LONGEST] for i in range(0, len(marked), LONGEST)]


def _numbers(words: list[str], path: str) -> list[np.ndarray]:
    """Piece numbers by length and start, for words of one length; the number of pieces stands for none."""
    none, tables = vocabulary(path)
    size = len(words[0])
    codes = np.array([[ord(c) for c in w] for w in words], np.uint64)
    hashes, found = np.zeros_like(codes), []
    for length in range(1, min(PIECE, size) + 1):
        hashes = hashes[:, : size - length + 1] * _BASE + codes[:, length - 1 :]
        known, numbers = tables[length - 1]
        at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
        found.append(np.where(known[at] == hashes, numbers[at], none) if len(known) else np.full(hashes.shape, none))
    return found


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for i in range(0, len(at), 8192):
            yield at[i : i + 8192], [words[j] for j in at[i : i + 8192]]


def forward(found: list[np.ndarray], chances: np.ndarray) -> list[np.ndarray]:
    """Sums of the chances of all segmentations of every prefix; ``chances`` is by piece and language, none last."""
    rows, size = found[0].shape
    single = chances[found[0]]
    single = np.where((found[0] == len(chances) - 1)[..., None], UNKNOWN, single)
    ahead = [np.ones((rows, chances.shape[1]))]
    for end in range(1, size + 1):
        total = ahead[end - 1] * single[:, end - 1]
        for length in range(2, min(PIECE, end) + 1):
            total = total + ahead[end - length] * chances[found[length - 1][:, end - length]]
        ahead.append(total)
    return ahead


def expected(found: list[np.ndarray], chances: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in words seen ``counts`` times, for one language."""
    rows, size = found[0].shape
    ahead = [x[:, 0] for x in forward(found, chances[:, None])]
    single = np.where(found[0] == len(chances) - 1, UNKNOWN, chances[found[0]])
    behind = [np.ones(rows)] * (size + 1)
    for start in range(size - 1, -1, -1):
        total = single[:, start] * behind[start + 1]
        for length in range(2, min(PIECE, size - start) + 1):
            total = total + chances[found[length - 1][:, start]] * behind[start + length]
        behind[start] = total
    weight = counts / ahead[size]
    uses = np.zeros(len(chances))
    for length in range(1, min(PIECE, size) + 1):
        for start in range(size - length + 1):
            own = found[length - 1][:, start]
            uses += np.bincount(own, weight * ahead[start] * chances[own] * behind[start + length], len(chances))
    return uses


@dataclass(frozen=True)
class LanguageModel:
    """Languages, and the chances of the pieces by piece and language; the last row stands for no piece."""

    languages: tuple[str, ...]
    chances: np.ndarray
    path: str

    def scores(self, words: list[str]) -> np.ndarray:
        """Log chance of each word in each language."""
        runs = [r for w in words for r in _runs(w)]
        own = np.zeros((len(runs), len(self.languages)))
        for at, some in _by_length(runs):
            own[at] = np.log(forward(_numbers(some, self.path), self.chances)[-1])
        if len(runs) == len(words):
            return own
        starts = np.concatenate(([0], np.cumsum([len(_runs(w)) for w in words])[:-1]))
        return np.add.reduceat(own, starts, axis=0)


def train(words: dict[str, dict[str, int]], path: str, rounds: int = ROUNDS) -> LanguageModel:
    """Chances from how often each language's sample has each word."""
    none, _ = vocabulary(path)
    languages = tuple(sorted(words))
    chances = np.zeros((none + 1, len(languages)))
    for column, language in enumerate(languages):
        runs: dict[str, int] = {}
        for word, count in words[language].items():
            for run in _runs(word):
                runs[run] = runs.get(run, 0) + count
        listed, counts = list(runs), np.array(list(runs.values()), float)
        groups = [(_numbers(some, path), counts[at]) for at, some in _by_length(listed)]
        own = np.append(np.full(none, 1 / none), 0)
        for _ in range(rounds):
            uses = sum(expected(found, own, seen) for found, seen in groups)[:none] + SMOOTHING
            own = np.append(uses / uses.sum(), 0)
        chances[:, column] = own
    return LanguageModel(languages, chances, path)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 1 by 3; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, path: str | None = None, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> LanguageModel:
    """Learns from text and non-null lang of documents that are not held out and have an id.

    At most ``sample_docs`` documents of each language, those with the smallest digests of their ids, and the
    ``sample_words`` most frequent words of these.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel((), np.zeros((1, 0)), path)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 3 * sample_docs / n)))])
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = usable.where(spot < share[F.col("lang")]).select("lang", "text", F.row_number().over(order).alias("n"))
    drawn = drawn.where(F.col("n") <= sample_docs).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = letter_words(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string())], names=["lang", "word"])

    counted = drawn.mapInArrow(cut, "lang string, word string").groupBy("lang", "word").count()
    ranked = Window.partitionBy("lang").orderBy(F.col("count").desc(), "word")
    kept = counted.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= sample_words)
    words: dict[str, dict[str, int]] = {}
    for row in kept.collect():
        words.setdefault(row.lang, {})[row.word] = row["count"]
    return train(words, path)


class Judge:
    """Scores texts, each distinct word once while it is remembered."""

    def __init__(self, model: LanguageModel, limit: int = UNITS):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.words, self.known = Units(), np.zeros((0, len(self.model.languages)))

    def batch(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.model.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if len(self.words) > self.limit:
            self.clear()
        numbers = []
        for text in texts:
            words = letter_words(text)
            numbers.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        if self.words.pending:
            self.known = np.concatenate((self.known, self.model.scores(self.words.pending)))
            self.words.pending = []
        languages, scores = [], []
        for own in numbers:
            if not len(own):
                languages.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = self.known[own].sum(axis=0)
            best = int(total.argmax())
            languages.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return languages, scores


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every whole text.

    The score is the chance of the predicted language among all. Null texts and texts without letters are ``und`` with
    score 0; of equal languages the first by name is predicted. Only the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for whole in batches:
            for batch in by_bytes(whole, len(keep)):
                languages, scores = judge.batch(batch.column(len(keep)).to_pylist())
                columns = [*(batch.column(i) for i in range(len(keep))), pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f"k{i}" for i in range(len(keep))), "lang_pred", "score"])

    schema = ", ".join([*(f"k{i} {chosen.schema[i].dataType.simpleString()}" for i in range(len(keep))), "lang_pred string, score double"])
    made = chosen.mapInArrow(run, schema)
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def accepted(docs: DataFrame, model: LanguageModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language at a chance of ``least`` or more."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for whole in batches:
            for batch in by_bytes(whole, place):
                languages, scores = judge.batch(batch.column(place).to_pylist())
                yield batch.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(languages, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Spelling variants: words one edit apart, found by an index of grams of variable length.

A dictionary of grams is built from the words' own counts: all grams of ``LOW`` characters, and a longer one only if the
gram it prolongs is frequent and it is not too rare itself, so that its size is bounded however many words there are. A word
is decomposed by taking, at each start, the longest gram of the dictionary, and leaving out grams that lie inside an
earlier one. For every place of an edit, ``affected`` tells which grams may change: those that a longest match before them
may have looked past the place, and those after it that a gram from before could cover. The most at any place bounds how
many grams of a word one edit can touch; so of any one more than that, one is untouched and both words have it.

Hence only the rarest of a word's grams, one more than its bound, are merged with the lists of other words. An untouched
gram lies wholly before or wholly after the edit, so the whole beginning or the whole end of the word up to it is equal too:
lists are split by that, which leaves no long list behind. In each, words one edit apart are told exactly.

Words of length ``l`` and ``l + 1`` meet in band ``l``, both cut with grams of at most ``l // 2`` characters, which leaves
every word at least one untouched gram. Shorter words than ``2 * LOW`` are not grouped.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import materialize

LETTERS = "A-Za-zÀ-ÿ"
LEAST, RARE, RATIO, NOISE = 7, 2, 10, 31
LOW, HIGH = 2, 8
#: A gram is prolonged if it makes over 1 / FREQUENT of all gram places of its length, to grams that make 1 / (8 * FREQUENT).
FREQUENT = 10_000
BASE, PRIME = 1_000_003, (1 << 61) - 1


def corpus_words(docs: DataFrame, least: int = LEAST, rare: int = RARE, noise: int = NOISE) -> DataFrame:
    """``word, n``: distinct words of at least ``least`` characters that occur ``rare`` times or more in ``docs(doc_id, text)``.

    Words are runs of letters with A-Z in lower case. Of every run whose checksum with its document's id is divisible by
    ``noise``, one character is left out, so that misspelt words are there to be found. Null text has no words; a null id
    counts as an empty one; repeated rows count again.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"),
    )
    lowered = runs.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    hashed = lowered.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= rare)


@dataclass
class Grams:
    """A dictionary: ``counts`` of its grams, closed under beginnings of at least ``low`` characters."""

    counts: dict[str, int]
    low: int = LOW
    open: set[str] = field(init=False)
    inner: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.open = {g[:-1] for g in self.counts if len(g) > self.low}
        self.inner = {}
        for gram in self.counts:
            for start in range(1, len(gram) - self.low + 1):
                part = gram[start:]
                self.inner[part] = min(len(gram), self.inner.get(part, len(gram)))

    def decompose(self, word: str, high: int) -> list[tuple[int, int, int]]:
        """Start, end and reach of each gram, longest matches of at most ``high`` characters.

        Reach is the first place that no match up to this start has looked at; the end of the word counts as a place.
        """
        found, furthest, reach, size = [], 0, 0, len(word)
        for start in range(size - self.low + 1):
            end = start + self.low
            looked = end
            while end - start < high and word[start:end] in self.open:
                looked = end + 1
                if end == size or word[start : end + 1] not in self.counts:
                    break
                end += 1
                looked = end
            reach = max(reach, looked)
            if end > furthest:
                found.append((start, end, reach))
                furthest = end
        return found

    def affected(self, word: str, grams: list[tuple[int, int, int]], high: int) -> int:
        """The most of the word's ``grams`` that one edit may change."""

        size, starts, reaches = len(word), [g[0] for g in grams], [g[2] for g in grams]
        kept_after = []
        for rest in range(size + 1):
            first = bisect_left(starts, rest)
            # From here on grams end too far behind ``rest`` to be covered from before it.
            safe = bisect_left(starts, rest + high - self.low)
            near = sum(e - rest >= high or self.inner.get(word[rest:e], high + 1) > high for _, e, _ in grams[first:safe])
            kept_after.append(near + len(grams) - safe)
        worst = 0
        for place in range(size + 1):
            # An insertion before this place, then a replacement or deletion at it.
            after = kept_after[place] if place == size else min(kept_after[place], kept_after[place + 1])
            worst = max(worst, len(grams) - bisect_right(reaches, place) - after)
        return worst

    def keys(self, word: str, band: int) -> list[str]:
        """The lists that ``word`` is merged with among words of ``band`` and ``band + 1`` characters."""
        high = min(HIGH, band // 2)
        grams = self.decompose(word, high)
        rarest = sorted(grams, key=lambda g: (self.counts.get(word[g[0] : g[1]], 0), word[g[0] : g[1]], g[0]))
        found = []
        for start, end, _ in rarest[: self.affected(word, grams, high) + 1]:
            found.append(f"{band}:<:{end}:{end - start}:{_short(word[:end])}")
            found.append(f"{band}:>:{len(word) - start}:{end - start}:{_short(word[start:])}")
        return found


def gram_dictionary(words: DataFrame, low: int = LOW, high: int = HIGH, frequent: int = FREQUENT) -> Grams:
    """The dictionary of ``words(word)``, from counts over all of them, one length after the other.

    At most ``frequent`` grams of a length are prolonged, to at most ``8 * frequent``, so what the driver gets is bounded.
    """
    kept: dict[str, int] = {}
    prolonged: set[str] | None = None
    for size in range(low, high + 1):
        total = words.select(F.sum(F.greatest(F.length("word") - size + 1, F.lit(0)))).first()[0] or 0

        def run(batches: Iterator[pa.RecordBatch], size=size, prolonged=prolonged) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            for batch in batches:
                for word in batch.column(0).to_pylist():
                    grams = [word[i : i + size] for i in range(len(word) - size + 1)]
                    seen.update(grams if prolonged is None else [g for g in grams if g[:-1] in prolonged])
                if len(seen) > 500_000:
                    yield _counted(seen)
                    seen.clear()
            yield _counted(seen)

        summed = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        found = {r.gram: r.n for r in summed.where(F.col("n") * (8 * frequent) > total).collect()}
        kept |= found
        prolonged = {g for g, n in found.items() if n * frequent > total}
        if not prolonged:
            break
    return Grams(kept, low)


def _counted(seen: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["gram", "n"])


def _short(text: str) -> str:
    """The text, or a digest of a long one."""
    return text if len(text) <= 32 else blake2b(text.encode(), digest_size=16).hexdigest()


def _holes(word: str, exact: bool) -> list:
    """What is left of ``word`` without the character at each place: the text itself, or a number that tells it."""
    if exact:
        return [word[:at] + word[at + 1 :] for at in range(len(word))]
    ahead, power, powers = [0], 1, [1]
    for c in word:
        ahead.append((ahead[-1] * BASE + ord(c)) % PRIME)
        power = power * BASE % PRIME
        powers.append(power)
    size, whole = len(word), ahead[-1]
    return [(ahead[at] * powers[size - at - 1] + whole - ahead[at + 1] * powers[size - at - 1]) % PRIME for at in range(size)]


def one_edit_apart(words: list[str], band: int) -> Iterator[tuple[str, str]]:
    """Pairs of distinct words one edit apart, of lengths ``band`` and ``band`` or ``band + 1``; linear in words and pairs."""
    exact = band <= 64
    words = sorted(set(words))
    shorter = [w for w in words if len(w) == band]
    replaced: dict[tuple, list[str]] = defaultdict(list)
    for word in shorter:
        for at, left in enumerate(_holes(word, exact)):
            replaced[at, left].append(word)
    for (at, _), alike in replaced.items():
        for i, word in enumerate(alike):
            for other in alike[:i]:
                if exact or word[:at] == other[:at] and word[at + 1 :] == other[at + 1 :]:
                    yield word, other
    whole = {(w if exact else _holes(w + " ", False)[-1]): w for w in shorter}
    for word in (w for w in words if len(w) > band and whole):
        seen = set()
        for at, left in enumerate(_holes(word, exact)):
            if left in whole and left not in seen and (exact or word[:at] + word[at + 1 :] == whole[left]):
                seen.add(left)
                yield word, whole[left]


def near_words(words: DataFrame, dictionary: Grams) -> DataFrame:
    """``word, other, other_n``: all ordered pairs of ``words(word, n)`` that are one edit apart, some more than once."""
    shared = words.sparkSession.sparkContext.broadcast(dictionary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                keys, own, times = [], [], []
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = [k for band in (len(word) - 1, len(word)) if band >= 2 * LOW for k in shared.value.keys(word, band)]
                    keys += found
                    own += [word] * len(found)
                    times += [n] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(own, pa.string()), pa.array(times, pa.int64())], names=["key", "word", "n"])

    # A stated number of tasks: words are few bytes but much work.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = words.select("word", "n").repartition(tasks, "word").mapInArrow(index, "key string, word string, n long")
    # Words of one list come together; its name says the band and what they share.
    lined = listed.repartition(F.xxhash64("key")).sortWithinPartitions("key")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, {}, []

        def flush():
            if len(held) > 1:
                band, side, common = key.split(":", 3)[:3]
                band, ahead, common = int(band), side == "<", int(common)
                # Only what is not shared is compared; a band of the rest follows from it.
                rest = {(w[common:] if ahead else w[: len(w) - common]): w for w in held}
                for a, b in one_edit_apart(list(rest), band - common):
                    a, b = rest[a], rest[b]
                    found.extend(((a, b, held[b]), (b, a, held[a])))

        def batch():
            columns = list(zip(*found)) or [(), (), ()]
            types = (pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["word", "other", "other_n"])

        for rows in batches:
            for own, word, n in zip(*(c.to_pylist() for c in rows.columns)):
                if own != key:
                    flush()
                    key, held = own, {}
                    if len(found) > 20_000:
                        yield batch()
                        found.clear()
                held[word] = n
        if key is not None:
            flush()
        yield batch()

    return lined.mapInArrow(merge, "word string, other string, other_n long")


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words(word, n)``, whose words are distinct.

    Near words differ by exactly one inserted, deleted or replaced character. The form is the near word of largest ``n``
    (ties: smallest by code point) if that is at least ``ratio`` times the word's own, else null; the root is where forms
    lead, the word itself if it has none. Null words are left out; words below ``2 * LOW`` characters have no near words;
    an empty table gives no rows.
    """
    words = materialize(words.where("word IS NOT NULL").select("word", "n"), "words")
    pairs = near_words(words, gram_dictionary(words)).repartition("word")
    once = pairs.groupBy("word", "other").agg(F.first("other_n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = once.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.n") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word",
        F.when(enough, F.col("best.word")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.n")).alias("form_n"),
    )
    formed = materialize(formed, "forms")
    # Every step multiplies n by the ratio, so few rounds of doubling reach every root.
    step = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        led = materialize(step.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        step = led.select("word", "root")
        if led.where("moved").isEmpty():
            break
    rooted = formed.join(step, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

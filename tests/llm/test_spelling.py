"""Near words, forms and roots against every pair of words; bounds of affected grams against real edits."""

import random
import zlib
from collections import Counter

import pytest

from tideline.llm import spelling
from tideline.llm.spelling import Grams

SCHEMA = "word string, n long"


def edits(word, letters="abé"):
    for at in range(len(word) + 1):
        for c in letters:
            yield word[:at] + c + word[at:]
            if at < len(word):
                yield word[:at] + c + word[at + 1 :]
        if at < len(word):
            yield word[:at] + word[at + 1 :]


def wanted(counts, ratio=10):
    near = {w: sorted({e for e in edits(w, sorted(set("".join(counts)))) if e in counts and e != w}, key=lambda o: (-counts[o], o)) for w in counts}
    form = {w: o[0] if o and counts[o[0]] >= ratio * counts[w] else None for w, o in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def random_words(seed, count, least=7, most=14):
    rng = random.Random(seed)
    parts = ["th", "er", "an", "in", "a", "é", "ion", "s"]
    found = set()
    while len(found) < count:
        word = "".join(rng.choice(parts) for _ in range(12))[: rng.randint(least, most)]
        found |= {word, rng.choice(list(edits(word)))}
    return {w: rng.choice((2, 3, 30, 400, 5000)) for w in found if len(w) >= least}


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    counts = random_words(seed, 1500)
    found = spelling.variant_groups(spark.createDataFrame(list(counts.items()), SCHEMA))
    assert {tuple(r) for r in found.collect()} == wanted(counts) and len({r[1] for r in wanted(counts)}) > 50


@pytest.mark.parametrize("frequent", [1, 20, 10_000])
def test_any_dictionary_loses_no_pair(spark, frequent):
    counts = random_words(9, 400)
    words = spark.createDataFrame(list(counts.items()), SCHEMA)
    pairs = spelling.near_words(words, spelling.gram_dictionary(words, frequent=frequent)).distinct()
    found = {(r.word, r.other) for r in pairs.collect()}
    letters = set("".join(counts))
    assert found == {(w, e) for w in counts for e in edits(w, letters) if e in counts and e != w}


def test_untouched_grams_stay():
    rng = random.Random(4)
    counts = Counter(w[i : i + n] for w in random_words(4, 300) for n in range(2, 9) for i in range(len(w) - n + 1))
    grams = Grams({g: c for g, c in counts.items() if len(g) == 2 or all(counts[g[:k]] > 20 for k in range(2, len(g)))})
    for word in random_words(5, 300):
        for other in rng.sample(list(edits(word)), 20):
            band = min(len(word), len(other))
            high = min(spelling.HIGH, band // 2)
            own, theirs = (Counter(w[s:e] for s, e, _ in grams.decompose(w, high)) for w in (word, other))
            listed = grams.decompose(word, high)
            assert grams.affected(word, listed, high) < len(listed)
            if other != word:
                assert (own & theirs).total() >= len(listed) - grams.affected(word, listed, high)
                assert set(grams.keys(word, band)) & set(grams.keys(other, band))


def test_words_of_documents(spark):
    texts = {1: "Théatre thEATRE× écoleS1abcdefgh ABCDEFGH " * 3, 2: None, 3: "", None: "Abcdefgh abcdefghi\nÀÉabcde"}
    texts |= {i: "mountains of mountains and rivers" for i in range(100, 200)}
    seen = Counter()
    import re

    for i, text in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                seen[run] += 1
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, word string, n int")
    found = {r.word: r.n for r in spelling.corpus_words(docs).collect()}
    assert found == {w: n for w, n in seen.items() if n >= 2} and any(w not in ("mountains",) and "ountain" in w or "mount" in w for w in found)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.variant_groups(empty).collect() == []
    assert spelling.corpus_words(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    odd = [("a", 5), ("ab", 5), (None, 3), ("x" * 50_000, 2), ("x" * 49_999, 90), ("7<3:abcdefg", 2), ("7<3:abcdeg", 40), ("a" * 8, 2), ("a" * 9, 2)]
    found = {r.word: (r.form, r.n_near) for r in spelling.variant_groups(spark.createDataFrame(odd, SCHEMA)).collect()}
    assert found["a"] == (None, 0) and found["ab"] == (None, 0) and None not in found and len(found) == 8
    assert found["x" * 50_000] == ("x" * 49_999, 1) and found["7<3:abcdefg"] == ("7<3:abcdeg", 1) and found["a" * 8] == (None, 1)


def test_chains_of_forms(spark):
    chain = ["abcdefgh" + "z" * i for i in range(12)]
    rows = [(w, 2 * 10**i) for i, w in enumerate(chain)]
    found = {r.word: (r.form, r.root) for r in spelling.variant_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[w][1] == chain[-1] for w in chain) and found[chain[3]][0] == chain[4] and found[chain[-1]] == (None, chain[-1])

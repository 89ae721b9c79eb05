"""Forward sums against all segmentations, and held-out accuracy."""

import math

import numpy as np
import public_tokenizers

from tideline.llm import langid

PATH = public_tokenizers.path(langid.VOCABULARY)
SCHEMA = "doc_id long, text string, lang string, score string"


def all_cuts(word):
    if not word:
        yield []
    for n in range(1, min(langid.PIECE, len(word)) + 1):
        for rest in all_cuts(word[n:]):
            yield [word[:n], *rest]


def test_forward_sums_all_segmentations():
    none, tables = langid.vocabulary(PATH)
    rng = np.random.default_rng(0)
    chances = np.append(rng.random((none, 3)), np.zeros((1, 3)), axis=0)
    model = langid.LanguageModel(("a", "b", "c"), chances, PATH)
    words = ["the", "straße", "日x", "élève"]
    got = model.scores(words)
    for word, row in zip(words, got):
        total = np.zeros(3)
        for cut in all_cuts(langid.MARK + word):
            product = np.ones(3)
            for piece in cut:
                number = langid._numbers([piece], PATH)[len(piece) - 1][0, 0]
                product *= chances[number] if number < none else langid.UNKNOWN * (len(piece) == 1)
            total += product
        assert np.allclose(row, np.log(total))


def test_long_words_and_letters():
    model = langid.train({"a": {"ab": 3}, "b": {"cd": 3}}, PATH)
    long = model.scores(["ab" * 5000, "ab"])
    assert np.isfinite(long).all() and long[0, 0] > long[0, 1]
    assert langid.letter_words("²½ 123 _ !") == [] and langid.letter_words(None) == [] and langid.letter_words("一") == ["一"]
    assert langid.letter_words("A1b x²") == ["a", "b", "x²"]


def rows(n=240):
    rng = np.random.default_rng(7)
    pools = {"en": ["the", "and", "ing", "tion", "er"], "de": ["der", "und", "sch", "ein", "keit"], "fr": ["le", "et", "eau", "eux", "ment"]}
    made = []
    for i in range(n):
        lang = list(pools)[i % 3 if i % 9 else 0]
        words = ["".join(rng.choice(pools[lang], rng.integers(1, 3))) for _ in range(30)]
        made.append((i, " ".join(words), None if i % 10 == 0 else lang, "clash"))
    return made


def test_held_out_accuracy_and_odd_texts(spark):
    odd = [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, "12 !?", "en", "x"), (None, "the and the", "de", "x"), (5, "the", "en", "x"), (5, "the", "en", "x")]
    made = rows()
    docs = spark.createDataFrame([*made, *odd], SCHEMA)
    model = langid.fit(docs, sample_docs=40)
    found = langid.predict(docs, model, ("doc_id", "lang")).collect()
    assert len(found) == len(made) + len(odd)
    known = [r for r in found if r.doc_id is not None and r.doc_id < 1000 and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in known]) > 0.97
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id is not None and r.doc_id >= 1000)
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in found)


def test_held_out_is_the_crc_of_the_id(spark):
    import zlib

    ids = spark.createDataFrame([(i,) for i in [*range(50), -3, None]], "doc_id long")
    for r in ids.select("doc_id", langid.held_out(ids.doc_id).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "the", None, "x")], SCHEMA)
    assert [r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()] == ["und"]
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0

"""Base counts against plain loops; the ratio tells trusted documents from the rest."""

import re

import numpy as np

from tideline.llm import quality

SCHEMA = "doc_id long, text string, n_words string, quality int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit |= {i + j for i in places for j in range(8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(hit),
    }


def samples():
    rng = np.random.default_rng(2)
    texts = [None, "", " \n\t ", "a", "é🙂 <b>|&", "a\n\na\n b\nb\na", "x y " * 40, "\x1ca\x1c b", "a\r\nb\r\na"]
    for _ in range(60):
        words = list(rng.choice(["a", "b", "cé", "#d", "e"], rng.integers(1, 60)))
        texts.append("".join(w + str(rng.choice([" ", "\n", "  ", "\n\n"])) for w in words) + " ".join(words[: rng.integers(0, 30)]))
    return texts


def test_base_counts():
    for text in samples():
        assert quality.base_counts(None if text is None else text.encode()) == brute(text)


def corpus(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        pool = [f"g{j}" for j in range(300)] if good else [f"b{j}" for j in range(300)]
        rows.append((i, " ".join(rng.choice(pool, 120)), "clash", 9))
        if i % 2:
            labels.append((i, int(good), 0))
        elif i % 8 == 0:
            labels.append((i, 0, None))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_ratio_tells_kinds_apart(spark):
    docs, labels = corpus(spark)
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 400
    assert all(r.kept == (r.doc_id % 4 != 0) for r in got)


def test_odd_rows(spark):
    docs, labels = corpus(spark)
    texts = samples()
    odd = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a b", "x", 1)] * 2, SCHEMA)
    model = quality.fit(odd.unionByName(docs), labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 1)], labels.schema)))
    got = quality.score(odd, model).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = brute("a b" if r.doc_id is None else texts[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert r.base_failed == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert not (r.base_failed and r.kept)


def test_no_rows_and_no_labels(spark):
    docs, labels = corpus(spark)
    model = quality.fit(docs, labels.limit(0))
    assert quality.score(docs, model).where("NOT kept").count() == 0
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0

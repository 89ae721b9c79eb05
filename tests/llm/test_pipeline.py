"""Every stage on its own input, and the whole of it."""

from collections import Counter

import numpy as np

import corpus_pipeline
from tideline.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder):
    rng = np.random.default_rng(6)
    pools = {"en": ["the", "and", "ing", "tion", "er", "wh"], "de": ["der", "und", "sch", "ein", "keit", "ung"]}

    def words(lang, n):
        return ["".join(rng.choice(pools[lang], rng.integers(1, 4))) for _ in range(n)]

    rows = []
    for i in range(160):
        lang = ["en", "de"][i % 2]
        rows.append((i, " ".join(words(lang, 60)), lang if i % 5 else None, f"s{i % 3}", 1))
    near = rows[0][1].split()
    near[30] = "changed"
    rows += [(200, rows[0][1], "en", "s0", 1), (201, " ".join(near), "en", "s1", 1), (202, rows[1][1], "de", None, 1), (203, rows[1][1], "de", None, 1)]
    rows += [(300, None, "en", "s0", 0), (301, "", None, None, None), (302, "12 34 !", "en", "s0", 7), (303, "short text", "en", "s0", 10), (None, rows[7][1], "de", "s1", 1)]
    rows += [(4, rows[4][1], rows[4][2], "s1", 1)] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 100, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, folder):
    rows = write(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    count = Counter(r.doc_id for r in seen["language_id"])
    assert not {300, 301, 302} & set(count) and sum(count.values()) == len(rows) - 3
    assert 303 not in {r.doc_id for r in seen["quality_rules"]} and len(seen["quality_rules"]) >= 0.97 * (len(rows) - 4)
    kept = Counter(r.doc_id for r in seen["simhash_near_dedup"])
    assert not {200, 201, 202, 203, None} & set(kept) and set(kept.values()) == {1} and len(kept) >= 155
    mixed = Counter(r.doc_id for r in seen["mixing"])
    assert set(mixed) <= set(kept) and max(mixed.values()) <= 2 and sum(mixed.values()) > 1.3 * len(kept)
    assert sorted(r.doc_id for r in seen["bpe"]) == sorted(r.doc_id for r in seen["mixing"])
    assert all(len(r.ids) == r.n_tokens > 0 for r in seen["bpe"])
    assert corpus_pipeline.run(spark, folder).count() == len(seen["bpe"])


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(25):
        base = [f"w{x}" for x in rng.integers(0, 3000, 120)]
        texts.append(base)
        for edits in (1, 2, 12):
            other = list(base)
            for at in rng.choice(120, edits, replace=False):
                other[at] = f"n{rng.integers(10**6)}"
            texts.append(other)
    rows = [(i, " ".join(t), None, "s", 0) for i, t in enumerate(texts)] + [(900, "a b", None, None, 0), (901, "A b", None, None, 0), (902, None, None, None, 0), (903, None, None, None, 0)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}

    def shingles(t):
        return {tuple(t[i : i + 5]) for i in range(len(t) - 4)}

    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = shingles(texts[i]), shingles(texts[j])
            if len(a & b) >= 0.8 * len(a | b):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    want = {label.index(x) for x in set(label)} | {900, 902}
    assert kept == want


def test_no_documents(spark, folder):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0

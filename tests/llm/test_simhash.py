"""SimHash links against all pairs, and the defined results of odd inputs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import simhash
from tideline.llm.components import components

SCHEMA = "doc_id long, text string, lang string, key long, fp long"


def brute(rows, width, bits):
    def own(text):
        words = simhash.text_words(text.encode() if text is not None else None)
        runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
        counts = [sum(xxhash.xxh64_intdigest(r, 42) >> b & 1 for r in runs) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * counts[b] > len(runs))

    fps = [own(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        least[x] = min([y for y in (least.get(x), d) if y is not None], default=None)
    return sorted(((d, f, least[x]) for (d, _), f, x in zip(rows, fps, label)), key=str)


def found(df):
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in df.collect()), key=str)


def test_near_duplicates_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    pool = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = list(rng.choice(pool, rng.integers(1, 120)))
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(len(words))] = "X\tY"
            rows.append((len(rows), "\n".join(words)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "a"), (904, "A"), (904, "A"), (None, "a"), (905, "word " * 3000)]
    docs = spark.createDataFrame([(d, t, "en", 1, 2) for d, t in rows], SCHEMA)
    assert found(simhash.near_duplicates(docs)) == brute(rows, 4, 4)


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 4, 8])
def test_no_link_is_missed_and_buckets_are_split(spark, bits):
    rng = np.random.default_rng(bits)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(40):
            flip = 0
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                flip |= 1 << int(b)
            fps.add(int(c) ^ flip)
    fps = np.array(sorted(fps), np.uint64)
    classes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    label = {r.node % 2**64: r.label for r in components(simhash.links(classes, bits, bucket=50)).collect()}
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    for i, j in zip(*np.nonzero(apart <= bits)):
        parent[root(i)] = root(j)
    groups = {}
    for i, f in enumerate(fps):
        groups.setdefault(root(i), set()).add(label.get(int(f), int(f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_parts_cover_all_misses():
    sample = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)
    for rows in (10, 10**6, 10**10):
        for bits in (0, 4, 8):
            parts = simhash.plan_parts(sample, rows, bits)
            assert sum(p.miss + 1 for p in parts) == bits + 1
            assert len({b for p in parts for b in p.bits}) == sum(len(p.bits) for p in parts)


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, x) for x in range(1001, 1400)] + [(5, 5), (3, 2)]
    label = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert len({label[i] for i in range(61)}) == 1 and len({label[i] for i in range(1000, 1400)}) == 1
    assert label[0] != label[1000]
    assert components(spark.createDataFrame([], "a long, b long").select(F.col("a"), F.col("b"))).count() == 0

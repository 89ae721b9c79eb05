"""Groups of the near-dedup stage against all pairs, where fingerprints or samples of shingles do not tell."""

import numpy as np
import pytest

from tideline.llm import simhash

SCHEMA = "doc_id long, text string"


def wanted(texts, least=0.8):
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return set(label)


def kept(spark, texts):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 10**6, n)]


def test_partners_in_a_group_of_one_fingerprint(spark):
    rng = np.random.default_rng(1)
    bases = [["the"] * 1000 + words(rng, 60) for _ in range(20)]
    texts = bases + [[*b[:-1], "changed"] for b in bases]
    assert len({simhash.fingerprint([w.encode() for w in t], 2) for t in texts}) == 1
    assert wanted(texts) == set(range(20)) == kept(spark, texts)


def test_appended_and_cut_blocks(spark):
    rng = np.random.default_rng(2)
    bases = [words(rng, 200) for _ in range(60)]
    texts = bases + [b + words(rng, 48) for b in bases[:30]] + [b[42:] if i % 2 else b[:160] for i, b in enumerate(bases[30:])]
    want = wanted(texts)
    assert len(want) < 100 and want == kept(spark, texts)


def test_long_texts_are_compared_whole(spark):
    rng = np.random.default_rng(3)
    bases = [words(rng, 1504) for _ in range(40)]
    texts = bases + [b + words(rng, 365 if i % 2 else 385) for i, b in enumerate(bases)]
    want = wanted(texts)
    assert want == set(range(40)) | set(range(40, 80, 2)) and want == kept(spark, texts)


@pytest.mark.parametrize("block", [1, 4096, 1 << 26])
def test_groups_in_blocks(spark, monkeypatch, block):
    """Groups larger than a block of sets are tested in pairs of blocks, with the same result."""
    monkeypatch.setattr(simhash.held_pairs, "__defaults__", (block,))
    rng = np.random.default_rng(4)
    bases = [words(rng, 120) for _ in range(6)]
    texts = []
    for base in bases:
        own = list(base)
        for _ in range(12):
            texts.append(list(own))
            at = int(rng.integers(0, 116))
            own[at : at + 2] = words(rng, 2)
    want = wanted(texts)
    assert 6 <= len(want) < 40 and want == kept(spark, texts)


def test_links_that_connect():
    sets = {i: np.arange(i, i + 100, dtype=np.uint64) for i in range(0, 40, 5)}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    kept = simhash.linking(*map(list, zip(*pairs)), sets, 0.8)
    assert len(kept) == 7 and {pairs[i] for i in kept} <= {(a, b) for a, b in pairs if b - a <= 10}


def test_shared_keys(spark):
    rows = [(1, [5, 7, 9]), (2, [7]), (3, [9, 11, 7]), (4, []), (5, [13])]
    frame = spark.createDataFrame([(no, np.array(own, np.int64).tobytes()) for no, own in rows], "no long, prefix binary").repartition(3)
    common = spark.sparkContext.broadcast(np.array([13], np.uint64))
    found = {(r.key, r.no, r.place) for r in simhash.shared_keys(frame, common).collect()}
    assert found == {(7, 1, 1), (7, 2, 0), (7, 3, 2), (9, 1, 2), (9, 3, 0), (13, 5, 0)}


def test_cells_never_leave_out():
    rng = np.random.default_rng(5)
    x, y = (np.unique(rng.integers(0, 3 * 10**5, n).astype(np.uint64)) * np.uint64(64) for n in (80_000, 120_000))
    bounds = simhash.most_common(*(np.frombuffer(simhash.cells(v), "<u2").astype(np.int64).reshape(1, 64) for v in (x, y)))
    assert bounds[0] >= len(np.intersect1d(x, y))


def family(rng, members, edits, length=120):
    """Copies of one text with some words changed: all share shingles, and only some are similar to each other."""
    base = words(rng, length)
    texts = [base]
    for _ in range(members):
        own = list(base)
        for at in rng.choice(length, edits, replace=False):
            own[at] = f"n{rng.integers(10**6)}"
        texts.append(own)
    return texts


def test_pairs_of_a_bucket_grow_with_its_rows():
    """All rows of a bucket may be similar to each other, and none is connected."""
    for rows in (10, 200, 3000):
        label, n, place = np.arange(rows), np.full(rows, 100), np.zeros(rows, np.int64)
        i, j, dense = simhash.bucket_pairs(label, n, place, 0.8, 16)
        assert len(i) <= 16 * rows and dense == (rows > 40)
        if dense:
            assert len(i) == rows - 1 and len(simhash.spanning(rows, i, j, np.zeros(len(i)))) == rows - 1
        else:
            assert len(i) == rows * (rows - 1) // 2


@pytest.mark.parametrize("halves", [False, True])
def test_group_links_against_all_pairs(halves):
    rng = np.random.default_rng(6)
    texts = [t for edits in (1, 3, 6) for t in family(rng, 30, edits)] + [[], [], words(rng, 3)]
    sets = [simhash.shingle_set([w.encode() for w in t], 5) for t in texts]
    label = np.arange(len(sets))
    label[[5, 8]] = 40
    later = rng.random(len(sets)) < 0.5 if halves else np.zeros(len(sets), bool)
    found = simhash.group_links(sets, label, later, 0.8)
    assert all(simhash.similar(sets[i], sets[j], 0.8) for i, j in found) and len(found) < len(sets)

    def joined(pairs):
        group = label.copy()
        for i, j in pairs:
            group[group == group[i]] = group[j]
        return {frozenset(np.flatnonzero(group == g)) for g in set(group)}

    every = [(i, j) for i in range(len(sets)) for j in range(i) if not halves or later[i] != later[j]]
    assert joined(found) == joined([(i, j) for i, j in every if simhash.similar(sets[i], sets[j], 0.8)])
    assert (1 if halves else 20) < len(joined(found)) < len(sets)


@pytest.mark.parametrize("sparse, block", [(0, 20_000), (2, 4096)])
def test_families_tested_as_groups(spark, monkeypatch, sparse, block):
    """Whether pairs or groups in blocks of any size are tested, the rows kept are those of all pairs."""
    monkeypatch.setattr(simhash.missing_pairs, "__defaults__", (simhash.BUCKET, sparse))
    monkeypatch.setattr(simhash.dense_links, "__defaults__", (block,))
    rng = np.random.default_rng(7)
    texts = [t for edits in (2, 3, 4, 5, 6) for t in family(rng, 25, edits)]
    want = wanted(texts)
    assert 5 < len(want) < 120 and want == kept(spark, texts)


def test_a_large_family_names_few_pairs(spark):
    rng = np.random.default_rng(8)
    made = {}
    for members in (100, 400):
        texts = family(rng, members, 9)
        rows = [(i, simhash.shingle_set([w.encode() for w in t], 5)) for i, t in enumerate(texts)]
        held = [(i, s.tobytes()) for i, s in rows]
        frame = spark.createDataFrame(held, "no long, prefix binary")
        common = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
        known = spark.createDataFrame([(i, i, len(s)) for i, s in rows], "no long, label long, n int")
        made[members] = simhash.missing_pairs(known, simhash.shared_keys(frame, common), 0.8).distinct().count()
    assert made[100] > 0 and made[400] < 8 * made[100]

"""Hard negatives against all scores; the tree's bounds and how much they leave out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import negatives
from tideline.llm.negatives import Group, Vectors

SCHEMA = "vec_id long, embedding array<double>, label int, group string, id string"


def wanted(rows, every=10, positives=5, most=3):
    usable = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            key = (label, [math.floor(256 * x) for x in v])
            usable[i] = min(key, usable.get(i, key))

    def score(a, b):
        return sum(x * y for x, y in zip(usable[a][1], usable[b][1]))

    out = set()
    for a in usable:
        if a % every:
            continue
        ranked = sorted(((-score(a, b), b) for b in usable if b != a))
        for p, pos in [x for x in ranked if usable[x[1]][0] == usable[a][0]][:positives]:
            fit = [(s, n) for s, n in ranked if usable[n][0] != usable[a][0] and 50 * -p <= 100 * -s <= 95 * -p]
            out |= {(a, pos, r + 1, n, -p, -s) for r, (s, n) in enumerate(fit[:most])}
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, "g", "x") for i, v, label in rows], SCHEMA)
    result = negatives.hard_negatives(df, F.col("id") % 10 == 0, F.col("label"), **more)
    got = [tuple(r) for r in result.collect()]
    assert len(got) == len(set(got))
    return set(got)


def clustered(seed, n, spread=0.3, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, (centres[i % 6] + spread * rng.normal(size=dim)).tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("group_rows, block_rows", [(1024, 8192), (5, 37)])
def test_against_all_scores(spark, group_rows, block_rows):
    rows = clustered(1, 600)
    assert found(spark, rows, group_rows=group_rows, block_rows=block_rows) == wanted(rows) != set()


def test_odd_rows(spark):
    rows = clustered(2, 120)
    rows += [(500, None, 1), (510, [1.0] * 16, None), (520, [math.nan] * 16, 1), (530, [None] + [1.0] * 15, 1), (540, [math.inf] * 16, 2), (None, [1.0] * 16, 1)]
    rows += [(550, [], 1), (560, [0.0] * 16, 2), (570, [0.5] * 20, 1), (580, [-1.0] * 4, 3)]
    rows += [(10, rows[10][1], rows[10][2]), (20, [0.1] * 16, 0), (20, [0.1] * 16, 3)]
    rows += [(i, rows[0][1], i % 3) for i in range(600, 680)]
    assert found(spark, rows) == wanted(rows)


def test_long_vectors_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(10**5, 10**6, 8) * 1.0).tolist(), i % 2) for i in range(80)]
    assert found(spark, rows, low=90, high=99) == {r for r in wanted_between(rows, 90, 99)} != set()
    assert found(spark, [*rows, (900, [1e300] * 8, 0), (910, [-1e200], 1)], low=90, high=99) == wanted_between(rows, 90, 99)


def wanted_between(rows, low, high):
    usable = {i: (label, [math.floor(256 * x) for x in v]) for i, v, label in rows}
    out = set()
    for a in (i for i in usable if i % 10 == 0):
        ranked = sorted((-sum(x * y for x, y in zip(usable[a][1], usable[b][1])), b) for b in usable if b != a)
        for p, pos in [x for x in ranked if usable[x[1]][0] == usable[a][0]][:5]:
            fit = [(s, n) for s, n in ranked if usable[n][0] != usable[a][0] and low * -p <= 100 * -s <= high * -p]
            out |= {(a, pos, r + 1, n, -p, -s) for r, (s, n) in enumerate(fit[:3])}
    return out


def test_nothing(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == set()
    assert found(spark, [(10, [1.0], 1)]) == set()


def test_tree():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(200, 5))
    points[50:60] = points[3]
    parent, edge = negatives.spanning_tree(points)
    assert (parent >= 0).sum() == 199 and edge[edge == 0].size >= 10
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    total, done = 0.0, {0}
    while len(done) < 200:
        rest = [i for i in range(200) if i not in done]
        block = apart[np.ix_(sorted(done), rest)]
        total += block.min()
        done.add(rest[int(block.min(axis=0).argmin())])
    assert abs(edge.sum() - total) < 1e-9
    order = negatives.walk(parent).tolist()
    assert sorted(order) == list(range(200)) and all(p < 0 or order.index(p) < order.index(i) for i, p in enumerate(parent.tolist()))


def test_bounds_leave_most_scores_out():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 32)) * 200
    whole = np.floor(centres[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 32)) * 4).astype(np.int64)
    labels, ids = rng.integers(0, 3, 4000), np.arange(4000)
    own = ids[::20]
    windows = np.tile(np.array([[[negatives.LOWEST, negatives.HIGHEST]]]), (200, 1, 1))
    group = Group.build(own, labels[own], whole[own], windows, np.zeros((200, 1, 2), np.int64), True, 5)
    _, scored = group.search(ids, labels, Vectors(whole))
    assert scored < 0.2 * 200 * 4000

"""Neighbours against brute force: exact scores, ties, and recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, class long"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if x is None else float(x) for x in v], 0, 7) for i, v in enumerate(vectors)], SCHEMA)


def brute(ids, vectors, asks, k):
    X = np.asarray(vectors, np.float32).astype(float)
    U = X / np.sqrt((X**2).sum(axis=1, keepdims=True))
    out = {}
    for i in np.flatnonzero(asks):
        scores = (U * U[i]).sum(axis=1)
        rest = np.flatnonzero(ids != ids[i])
        order = rest[np.lexsort((ids[rest], -np.round(scores[rest], 12)))][:k]
        out[int(ids[i])] = [(int(ids[j]), scores[j]) for j in order]
    return out


@pytest.mark.parametrize("group_rows", [64, 8192])
def test_recall_and_scores(spark, group_rows):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    vectors = np.concatenate([centres[rng.integers(0, 40, 2400)] + 0.4 * rng.normal(size=(2400, 24)), rng.normal(size=(600, 24))])
    vectors[1000:1700] = vectors[1000]
    df = frame(spark, vectors)
    got = {}
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, 5, sample_rows=800, leaf_rows=100, group_rows=group_rows)
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(np.arange(3000), vectors, np.arange(3000) % 20 == 0, 5)
    assert set(got) == set(want)
    hits = 0
    for q, own in want.items():
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        ranked = [got[q][i] for i in range(1, 6)]
        assert ranked == sorted(ranked, key=lambda x: (-x[1], x[0])) and q not in [v for v, _ in ranked]
        hits += len({v for v, _ in ranked} & {v for v, _ in own})
        X = vectors.astype(np.float32).astype(float)
        for v, s in ranked:
            assert abs(s - X[q] @ X[v] / np.linalg.norm(X[q]) / np.linalg.norm(X[v])) < 1e-12
    assert hits / (5 * len(want)) >= 0.9
    for q in range(1000, 1700, 20):
        assert [got[q][i][0] for i in range(1, 6)] == [x for x in range(1000, 1006) if x != q][:5]


def test_unusable_rows_and_few_candidates(spark):
    vectors = [[1, 0], [0, 1], None, [0, 0], [float("nan"), 1], [None, 1], [float("inf"), 1], [1, 1], [], [1, 2, 3]]
    df = frame(spark, vectors).unionByName(frame(spark, [[1, 0]]).withColumn("vec_id", F.lit(None).cast("long"))).unionByName(frame(spark, [[1, 0]]))
    got = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(df, F.lit(True)).collect()}
    assert got == {(0, 1): 7, (0, 2): 1, (1, 1): 7, (1, 2): 0, (7, 1): 0, (7, 2): 1}


def test_no_rows(spark):
    assert ann.nearest(frame(spark, [[1, 2]]).limit(0), F.lit(True)).count() == 0
    assert ann.nearest(frame(spark, [[1, 2]]), F.lit(True)).count() == 0

"""Exact order statistics by radix refinement against sorting."""

import math
import random

import pytest

from tideline.operators import stats


def expected(values, p):
    return sorted(values)[max(1, math.ceil(p * len(values))) - 1]


POINTS = {"lowest": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "highest": 1.0}


@pytest.mark.parametrize("sent", [0, 10_000])
@pytest.mark.parametrize("kind", ["double", "float", "bigint", "int"])
def test_against_sorting(spark, monkeypatch, kind, sent):
    monkeypatch.setattr(stats, "SENT_RANKS", sent)
    rng = random.Random(kind)
    rows = []
    for i in range(3000):
        key = rng.choice(["a", "a", "b", None])
        value = rng.choice([rng.gauss(0, 1e6), rng.gauss(0, 1e-6), 7.0, 7.0, -3.5])
        rows.append((key, int(value) if kind in ("bigint", "int") else value))
    rows += [("a", None), ("c", None), ("d", 5 if "int" in kind else -0.0)]
    df = spark.createDataFrame(rows, "k string, v bigint" if "int" in kind else "k string, v double").selectExpr("k", f"CAST(v AS {kind}) AS v")
    values: dict = {}
    for r in df.collect():
        if r.v is not None:
            values.setdefault(r.k, []).append(r.v)
    found = {r.k: r for r in stats.radix_percentiles(df, "v", POINTS, ["k"]).collect()}
    assert set(found) == set(values) and None in found
    for key, r in found.items():
        assert r["n"] == len(values[key]) and r["max"] == max(values[key])
        assert {p: r[p] for p in POINTS} == {p: expected(values[key], x) for p, x in POINTS.items()}


def test_extremes_and_no_keys(spark):
    values = [1e308, -1e308, 5e-324, -5e-324, 0.0, -0.0, float("inf"), float("-inf"), 1.0, 1.0 + 2**-52]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for rank, want in enumerate(sorted(values), 1):
        ranks = spark.createDataFrame([("x", rank)], "name string, rank long")
        assert stats.radix_select(df, "v", ranks).first().value == want
    nan = stats.radix_percentiles(df.unionByName(spark.sql("SELECT double('NaN') AS v")), "v", {"top": 1.0}).first()
    assert nan["n"] == 11 and math.isnan(nan["top"])
    assert stats.radix_percentiles(df.limit(0), "v", {"top": 1.0}).collect() == []


def test_equals_the_histogram(spark):
    df = spark.sql("SELECT id % 3 AS k, (id * id) % 101 AS value FROM range(5000)")
    histogram = df.groupBy("k", "value").count().withColumnRenamed("count", "n")
    points = {"p50": 0.5, "p95": 0.95}
    assert sorted(map(tuple, stats.radix_percentiles(df, "value", points, ["k"]).collect())) == sorted(
        map(tuple, stats.disc_percentiles(histogram, points, ["k"]).collect())
    )

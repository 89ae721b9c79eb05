"""The mix against plain loops, and the splitting tree's quotas."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tideline.llm import mixing

SCHEMA = "doc_id long, source string, size long, rank long"


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share >= 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * share for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def rows_of(seed, docs=400):
    rng = np.random.default_rng(seed)
    sources = ["b", "a", "é", "z", None, "A", "\U0001f600", "empty"]
    rows = [(i, sources[int(rng.zipf(1.6)) % 7], int(rng.integers(0, 900)), 1) for i in range(docs)]
    return [*rows, (1000, "empty", 0, 1), (None, "a", 50, 1), (7, "a", 50, 1), (7, "a", 50, 1)]


def test_targets_and_taken(spark):
    rows = rows_of(1)
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "source", "size")
    sized, pieces = mixing.mix(docs, block_words=1000, shard_blocks=4)
    got = mixing.taken_words(sized, pieces).collect()
    sizes = defaultdict(int)
    for _, s, n, _ in rows:
        sizes[s] += n
    want = brute_targets(sizes)
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter(r[:3] for r in rows)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.taken_words(*mixing.mix(docs.repartition(7), block_words=1000, shard_blocks=4)).collect()
    assert Counter(again) == Counter(got)
    ordered = mixing.in_order(pieces).collect()
    by_shard = defaultdict(list)
    for r in ordered:
        by_shard[r.shard].append(r.position)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in by_shard.values())
    words = pieces.groupBy("shard").agg(F.sum("n_words").alias("n")).collect()
    assert max(r.n for r in words) <= 4 * 1000


def test_quotas_are_dealt_whole(spark):
    quotas = {0: 500, 1: 100, 2: 0, 3: 7, 4: 393}
    df = spark.createDataFrame(list(quotas.items()), "rank long, quota long")
    rows = mixing.split_quotas(df, 1000, 16).collect()
    assert Counter({r: sum(x.quota for x in rows if x["rank"] == r) for r in quotas}) == Counter(quotas)
    per_shard = Counter()
    for r in rows:
        per_shard[r.shard] += r.quota
    assert len(per_shard) == 63 and max(per_shard.values()) <= 17


def test_hypergeometric_has_its_mean_and_spread(spark):
    u = (F.col("id") + 0.5) / 4000
    one = spark.range(4000).select(mixing.hypergeometric(u, F.lit(30), F.lit(70), F.lit(20)).alias("x"))
    got = one.agg(F.avg("x").alias("m"), F.variance("x").alias("v"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    assert abs(got.m - 6) < 0.02 and abs(got.v - 20 * 0.3 * 0.7 * 80 / 99) < 0.05
    assert got.low >= 0 and got.high <= 20
    edge = spark.range(5).select(
        mixing.hypergeometric(F.lit(0.999999), F.col("id"), F.lit(0), F.col("id")).alias("all"),
        mixing.hypergeometric(F.lit(0.5), F.lit(0), F.col("id"), F.lit(0)).alias("none"),
    )
    assert [(r["all"], r.none) for r in edge.orderBy("all").collect()] == [(i, 0) for i in range(5)]


def test_no_rows_and_no_words(spark):
    empty = spark.createDataFrame([], SCHEMA).select("doc_id", "source", "size")
    assert mixing.taken_words(*mixing.mix(empty)).count() == 0
    blank = spark.createDataFrame([(1, None, 0, 1), (2, "a", 0, 1)], SCHEMA).select("doc_id", "source", "size")
    assert [(r.taken, r.target) for r in mixing.taken_words(*mixing.mix(blank)).collect()] == [(0, 0.0)] * 2


def test_whole_documents_in_the_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 9)), f"s{i % 4}", None) for i in range(80)] + [(5, "x y", "s1", "k"), (5, "x y", "s1", "k"), (99, None, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, times string")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter(out.collect())
    assert set(got) <= set(docs.collect()) and max(n for r, n in got.items() if r.doc_id != 5) <= 2
    assert all(r.text and r.text.strip() for r in got)


def test_word_count(spark):
    texts = [None, "", " \t", "a", "a b", " a  b\x0bc\x1cd ", " x y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.n for r in df.select(mixing.word_count(F.col("text")).alias("n")).collect()] == [0, 0, 0, 1, 2, 3, 2]

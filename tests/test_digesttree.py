"""Stored hash trees: roots by hand, and damage found by reading few nodes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tideline.operators import digesttree


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def root_of(digests, fan_in):
    while len(digests) > 1:
        digests = [sha(digests[i : i + fan_in]) for i in range(0, len(digests), fan_in)]
    return digests[0]


def chunks(spark, n, changed=()):
    return spark.createDataFrame([(i, f"d{i}{'x' if i in changed else ''}") for i in range(n)], "chunk_no long, digest string")


@pytest.mark.parametrize("n, fan_in", [(1, 4), (4, 4), (5, 4), (100, 3)])
def test_root(spark, folder, n, fan_in):
    levels = digesttree.store_tree(chunks(spark, n), folder, "t", fan_in)
    top = digesttree.read_level(spark, folder, "t", levels - 1).collect()
    assert [(r.node, r.digest) for r in top] == [(0, root_of([f"d{i}" for i in range(n)], fan_in))]


def test_damage_is_found_by_a_logarithmic_part(spark, folder):
    n, fan_in = 4096, 8
    levels = digesttree.store_tree(chunks(spark, n), f"{folder}/a", "t", fan_in)
    assert levels == 5
    for changed in ([], [1234], [0, 4095]):
        digesttree.store_tree(chunks(spark, n, changed), f"{folder}/b", "t", fan_in)
        found = digesttree.differing_chunks(spark, f"{folder}/a", f"{folder}/b", "t", levels, fan_in)
        assert sorted(r.chunk_no for r in found.chunks.collect()) == changed
        assert found.nodes_read <= 2 + 2 * len(changed) * fan_in * (levels - 1)


def test_many_damaged_chunks_and_a_shorter_tree(spark, folder, monkeypatch):
    monkeypatch.setattr(digesttree, "NAMED", 3)
    digesttree.store_tree(chunks(spark, 60), f"{folder}/a", "t", 4)
    digesttree.store_tree(chunks(spark, 58, range(0, 58, 2)), f"{folder}/b", "t", 4)
    found = digesttree.differing_chunks(spark, f"{folder}/a", f"{folder}/b", "t", 4, 4)
    assert sorted(r.chunk_no for r in found.chunks.collect()) == [*range(0, 58, 2), 58, 59]


def test_damaged_keys(spark):
    keys = spark.sql("SELECT id DIV 10 AS chunk_no, id AS rn, id * 3 AS pk, 'f' || id AS fp, CAST(NULL AS STRING) AS parent_key FROM range(50)")
    copy = keys.where("rn <> 12").withColumn("fp", F.when(F.col("rn") == 17, "").otherwise(F.col("fp")))
    copy = copy.unionByName(spark.sql("SELECT 1L AS chunk_no, 99L AS rn, 7L AS pk, 'n' AS fp, CAST(NULL AS STRING) AS parent_key"))
    some = spark.createDataFrame([(1,)], "chunk_no long")
    found = {(r.chunk_no, r.rn, r.pk, r.state) for r in digesttree.damaged_keys(keys, copy, some).collect()}
    assert found == {(1, 12, 36, "lost"), (1, 17, 51, "changed"), (1, 99, 7, "added")}


def test_hundreds_of_named_parents_far_from_each_other(spark, folder):
    parents = [*range(0, 4000, 8), 4001, 4002]
    wanted = digesttree.children_of(parents, 4)
    found = [r.node for r in spark.range(20_000).withColumnRenamed("id", "node").where(wanted).orderBy("node").collect()]
    assert found == [n for p in parents for n in range(4 * p, 4 * p + 4)]
    changed = range(0, 8000, 16)
    digesttree.store_tree(chunks(spark, 8000), f"{folder}/a", "t", 4)
    levels = digesttree.store_tree(chunks(spark, 8000, changed), f"{folder}/b", "t", 4)
    damage = digesttree.differing_chunks(spark, f"{folder}/a", f"{folder}/b", "t", levels, 4)
    assert sorted(r.chunk_no for r in damage.chunks.collect()) == [*changed]

"""The key filter: no key is missed, few others pass, and what it rules out is never shuffled."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import keyfilter, removal


@pytest.mark.parametrize("kind", ["bigint", "string", "decimal(20,2)", "date"])
def test_no_key_is_missed_and_few_others_pass(spark, kind):
    value = "date_add(DATE '1970-01-01', CAST(id AS INT))" if kind == "date" else f"CAST(id AS {kind})"
    rows = spark.sql(f"SELECT {value} AS k, id FROM range(60000) UNION ALL SELECT NULL, -1")
    keys = rows.where("id % 20 = 3")
    tested = keyfilter.key_filter(keys.select("k"), "k", 3000)
    may, cannot = tested.may_hold(rows, "k"), tested.cannot_hold(rows, "k")
    assert may.columns == ["k", "id"] == cannot.columns
    found = {r.id for r in may.collect()}
    assert {i for i in range(60000) if i % 20 == 3} <= found and len(found) < 3000 * 1.2
    assert {r.id for r in cannot.collect()} == {-1, *range(60000)} - found


def test_a_filter_of_bounded_size_still_misses_none(spark, monkeypatch):
    monkeypatch.setattr(keyfilter, "MOST_WORDS", 256)
    rows = spark.range(20000)
    tested = keyfilter.key_filter(rows.where("id % 2 = 0"), "id", 10_000)
    assert tested.words == 256 and tested.table.count() <= 256
    assert {r.id for r in tested.may_hold(rows, "id").collect()} >= set(range(0, 20000, 2))


def test_types_of_keys_and_rows_may_differ(spark):
    keys = spark.sql("SELECT CAST(id * 7 AS STRING) AS pk FROM range(50)")
    tested = keyfilter.key_filter(keys, "pk", 50, T.LongType())
    assert {r.id for r in tested.may_hold(spark.range(350), "id").collect()} >= set(range(0, 350, 7))


def test_no_keys(spark):
    tested = keyfilter.key_filter(spark.range(0), "id", 0)
    assert tested.may_hold(spark.range(100), "id").count() == 0 and tested.cannot_hold(spark.range(100), "id").count() == 100


def test_ruled_out_rows_are_tested_before_any_shuffle(spark, folder):
    spark.range(200_000, numPartitions=4).withColumn("label", F.concat(F.lit("x"), "id")).write.parquet(f"{folder}/live")
    live = spark.read.parquet(f"{folder}/live")
    spark.sql("SELECT id * 100 AS pk, 'deleted' AS outcome FROM range(500)").write.parquet(f"{folder}/outcomes")
    outcomes = spark.read.parquet(f"{folder}/outcomes")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = removal.survivors(live, "id", outcomes)
        written = f"{folder}/kept"
        before = _shuffle_records(spark)
        kept.write.parquet(written)
        assert _shuffle_records(spark) - before < 5000  # 500 doomed rows, the few taken for them, and the filter itself
        assert spark.read.parquet(written).count() == 199_500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _shuffle_records(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

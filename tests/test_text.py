"""Masking and the other text helpers."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import text


def run(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("postgresql://app:s3cret@db.example.com/x", "postgresql://app:[REDACTED]@db.example.com/x"),
        ("POSTGRES://app:p w@h", "POSTGRES://app:p w@h"),
        ("Authorization header bearer abc.DEF-1~2", "Authorization header Bearer [REDACTED]"),
        ("x eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh_-1 y", "x [REDACTED_JWT] y"),
        ("key sb_secret_a1-B2", "key [REDACTED_SUPABASE_KEY]"),
        ("password = \"a b\" next", "password=[REDACTED] next"),
        ("token:'a b', rest", "token=[REDACTED], rest"),
        ("API-KEY=abc;next", "API-KEY=[REDACTED];next"),
        ("étoken=abc", "étoken=[REDACTED]"),  # an accented letter does not continue a word
        ("xtoken=abc", "xtoken=abc"),
        ("token = abc def", "token=[REDACTED] def"),
        ("nothing here", "nothing here"),
    ],
)
def test_masks(spark, given, expected):
    assert run(spark, given, text.redact(F.col("t"))) == expected


def test_secret_late_in_a_long_text(spark):
    given = "word " * 5000 + "token=abc"
    assert run(spark, given, text.redact(F.col("t"))).endswith("token=[REDACTED]")
    short = run(spark, given, text.shorten(text.redact(F.col("t"))))
    assert len(short) == 1001 and short.endswith("…")


def test_null_text(spark):
    assert run(spark, None, text.redact(F.col("t"))) is None


def test_names(spark):
    assert run(spark, "public.my table!", text.file_safe_name(F.col("t"))) == "public.my_table_"
    assert run(spark, "public.x", text.short_name(F.col("t"))) == "x"
    assert run(spark, "x", text.qualified_name(F.lit("public"), F.col("t"))) == "x"
    assert run(spark, "x", text.qualified_name(F.lit("sales"), F.col("t"))) == "sales.x"


def test_forbidden_facts(spark):
    facts = F.create_map(F.lit("userEmail"), F.col("t"), F.lit("rows"), F.col("t"))
    assert run(spark, "1", text.forbidden_facts(facts)) == ["userEmail"]


def test_allow_list(spark):
    kept = text.allow_list_fields(F.col("t"), {"job": "string", "rows": "bigint"})
    assert run(spark, '{"job": "a", "rows": 5, "password": "x"}', kept).asDict() == {"job": "a", "rows": 5}


def test_search(spark):
    assert run(spark, "Hello World", text.contains_text([F.col("t"), F.lit(None)], " WORLD "))
    assert run(spark, "Hello", text.contains_text([F.col("t")], ""))
    assert not run(spark, None, text.contains_text([F.col("t")], "x"))

"""Exact order statistics: over histograms of discrete measures, and by radix refinement of continuous ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tideline.session import materialize

#: Bits told in a round, and the most ranks that are sent to every task instead of being shuffled with the rows.
DIGIT_BITS, SENT_RANKS = 16, 10_000


def _ranked(histogram: DataFrame, by: Sequence[str]) -> DataFrame:
    """Running and total counts over distinct values; the window sees one row per value, never one per record."""
    keys = list(by) or [F.lit(0)]
    ordered = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return histogram.withColumn("_upto", F.sum("n").over(ordered)).withColumn(
        "_all", F.sum("n").over(Window.partitionBy(*keys))
    )


def _value_at(rank: Column) -> Column:
    """Smallest value whose running count reaches a 1-based rank."""
    return F.min(F.when(F.col("_upto") >= rank, F.col("value")))


def index_percentiles(histogram: DataFrame, points: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """The value at index floor(p·n), at most the last, of the sorted measure; and the maximum."""
    picks = [
        _value_at(F.least(F.col("_all"), F.floor(F.lit(p) * F.col("_all")) + 1)).alias(name)
        for name, p in points.items()
    ]
    return _ranked(histogram, by).groupBy(*by).agg(F.sum("n").alias("n"), *picks, F.max("value").alias("max"))


def disc_percentiles(histogram: DataFrame, points: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """The first value whose share of the rows reaches p."""
    picks = [
        _value_at(F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_all")))).alias(name) for name, p in points.items()
    ]
    return _ranked(histogram, by).groupBy(*by).agg(F.sum("n").alias("n"), *picks, F.max("value").alias("max"))


def ordered_bits(value: Column, kind: T.DataType) -> Column:
    """A long that is in order as a number is: whole numbers are themselves, others by the bits of their double.

    NaN comes last, as in an ORDER BY, and the two zeros are one.
    """
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value.cast("long")
    raw = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(raw < 0, raw.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(raw)


def number_of_bits(bits: Column, kind: T.DataType) -> Column:
    """The number that ``ordered_bits`` stands for, in its own type."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return bits.cast(kind)
    raw = F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    return F.call_function("reflect", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double").cast(kind)


def radix_select(rows: DataFrame, value: str, ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, name, value)``: the value at each 1-based ``rank`` of ``ranks(by, name, rank)`` in ``rows`` sorted by ``value``.

    Values are counted by their highest ``DIGIT_BITS`` bits, which tells the bucket that holds a rank and the rank in it; then
    only that bucket's rows are counted by the next bits, until all are told. So a task sees at most two to the
    ``DIGIT_BITS`` counts of a key and rank, however many distinct values there are, and a value that fills a third of all
    rows is one count a task. Null values have no rank; -0.0 counts as 0.0.
    """
    # As fields of a struct, null keys are equal in joins as they are in groups.
    named, keys, kind = F.struct(*by).alias("_key"), ["_key"] if by else [], rows.schema[value].dataType
    key, column = [named] if by else [], F.col(f"`{value}`")
    bits = rows.where(column.isNotNull()).select(*key, ordered_bits(column, kind).alias("_bits"))
    bits = materialize(bits, "bits")
    open_ranks = materialize(ranks.select(*key, "name", F.col("rank").cast("long").alias("rank")), "ranks")
    sent = open_ranks.count() <= SENT_RANKS
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        met, first = bits, shift == 64 - DIGIT_BITS
        if not first:
            wanted = open_ranks.select(*keys, "_prefix").distinct()
            met = met.withColumn("_prefix", F.shiftright("_bits", shift + DIGIT_BITS))
            met = met.join(F.broadcast(wanted) if sent else wanted, [*keys, "_prefix"], "left_semi")
        digits = met.groupBy(*keys, F.shiftright("_bits", shift).alias("_digits")).agg(F.count(F.lit(1)).alias("_n"))
        if not first:
            digits = digits.withColumn("_prefix", F.shiftright("_digits", DIGIT_BITS))
        on = keys if first else [*keys, "_prefix"]
        met = open_ranks.join(digits, on) if on else open_ranks.withColumn("_one", F.lit(1)).join(digits.withColumn("_one", F.lit(1)), "_one").drop("_one")
        upto = Window.partitionBy(*keys, "name").orderBy("_digits").rowsBetween(Window.unboundedPreceding, 0)
        met = met.withColumn("_upto", F.sum("_n").over(upto))
        hit = (F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("_n") < F.col("rank"))
        found = met.where(hit).select(*keys, "name", (F.col("rank") - F.col("_upto") + F.col("_n")).alias("rank"), F.col("_digits").alias("_prefix"))
        open_ranks = materialize(found, "ranks")
    return open_ranks.select(*(f"_key.{c}" for c in by), "name", number_of_bits(F.col("_prefix"), kind).alias("value"))


def radix_percentiles(rows: DataFrame, value: str, points: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """What ``disc_percentiles`` gives, of any number: ``n``, the first value whose share of the rows reaches p, and ``max``.

    Keys without any value are left out.
    """
    key = F.struct(*by).alias("_key") if by else F.lit(0).alias("_key")
    known = rows.where(F.col(f"`{value}`").isNotNull()).select(key, F.col(f"`{value}`").alias("_value"))
    totals = known.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.max("_value").alias("max"))
    totals = materialize(totals, "totals")
    named = F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))).alias("rank")) for name, p in points.items()))
    found = radix_select(known, "_value", totals.select("_key", F.inline(named)), ["_key"])
    picked = found.groupBy("_key").agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in points))
    whole = totals.join(picked, "_key")
    return whole.select(*(f"_key.{c}" for c in by), "n", *points, "max")

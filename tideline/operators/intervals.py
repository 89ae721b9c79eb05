"""Days and ranges of days, joined by dyadic pieces.

A range of days is cut into at most two pieces of each size 1, 2, 4, ... that start at a multiple of their size; a day lies in one
piece of each size. Both sides carry a number of rows that grows with the logarithm of a range, whatever its length, and
a range and a day in it meet in exactly one piece, so the join is an equi-join and gives no pair twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pieces of up to 2^16 days, some 179 years; longer ranges have more of the largest.
SIZES = 16


def _day_number(day: Column) -> Column:
    """Days since a date so early that all are positive."""
    return F.datediff(day, F.lit("0001-01-01").cast("date")).cast("long")


def dyadic_pieces(first: Column, last: Column) -> Column:
    """``array<struct<size, piece>>`` that cover the days from ``first`` to ``last``; empty if there are none or one is null."""
    start = F.struct(
        _day_number(first).alias("low"),
        (_day_number(last) + 1).alias("high"),
        F.array().cast("array<struct<size:int,piece:bigint>>").alias("pieces"),
    )

    def step(state: Column, size: Column) -> Column:
        low, high, pieces = state["low"], state["high"], state["pieces"]
        open_, top = low < high, size == SIZES
        odd_low = open_ & (low % 2 == 1) & ~top
        low_after = F.when(odd_low, low + 1).otherwise(low)
        odd_high = open_ & (high % 2 == 1) & (low_after < high) & ~top
        high_after = F.when(odd_high, high - 1).otherwise(high)
        one = F.when(odd_low, F.array(F.struct(size.alias("size"), low.alias("piece"))))
        other = F.when(odd_high, F.array(F.struct(size.alias("size"), high_after.alias("piece"))))
        rest = F.when(top & open_, F.transform(F.sequence(low, high - 1), lambda p: F.struct(size.alias("size"), p.alias("piece"))))
        none = F.array().cast("array<struct<size:int,piece:bigint>>")
        added = F.concat(pieces, F.coalesce(one, none), F.coalesce(other, none), F.coalesce(rest, none))
        half = F.when(top, 1).otherwise(2)
        return F.struct(F.floor(low_after / half).cast("long").alias("low"), F.floor(high_after / half).cast("long").alias("high"), added.alias("pieces"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(SIZES)), start, step, lambda state: state["pieces"])


def day_pieces(day: Column) -> Column:
    """The pieces of every size that hold a day."""
    number = _day_number(day)
    return F.transform(F.sequence(F.lit(0), F.lit(SIZES)), lambda s: F.struct(s.alias("size"), F.floor(number / F.pow(F.lit(2), s)).cast("long").alias("piece")))


def merged_ranges(ranges: DataFrame, by: Sequence[str], first: str = "first_day", last: str = "last_day") -> DataFrame:
    """``(by, first, last)``: ranges that share a day, of the same ``by``, as one; those that hold no day are left out.

    No day lies in two ranges of the same ``by`` then.
    """
    earlier = Window.partitionBy(*by).orderBy(first, last).rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.col(first) > F.max(last).over(earlier), F.lit(True))
    marked = ranges.where(F.col(first) <= F.col(last)).select(*by, first, last).withColumn("_begins", begins.cast("int"))
    runs = marked.withColumn("_run", F.sum("_begins").over(Window.partitionBy(*by).orderBy(first, last).rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "_run").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("_run")


def days_held(ranges: DataFrame, days: DataFrame, key: str, by: Sequence[str] = (), first: str = "first_day", last: str = "last_day", day: str = "day") -> DataFrame:
    """``(by, day, n, low, high)``: how many ranges hold each of the distinct ``days``, and their smallest and largest ``key``.

    Ranges are counted by their ends, then by their dyadic pieces, before they meet the days, so no pair of a range and a
    day is made: what is shuffled grows with the ranges, and what is joined with the days they span.
    """
    measures = [F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")]
    again = [F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")]
    ends = ranges.where(F.col(first) <= F.col(last)).groupBy(*by, first, last).agg(*measures)
    cut = ends.select(*by, "n", "low", "high", F.explode(dyadic_pieces(F.col(first), F.col(last))).alias("_at"))
    pieces = cut.groupBy(*by, F.col("_at.size").alias("size"), F.col("_at.piece").alias("piece")).agg(*again)
    wanted = days.where(F.col(day).isNotNull()).select(F.col(day).alias("_day")).distinct()
    placed = wanted.select("_day", F.explode(day_pieces(F.col("_day"))).alias("_at")).select("_day", "_at.*")
    return pieces.join(placed, ["size", "piece"]).groupBy(*by, F.col("_day").alias(day)).agg(*again)


def days_in_ranges(ranges: DataFrame, days: DataFrame, first: str = "first_day", last: str = "last_day", day: str = "day") -> DataFrame:
    """The rows of ``ranges`` with each of the distinct ``days`` that lies in them, both ends included.

    Ranges with an unknown end or an end before their start hold no day; unknown days are in no range. A range that
    stands twice is returned twice.
    """
    cut = ranges.select("*", F.explode(dyadic_pieces(F.col(first), F.col(last))).alias("_at"))
    wanted = days.where(F.col(day).isNotNull()).select(F.col(day).alias("_day")).distinct()
    placed = wanted.select("_day", F.explode(day_pieces(F.col("_day"))).alias("_at"))
    joined = cut.select(*(F.col(f"`{c}`") for c in ranges.columns), "_at.size", "_at.piece").join(placed.select("_day", "_at.*"), ["size", "piece"])
    return joined.select(*(F.col(f"`{c}`") for c in ranges.columns), F.col("_day").alias(day))

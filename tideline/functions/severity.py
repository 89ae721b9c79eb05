"""Threshold levels, distances and projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed order of levels; the rank is the position.
LEVELS = ("NONE", "LOW", "MEDIUM", "HIGH")


@dataclass(frozen=True)
class Thresholds:
    """A value that reaches a threshold is at that level."""

    low: float
    medium: float
    high: float

    def level(self, value: Column) -> Column:
        return (
            F.when(value >= self.high, "HIGH")
            .when(value >= self.medium, "MEDIUM")
            .when(value >= self.low, "LOW")
            .otherwise("NONE")
        )

    def next_level(self, value: Column) -> Column:
        return F.when(value < self.low, "LOW").when(value < self.medium, "MEDIUM").when(value < self.high, "HIGH")

    def next_threshold(self, value: Column) -> Column:
        return (
            F.when(value < self.low, F.lit(self.low))
            .when(value < self.medium, F.lit(self.medium))
            .when(value < self.high, F.lit(self.high))
        )

    def reached_threshold(self, level: Column) -> Column:
        return F.when(level == "HIGH", self.high).when(level == "MEDIUM", self.medium).otherwise(F.lit(self.low))


def level_rank(level: Column) -> Column:
    return (F.array_position(F.array(*(F.lit(x) for x in LEVELS)), level) - 1).cast("int")


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in LEVELS)), (rank + 1).cast("int"))


def max_level(*levels: Column) -> Column:
    ranks = [level_rank(x) for x in levels]
    return level_name(F.greatest(*ranks) if len(ranks) > 1 else ranks[0])


def health_status(level: Column) -> Column:
    return F.when(level == "NONE", "healthy").when(level == "HIGH", "critical").otherwise("attention")


def days_to_threshold(remaining: Column, per_day: Column) -> Column:
    """Whole days until ``remaining`` more records at this rate: 0 if already there, NULL without growth."""
    return F.when(remaining <= 0, F.lit(0).cast("long")).when(per_day > 0, F.ceil(remaining / per_day).cast("long"))


def round_half_up(value: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(value + F.lit(0.5)).cast("long")


def round_to(value: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def percent_of(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals; NULL for an empty or unknown whole."""
    return F.when(whole > 0, round_half_up(part / whole * F.lit(10000.0)) / F.lit(100.0))


def megabytes(size: Column, digits: int = 2) -> Column:
    return round_to(F.coalesce(size, F.lit(0)) / F.lit(1048576.0), digits)


def near_threshold(value: Column, thresholds: Thresholds, share: float = 0.05) -> Column:
    """Within ``share`` of any threshold, both ends included."""
    near = F.lit(False)
    for t in (thresholds.low, thresholds.medium, thresholds.high):
        near = near | (F.abs(value - F.lit(t)) <= F.lit(t * share))
    return near

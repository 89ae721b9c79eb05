"""Connected components by contraction: every round maps each node to its smallest neighbour and relabels the links.

A round is a grouped minimum and two joins over links; no task ever holds the links of one node together. Rounds are
written to the shared scratch folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links(a, b)`` (longs); nodes share a label if and only if they are connected.

    Loops, repeated links and both directions are allowed; no links give no rows. A label is one of the nodes.
    """
    current = materialize(_tidy(links), "links")
    maps: list[DataFrame] = []
    while not current.isEmpty():
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to"))
        maps.append(materialize(to, "labels"))
        left = maps[-1].select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = maps[-1].select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = current.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        current = materialize(_tidy(moved), "links")
    if not maps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    label = maps[-1].select("node", F.col("to").alias("label"))
    for earlier in reversed(maps[:-1]):
        later = label.withColumnRenamed("node", "to")
        label = earlier.join(later, "to", "left").select("node", F.coalesce("label", "to").alias("label"))
    return label


def _tidy(links: DataFrame) -> DataFrame:
    return (
        links.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )

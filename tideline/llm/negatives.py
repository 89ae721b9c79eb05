"""Hard negatives: rows of another label that score a little below an anchor's positives, found by bounds along a tree.

Anchors are dealt into groups of similar ones, and each group is joined by a minimum spanning tree. A candidate's score with
an anchor differs from that with the anchor's parent by at most the edge's length times the candidate's norm. So a block of
candidates is scored exactly at the root only; going down, bounds on its scores are carried along, and only candidates whose
bounds overlap what is looked for are scored again (exactly, which narrows the bounds of all that follows). Equal anchors
have edges of length 0 and cost nothing more.

What is looked for is a window of scores, and in it only the highest: the scores that the anchors of a group have with one
another say what the best of any block must reach to be among them, so that blocks hand on little. First the window is
open and gives each anchor's positives; then every positive has its own. Groups are files of the shared folder that
every task reads one after the other, while each candidate is read once by one task and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.files import AtomicFile, open_file
from tideline.session import materialize, scratch_path

PIVOTS, GROUP_ROWS, BLOCK_ROWS = 64, 1024, 8192
POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
EXACT = float(1 << 53)
FOUND = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("other_id", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "anchor_id long, positive_id long, positive_score long, other_id long, score long"


def integer_rows(rows: DataFrame, label: Column) -> DataFrame:
    """``id, label, vector`` of the rows that take part: components are floor(256 x) in double precision.

    Rows with a null id, a null ``label``, a null vector, or a null or non-finite component take no part, nor do vectors so
    long that scores would not fit a long (squared length of 2^62 or more). Of rows with one id the one with the smallest
    label and vector takes part.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    squared = F.aggregate(F.transform("embedding", lambda x: F.pow(F.floor(F.lit(256.0) * x.cast("double")).cast("double"), 2.0)), F.lit(0.0), lambda a, x: a + x)
    made = usable.where(squared < float(1 << 62)).select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), scaled.alias("vector"))
    least = made.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return least.select("id", "row.label", "row.vector")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = whole.flatten().to_numpy(zero_copy_only=False)
    return out


class Vectors:
    """Integer vectors, and how to score them exactly: in doubles where no score can reach 2^53."""

    def __init__(self, whole: np.ndarray):
        self.whole, self.real = whole, whole.astype(np.float64)
        self.norms = np.sqrt((self.real**2).sum(axis=1))
        self.longest = float(self.norms.max(initial=0.0))

    def scores(self, other: Vectors, at: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        width = min(self.whole.shape[1], other.whole.shape[1])
        if self.longest * other.norms[at] < EXACT:
            return np.rint(self.real[rows, :width] @ other.real[at, :width]).astype(np.int64)
        return self.whole[rows, :width] @ other.whole[at, :width]


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1: the root) and length of the edge to it, of each point in a minimum spanning tree grown from the first."""
    n = len(points)
    parent, edge = np.full(n, -1), np.zeros(n)
    nearest, length, open_ = np.zeros(n, np.int64), np.full(n, np.inf), np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        open_[at] = False
        apart = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        closer = open_ & (apart < length)
        nearest[closer], length[closer] = at, apart[closer]
        at = int(np.where(open_, length, np.inf).argmin())
        if not np.isfinite(length[at]):
            at = int(open_.argmax())
        parent[at], edge[at] = nearest[at], length[at]
    return parent, edge


def walk(parent: np.ndarray) -> np.ndarray:
    """Points in an order in which parents come first and the largest branch of each last.

    Then a point's bounds can be let go when its last branch is entered, so few are held at a time.
    """
    children: dict[int, list[int]] = {}
    for i, p in enumerate(parent.tolist()):
        children.setdefault(p, []).append(i)
    down, waiting = [], list(children.get(-1, []))
    while waiting:
        node = waiting.pop()
        down.append(node)
        waiting += children.get(node, [])
    size = np.ones(len(parent), np.int64)
    for node in reversed(down):
        if parent[node] >= 0:
            size[parent[node]] += size[node]
    order, waiting = [], list(children.get(-1, []))
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting += sorted(children.get(node, []), key=lambda c: (-size[c], c))
    return np.array(order, np.int64)


@dataclass
class Group:
    """Anchors in the order of their tree, with the windows looked for: lowest and highest score, and what to reach."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: Vectors
    parent: np.ndarray
    edge: np.ndarray
    windows: np.ndarray
    floor: np.ndarray
    names: np.ndarray
    same: bool
    most: int

    @classmethod
    def build(cls, ids, labels, whole: np.ndarray, windows: np.ndarray, names: np.ndarray, same: bool, most: int) -> Group:
        """``windows`` (lowest, highest) and ``names`` (of the positive, its score) are given per anchor and window."""
        first = np.argsort(ids, kind="stable")
        parent, edge = spanning_tree(whole[first].astype(np.float64))
        order = walk(parent)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        chosen = first[order]
        ids, labels, windows, names, vectors = ids[chosen], labels[chosen], windows[chosen], names[chosen], Vectors(whole[chosen])
        above = np.where(parent[order] >= 0, place[parent[order]], -1)
        floor = windows[:, :, 0].copy()
        for at in range(len(ids)):
            scores = vectors.scores(vectors, at)[((labels == labels[at]) == same) & (ids != ids[at])]
            for w, (low, high) in enumerate(windows[at]):
                inside = scores[(scores >= low) & (scores <= high)]
                if len(inside) >= most:
                    floor[at, w] = np.partition(inside, len(inside) - most)[len(inside) - most]
        return cls(ids, labels, vectors, above, edge[order], windows, floor, names, same, most)

    def save(self, path: str) -> None:
        held = BytesIO()
        np.savez(held, ids=self.ids, labels=self.labels, vectors=self.vectors.whole, parent=self.parent, edge=self.edge,
                 windows=self.windows, floor=self.floor, names=self.names, rule=np.array([self.same, self.most]))
        file = AtomicFile(path)
        file.write(held.getvalue())
        file.close()

    @classmethod
    def load(cls, path: str) -> Group:
        with open_file(path) as stream, np.load(BytesIO(stream.read())) as x:
            return cls(x["ids"], x["labels"], Vectors(x["vectors"]), x["parent"], x["edge"], x["windows"], x["floor"], x["names"], bool(x["rule"][0]), int(x["rule"][1]))

    def search(self, ids: np.ndarray, labels: np.ndarray, block: Vectors) -> tuple[list[tuple[np.ndarray, ...]], int]:
        """Columns of ``FOUND`` for the best of a block in every window, and how many scores were computed."""
        out, scored = [], 0
        last = {int(p): k for k, p in enumerate(self.parent)}
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(len(self.ids)):
            allowed = ((labels == self.labels[k]) == self.same) & (ids != self.ids[k])
            p = int(self.parent[k])
            if p < 0:
                exact = block.scores(self.vectors, k)
                lower = upper = exact.astype(np.float64)
                rows = np.flatnonzero(allowed)
                exact = exact[rows]
                scored += len(ids)
            else:
                low, high = held[p]
                slack = self.edge[k] * block.norms * (1 + 1e-9) + 1e-9 * np.abs(high) + 1e-6
                lower, upper = low - slack, high + slack
                open_ = np.zeros(len(ids), bool)
                for w in range(self.floor.shape[1]):
                    open_ |= (upper >= self.floor[k, w]) & (lower <= self.windows[k, w, 1])
                rows = np.flatnonzero(open_ & allowed)
                exact = block.scores(self.vectors, k, rows)
                lower[rows] = upper[rows] = exact
                scored += len(rows)
                if last[p] == k:
                    del held[p]
            if k in last:
                held[k] = (lower, upper)
            for w in range(self.floor.shape[1]):
                inside = np.flatnonzero((exact >= self.floor[k, w]) & (exact <= self.windows[k, w, 1]))
                if not len(inside):
                    continue
                if len(inside) > 4 * self.most:
                    worst = np.partition(exact[inside], len(inside) - self.most)[len(inside) - self.most]
                    inside = inside[exact[inside] >= worst]
                best = inside[np.lexsort((ids[rows[inside]], -exact[inside]))][: self.most]
                name, score = self.names[k, w]
                n = len(best)
                out.append((np.full(n, self.ids[k]), np.full(n, name), np.full(n, score), ids[rows[best]], exact[best]))
        return out, scored


def anchor_groups(anchors: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``anchors(id, label, vector)`` with a ``group``: of about ``group_rows`` anchors nearest to the same of ``PIVOTS`` pivots."""
    drawn = anchors.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(PIVOTS).select("vector").toArrow()
    pivots = matrix(drawn.column("vector")).astype(np.float64) if drawn.num_rows else np.zeros((1, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(2)).astype(np.float64)
            width = min(points.shape[1], pivots.shape[1])
            near = (points[:, :width] @ pivots[:, :width].T - (pivots**2).sum(axis=1) / 2).argmax(axis=1) if len(points) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], names=["id", "label", "vector", "pivot"])

    near = materialize(anchors.select("id", "label", "vector").mapInArrow(assign, "id long, label long, vector array<long>, pivot long"), "anchors")
    parts = near.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("long").alias("parts"))
    dealt = near.join(F.broadcast(parts), "pivot")  # at most one row per pivot
    return dealt.select("id", "label", "vector", F.xxhash64("pivot", F.pmod(F.xxhash64("id", F.lit(5)), "parts")).alias("group"))


def write_groups(grouped: DataFrame, folder: str, same: bool, most: int) -> list[str]:
    """Files of all groups of ``grouped(id, label, vector, group, windows)``; an anchor without windows looks for nothing.

    ``windows`` lists ``low, high, positive_id, positive_score``.
    """

    def build(rows: pa.Table) -> pa.Table:
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        listed = rows.column("windows").to_pylist()
        count = max(map(len, listed))
        windows, names = np.full((len(ids), count, 2), [HIGHEST, LOWEST]), np.zeros((len(ids), count, 2), np.int64)
        for i, own in enumerate(listed):
            for w, x in enumerate(own):
                windows[i, w], names[i, w] = (x["low"], x["high"]), (x["positive_id"], x["positive_score"])
        path = f"{folder}/group-{rows.column('group')[0].as_py() & 0xFFFFFFFFFFFFFFFF:016x}.npz"
        Group.build(ids, labels, matrix(rows.column("vector")), windows, names, same, most).save(path)
        return pa.table({"path": [path]})

    chosen = grouped.select("id", "label", "vector", "group", "windows")
    return sorted(r.path for r in chosen.groupBy("group").applyInArrow(build, "path string").collect())


def search_groups(rows: DataFrame, paths: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Best candidates of every block of ``rows(id, label, vector)`` for the anchors in ``paths``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            ids, labels = table.column(0).to_numpy(), table.column(1).to_numpy()
            block = Vectors(matrix(table.column(2)))
            for path in paths:
                out, _ = Group.load(path).search(ids, labels, block)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], schema=FOUND)

        held, count = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, block_rows):
                held.append(whole.slice(at, block_rows))
                count += held[-1].num_rows
                if count >= block_rows:
                    yield from found(held)
                    held, count = [], 0
        if held:
            yield from found(held)

    return rows.select("id", "label", "vector").mapInArrow(run, FOUND_SQL)


def hard_negatives(rows: DataFrame, anchors: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = 50, high: int = 95, group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows of ``rows(vec_id, embedding, ...)`` that ``anchors`` (over ``id``) holds for. An anchor's positives
    are the ``positives`` other rows of its label with the highest inner products, its negatives for each of them the
    ``negatives`` highest of other labels from ``low`` to ``high`` percent of the positive's score; ties go to the smaller id.
    A positive without such rows is not returned. ``integer_rows`` says which rows take part; a vector of fewer components
    than another counts as ending in zeros. No anchors or no rows give no rows.
    """
    spark = rows.sparkSession
    known = materialize(integer_rows(rows, label), "vectors")
    grouped = materialize(anchor_groups(known.where(anchors), group_rows), "groups")
    anything = F.array(F.struct(F.lit(int(LOWEST)).alias("low"), F.lit(int(HIGHEST)).alias("high"), F.lit(0).cast("long").alias("positive_id"), F.lit(0).cast("long").alias("positive_score")))
    paths = write_groups(grouped.withColumn("windows", anything), scratch_path(spark, "positives"), True, positives)
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "other_id")
    best = search_groups(known, paths, block_rows).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    score = F.col("score")

    def percent(of: int) -> Column:
        """The whole part of so many percent of the score, without leaving the long."""
        whole = F.expr("score div 100") - F.when((score < 0) & (score % 100 != 0), 1).otherwise(0)
        return whole * of + F.floor((score - whole * 100) * of / 100)

    lowest = percent(low) + F.when(F.pmod(score, F.lit(100)) * low % 100 != 0, 1).otherwise(0)
    window = F.struct(lowest.cast("long").alias("low"), percent(high).cast("long").alias("high"), F.col("other_id").alias("positive_id"), score.alias("positive_score"))
    wanted = best.select(F.col("anchor_id").alias("id"), window.alias("window")).where("window.low <= window.high")
    windows = wanted.groupBy("id").agg(F.collect_list("window").alias("windows"))  # at most ``positives`` each
    paths = write_groups(grouped.join(windows, "id"), scratch_path(spark, "negatives"), False, negatives)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "other_id")
    found = search_groups(known, paths, block_rows).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

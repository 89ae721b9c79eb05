"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and every vector is dealt to a leaf. A query keeps a priority queue of nodes by the
cosine to their centres, opens the best, and visits leaves until their calibrated number: the sample's own searches are
widened until the wanted recall is reached. Visited leaves are joined with their vectors, compared in blocks, and scored
exactly on the original vectors in double precision.

Equal vectors are searched for, and as, one: of each distinct vector only the ``k + 1`` smallest ids can be among anyone's
``k`` nearest. Neighbouring leaves share a group of about ``GROUP_ROWS`` rows, which keeps the ``k + 1`` nearest of each query
that visits any of them; larger leaves are dealt into several groups, each of which meets all of the leaf's queries. A group
is a file of the shared folder; its queries are dealt into blocks of tasks that read it and take 512 of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.files import AtomicFile, open_file
from tideline.session import materialize, scratch_path

SAMPLE_ROWS, LEAF_ROWS, GROUP_ROWS, QUERY_ROWS = 20_000, 512, 8192, 16_384
BRANCHES, ROUNDS = 8, 8
PROBES, RECALL = 400, 0.98


def usable(embedding: Column) -> Column:
    """Neither null nor zero, and all components known and finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Tree:
    """Centres of all nodes; the children of node ``i`` are ``first[i]`` up to ``first[i] + count[i]``, none in a leaf."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    visits: int

    def assign(self, units: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down to the child with the nearest centre."""
        node = np.zeros(len(units), np.int64)
        while True:
            open_ = np.flatnonzero(self.count[node] > 0)
            if not len(open_):
                return node
            for at in np.unique(node[open_]):
                rows = open_[node[open_] == at]
                children = slice(self.first[at], self.first[at] + self.count[at])
                node[rows] = self.first[at] + (units[rows] @ self.centres[children].T).argmax(axis=1)

    def search(self, units: np.ndarray, visits: int) -> list[list[int]]:
        """The leaves each query visits, best bin first."""
        near = units @ self.centres.T
        found = []
        for row in near:
            queue, leaves = [(0.0, 0)], []
            while queue and len(leaves) < visits:
                _, node = heappop(queue)
                if not self.count[node]:
                    leaves.append(node)
                    continue
                for child in range(self.first[node], self.first[node] + self.count[node]):
                    heappush(queue, (-row[child], child))
            found.append(leaves)
        return found


def _split(units: np.ndarray, branches: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; a centre without vectors stays where it is."""
    centres = units[rng.choice(len(units), branches, replace=False)]
    for _ in range(ROUNDS):
        own = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        length = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def grow(units: np.ndarray, leaf_rows: float, branches: int = BRANCHES, seed: int = 5) -> Tree:
    """Splits nodes of over ``leaf_rows`` sample vectors."""
    rng = np.random.default_rng(seed)
    centres, first, count = [np.zeros(units.shape[1])], [0], [0]
    waiting = [(0, np.arange(len(units)))]
    while waiting:
        node, rows = waiting.pop()
        if len(rows) <= max(leaf_rows, branches):
            continue
        made = _split(units[rows], branches, rng)
        own = (units[rows] @ made.T).argmax(axis=1)
        used = np.unique(own)
        if len(used) < 2:
            continue
        first[node], count[node] = len(centres), len(used)
        for child in used:
            waiting.append((len(centres), rows[own == child]))
            centres.append(made[child])
            first.append(0)
            count.append(0)
    return Tree(np.array(centres), np.array(first), np.array(count), 1)


def calibrate(tree: Tree, units: np.ndarray, k: int, recall: float, probes: int = PROBES) -> Tree:
    """Widens the visits until the sample's own searches find ``recall`` of their ``k`` nearest."""
    asked = units[:: max(1, len(units) // probes)][:probes]
    scores = asked @ units.T
    scores[np.arange(len(asked)), np.arange(0, len(units), max(1, len(units) // probes))[: len(asked)]] = -np.inf
    wanted = min(k, len(units) - 1)
    leaves, leaf_of = int((tree.count == 0).sum()), tree.assign(units)
    if wanted < 1 or leaves == 1:
        return Tree(tree.centres, tree.first, tree.count, leaves)
    nearest = leaf_of[np.argpartition(-scores, wanted - 1, axis=1)[:, :wanted]]
    order = tree.search(asked, leaves)
    place = [{leaf: i for i, leaf in enumerate(own)} for own in order]
    depth = np.array([[at[x] for x in row] for at, row in zip(place, nearest)])
    visits = 1
    while visits < leaves and (depth < visits).mean() < recall:
        visits += 1
    return Tree(tree.centres, tree.first, tree.count, visits)


def fit(vectors: DataFrame, k: int, rows: int, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, recall: float = RECALL) -> Tree:
    """A tree for ``rows`` vectors from the ``sample_rows`` of ``vectors(vec_id, embedding)`` with the smallest digests."""
    drawn = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample_rows)
    sample = drawn.toArrow().column("embedding").combine_chunks()
    units = unit(sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1))
    in_sample = max(8.0, leaf_rows * len(units) / max(1, rows))
    return calibrate(grow(units, in_sample), units, k, recall)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def deal_leaves(tree: Tree, sizes: dict[int, int], group_rows: int) -> tuple[dict[int, int], dict[int, int]]:
    """First group and number of groups of every leaf that has rows.

    Neighbouring leaves share a group of about ``group_rows`` rows; a larger leaf has several groups to itself.
    """
    first, parts, waiting, group, held = {}, {}, [0], 0, 0
    while waiting:
        node = waiting.pop()
        waiting += range(tree.first[node] + tree.count[node] - 1, tree.first[node] - 1, -1) if tree.count[node] else []
        size = sizes.get(node, 0)
        if not size:
            continue
        if held and held + size > group_rows:
            group, held = group + 1, 0
        first[node], parts[node] = group, -(-size // group_rows)
        if parts[node] > 1:
            group, held = group + parts[node], 0
        else:
            held += size
    return first, parts


def _nearest_in_leaves(ids, mine, leaf_of, norms, names, theirs, query_of, leaves, most) -> tuple[np.ndarray, ...]:
    """The ``most`` nearest of each query among the vectors of its leaves; vectors come sorted by leaf.

    Blocks find candidates; their scores are then computed pair by pair, so equal vectors score equally.
    """
    own_norms = np.sqrt((theirs**2).sum(axis=1))
    rows, cols = [], []
    for leaf in np.unique(leaves):
        low, high = np.searchsorted(leaf_of, [leaf, leaf + 1])
        if low == high:
            continue
        asking = query_of[leaves == leaf]
        rough = (theirs[asking] @ mine[low:high].T) / norms[low:high] / own_norms[asking, None]
        keep = min(high - low, most)
        floor = np.partition(rough, high - low - keep, axis=1)[:, high - low - keep] - 1e-9
        row, col = np.nonzero(rough >= floor[:, None])
        rows.append(asking[row])
        cols.append(col + low)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, col = np.concatenate(rows), np.concatenate(cols)
    exact = (theirs[row] * mine[col]).sum(axis=1) / (own_norms[row] * norms[col])
    order = np.lexsort((ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < most
    return names[row[kept]], ids[col[kept]], exact[kept]


def nearest(vectors: DataFrame, queries: Column, k: int = 5, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS,
            group_rows: int = GROUP_ROWS, recall: float = RECALL, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors(vec_id, embedding)`` that ``queries`` holds for, its
    ``k`` nearest other rows found, ties to the smaller id.

    Unusable vectors, null ids, and vectors of another length than most take no part. Rows with equal ids are one vector
    each; a query leaves out all rows with its own id.
    """
    spark = vectors.sparkSession
    own = vectors.select("vec_id", "embedding", queries.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    widths = own.groupBy(F.size("embedding").alias("width")).count().orderBy(F.col("count").desc(), "width").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if widths is None:
        return empty
    width = widths.width
    own = own.where(F.size("embedding") == width).select("vec_id", "embedding", "asks", F.xxhash64("embedding").alias("digest"))
    same = Window.partitionBy("digest", "embedding").orderBy("vec_id")
    distinct_ids = own.select("vec_id", "embedding", "digest").distinct()
    indexed = distinct_ids.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("vec_id", "embedding", "digest")
    indexed = materialize(indexed, "vectors")
    asked = own.where("asks").select("vec_id", "embedding", "digest").distinct()
    classes = materialize(asked.groupBy("digest", "embedding").agg(F.min("vec_id").alias("class")), "queries")
    tree = spark.sparkContext.broadcast(fit(indexed, k, indexed.count(), sample_rows, leaf_rows, recall))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = tree.value.assign(unit(_matrix(batch.column(1), width)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaves)], names=["vec_id", "embedding", "leaf"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    dealt = materialize(indexed.select("vec_id", "embedding").mapInArrow(assign, f"vec_id long, embedding {kind}, leaf long"), "leaves")
    sizes = {r.leaf: r["count"] for r in dealt.groupBy("leaf").count().collect()}
    first, parts = deal_leaves(tree.value, sizes, group_rows)

    def of(values: dict[int, int]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("leaf")]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows, groups, leaves = [], [], []
                for row, found in enumerate(tree.value.search(unit(_matrix(batch.column(1), width)), tree.value.visits)):
                    by_group: dict[int, list[int]] = {}
                    for leaf in found:
                        for group in range(first.get(leaf, 0), first.get(leaf, 0) + parts.get(leaf, 0)):
                            by_group.setdefault(group, []).append(leaf)
                    rows += [row] * len(by_group)
                    groups += by_group.keys()
                    leaves += by_group.values()
                taken = [batch.column(i).take(pa.array(rows, pa.int64())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*taken, pa.array(groups, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))], names=["class", "asked", "group", "leaves"]
                )

    if not sizes:
        return empty
    dealt = dealt.withColumn("group", of(first) + F.pmod(F.xxhash64("vec_id", F.lit(9)), of(parts)))
    visits = classes.select("class", "embedding").mapInArrow(visit, f"class long, asked {kind}, group long, leaves array<long>")

    folder = scratch_path(spark, "leaf-groups")

    def store(rows: pa.Table) -> pa.Table:
        """A group's vectors in order of leaves, as a file that any task may read."""
        leaf = rows.column("leaf").to_numpy()
        order = np.argsort(leaf, kind="stable")
        held = BytesIO()
        np.savez(held, ids=rows.column("vec_id").to_numpy()[order], vectors=_matrix(rows.column("embedding"), width)[order], leaf=leaf[order])
        file = AtomicFile(f"{folder}/group-{rows.column('group')[0].as_py():08d}.npz")
        file.write(held.getvalue())
        file.close()
        return pa.table({"group": rows.column("group").slice(0, 1)})

    stored = materialize(dealt.select("vec_id", "embedding", "leaf", "group").groupBy("group").applyInArrow(store, "group long"), "groups")
    groups, asking, tasks = stored.count(), classes.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The queries of a group are dealt into blocks, each a task's; a block reads its group's file.
    blocks = max(1, -(-asking // query_rows), -(-2 * tasks // groups))
    visits = visits.withColumn("block", F.pmod(F.xxhash64("class", F.lit(4)), F.lit(blocks)))
    lined = visits.repartition(max(tasks, min(groups * blocks, -(-asking * groups // query_rows))), "group", "block").sortWithinPartitions("group", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = None, None
        for whole in batches:
            own = whole.column(2).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for start, end in zip(edges, edges[1:]):
                for at in range(start, end, 512):
                    block = whole.slice(at, min(512, end - at))
                    if held is None or group != own[at]:
                        group = int(own[at])
                        with open_file(f"{folder}/group-{group:08d}.npz") as stream, np.load(BytesIO(stream.read())) as x:
                            held = x["ids"], x["vectors"], x["leaf"]
                        norms = np.sqrt((held[1] ** 2).sum(axis=1))
                    names, theirs = block.column(0).to_numpy(), _matrix(block.column(1), width)
                    asked_leaves = block.column(3)
                    query_of = np.repeat(np.arange(len(names)), asked_leaves.value_lengths().to_numpy(zero_copy_only=False))
                    leaves = asked_leaves.flatten().to_numpy(zero_copy_only=False)
                    found = _nearest_in_leaves(held[0], held[1], held[2], norms, names, theirs, query_of, leaves, k + 1)
                    kinds = (pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, kinds)], names=["class", "vec_id", "score"])

    met = lined.select("class", "asked", "group", "leaves").mapInArrow(compare, "class long, vec_id long, score double")
    best = Window.partitionBy("class").orderBy(F.col("score").desc(), "vec_id")
    top = met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    named = asked.join(classes, ["digest", "embedding"]).select(F.col("vec_id").alias("query_id"), "class")
    others = named.join(top, "class").where(F.col("query_id") != F.col("vec_id"))
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = others.select("query_id", F.row_number().over(final).cast("int").alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)

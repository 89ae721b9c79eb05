"""Operators over foreign-key edges: ``(by, name, child, child_columns, parent, parent_columns, on_delete)``.

They serve many applications at once: ``by`` names the columns that tell their graphs apart. Every round is
written out, so neither the plan nor the lineage grows with the number of rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.session import dealt, materialize, scratch_path

#: Graphs of up to so many edges are followed whole by the task that holds them, larger ones are dealt out by their tables too.
SMALL = 256
#: Rounds in which small graphs lose their dead ends, for each copy that is written.
TRIMMED = 4


class Rounds:
    """Rows of all rounds in one folder, so that reading them is one scan however many rounds there were."""

    def __init__(self, first: DataFrame, label: str):
        self.spark, self.schema, self.path, self.count = first.sparkSession, first.schema, scratch_path(first.sparkSession, label), 0
        self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        """Writes the next round's rows; returns them as written."""
        place = f"{self.path}/round_no={self.count}"
        rows.write.mode("errorifexists").parquet(place)
        self.count += 1
        return self.spark.read.schema(self.schema).parquet(place)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


def _by_size(edges: DataFrame, keys: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """Edges of the graphs of at most ``SMALL`` edges, and those of the larger ones; none where there are none."""
    if not keys:
        return None, edges
    own = dealt(edges.select(*keys), *keys, rows=edges.count())
    large = materialize(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SMALL).select(*keys), "large")
    if large.isEmpty():
        return edges, None
    same = [edges[k].eqNullSafe(large[k]) for k in keys]
    return edges.join(large, same, "left_anti"), edges.join(large, same, "left_semi")


def transitive_closure(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, node, ancestor)`` for every path from child to parent.

    Paths double in length each round, so the rounds grow with the logarithm of the longest path. Small graphs are dealt
    out whole, once a round; paths of larger ones meet by the table between.
    """
    keys = list(by)
    edges = edges.select(*keys, "child", "parent")
    small, large = _by_size(edges if not keys else materialize(edges, "edges"), keys)
    found = [_closed(part, keys, whole) for part, whole in ((small, True), (large, False)) if part is not None]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _closed(edges: DataFrame, keys: list[str], whole: bool) -> DataFrame:
    paths = edges.select(*keys, F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    paths = materialize((dealt(paths, *keys, rows=paths.count()) if whole else paths).distinct(), "paths")
    size = paths.count()
    while True:
        held = dealt(paths, *keys, rows=size) if whole else paths
        onward = held.select(*keys, F.col("node").alias("_via"), F.col("ancestor").alias("_far"))
        joined = held.withColumnRenamed("ancestor", "_via").join(onward, [*keys, "_via"])
        longer = joined.select(*keys, "node", F.col("_far").alias("ancestor"))
        if whole:
            # What is new, without a shuffle: both sides are dealt out by graph.
            new = longer.distinct().join(held, [*keys, "node", "ancestor"], "left_anti")
            new = materialize(new, "paths")
            if new.isEmpty():
                return paths
            paths = materialize(paths.unionByName(new), "paths")
            size = paths.count()
            continue
        paths = materialize(paths.unionByName(longer).distinct(), "paths")
        grown = paths.count()
        if grown == size:
            return paths
        size = grown


def _facts(tables: DataFrame, edges: DataFrame, keys: list[str], roots: DataFrame | None = None) -> DataFrame:
    """``(by, kind, first, second)``: edges, tables and roots as rows of one table, written once."""
    found = edges.select(*keys, F.lit("edge").alias("kind"), F.col("child").alias("first"), F.col("parent").alias("second"))
    listed = [("table", tables, "table_name")] + ([("root", roots, "root")] if roots is not None else [])
    for kind, rows, name in listed:
        found = found.unionByName(rows.select(*keys, F.lit(kind).alias("kind"), F.col(name).alias("first")), allowMissingColumns=True)
    return materialize(found, "facts")


def _taken_apart(facts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables, edges and roots again."""

    def of(kind: str) -> DataFrame:
        return facts.where(F.col("kind") == kind)

    edges = of("edge").select(*keys, F.col("first").alias("child"), F.col("second").alias("parent"))
    return of("table").select(*keys, F.col("first").alias("table_name")), edges, of("root").select(*keys, F.col("first").alias("root"))


def _held_whole(facts: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``(by, tables, edges, roots)``: one row per small graph, its edges those between its tables.

    Graphs without known keys have neither edges nor roots, as keys are joined by equality.
    """
    def of(kind: str, value: Column) -> Column:
        return F.collect_list(F.when(F.col("kind") == kind, value))

    edge = F.struct(F.col("first").alias("child"), F.col("second").alias("parent"))
    named = F.struct(F.col("first").alias("table_name"))
    whole = dealt(facts, *keys, rows=rows).groupBy(*keys).agg(
        of("table", named).alias("tables"), of("edge", edge).alias("edges"), of("root", F.col("first")).alias("roots")
    )
    names = F.transform("tables", lambda t: t["table_name"])
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    inside = F.filter("edges", lambda e: known & F.array_contains(names, e["child"]) & F.array_contains(names, e["parent"]))
    return whole.withColumns({"edges": inside, "roots": F.filter("roots", lambda _: known)})


def reachability(tables: DataFrame, roots: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, table_name, reachable)``: is there a path of single-column keys from the table to its root?

    Only edges between the given tables count. ``roots`` is ``(by, root)``, one row per graph. Each round
    adds the tables that reference what the last one found. Small graphs are followed whole, one row each.
    """
    keys = list(by)
    facts = _facts(tables, edges.where(F.size("child_columns") == 1), keys, roots)
    rows = facts.count()
    small, large = _by_size(facts, keys)
    found = [_reached_whole(small, keys, rows)] if small is not None else []
    if large is not None:
        found.append(_reached(*_taken_apart(large, keys), keys, rows))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _reached_whole(facts: DataFrame, keys: list[str], rows: int) -> DataFrame:
    def onward(state: Column, _: Column) -> Column:
        met = F.filter("edges", lambda e: F.array_contains(state["newest"], e["parent"]))
        new = F.array_except(F.transform(met, lambda e: e["child"]), state["reached"])
        more = F.struct(F.concat(state["reached"], new).alias("reached"), new.alias("newest"))
        return F.when(F.size(state["newest"]) == 0, state).otherwise(more)

    # A round that finds a table has an edge of its own, so there are no more rounds than edges.
    first = F.struct(F.array_distinct("roots").alias("reached"), F.array_distinct("roots").alias("newest"))
    reached = F.aggregate("edges", first, onward)["reached"]
    marked = _held_whole(facts, keys, rows).select(*keys, "tables", reached.alias("_reached"))
    marked = marked.select(*keys, "_reached", F.inline("tables"))
    return marked.select(*keys, "table_name", F.coalesce(F.array_contains("_reached", F.col("table_name")), F.lit(False)).alias("reachable"))


def _reached(tables: DataFrame, edges: DataFrame, roots: DataFrame, keys: list[str], rows: int) -> DataFrame:
    named, ends = [*keys, "table_name"], [*keys, "parent"]
    inside = materialize(edges_between(edges, tables, keys, rows).distinct(), "edges")
    found = Rounds(roots.select(*keys, F.col("root").alias("table_name")).distinct(), "reached")
    newest = found.all()
    while not newest.isEmpty():
        step = dealt(inside, *ends, rows=rows).join(dealt(newest.withColumnRenamed("table_name", "parent"), *ends, rows=rows), ends, "left_semi")
        step = dealt(step.select(*keys, F.col("child").alias("table_name")), *named, rows=rows).distinct()
        newest = found.add(step.join(dealt(found.all(), *named, rows=rows), named, "left_anti"))
    marked = dealt(tables, *named, rows=rows).join(dealt(found.all(), *named, rows=rows).withColumn("_hit", F.lit(True)), named, "left")
    return marked.select(*keys, "table_name", F.coalesce("_hit", F.lit(False)).alias("reachable"))


def edges_between(edges: DataFrame, tables: DataFrame, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Edges whose two ends are both among the tables; ``rows`` is about how many there are of both, where that is known."""
    keys = list(by)
    for end in ("child", "parent"):
        ends = tables.select(*keys, F.col("table_name").alias(end))
        if rows is not None:
            edges, ends = dealt(edges, *keys, end, rows=rows), dealt(ends, *keys, end, rows=rows)
        edges = edges.join(ends.distinct(), [*keys, end], "left_semi")
    return edges


def _cyclic_core(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Edges left after taking away, again and again, those that lead to or come from a dead end."""
    keys = list(by)
    edges = edges.select(*keys, "child", "parent")
    small, large = _by_size(edges, keys)
    found = [_trimmed_whole(small, keys)] if small is not None else []
    if large is not None:
        found.append(_trimmed(large, keys))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _trimmed_whole(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The core of small graphs: each is held by one task, which trims it by the sets of its children and parents.

    Graphs without known keys hold no paths, as keys are joined by equality.
    """
    own = Window.partitionBy(*keys)
    core, size = edges.dropna(subset=[*keys, "child", "parent"]), None
    while True:
        core = dealt(core, *keys, rows=core.count() if size is None else size)
        if size is None:
            core = core.distinct()
        for _ in range(TRIMMED):
            core = core.withColumns({"_from": F.collect_set("child").over(own), "_to": F.collect_set("parent").over(own)})
            core = core.where(F.array_contains("_from", F.col("parent")) & F.array_contains("_to", F.col("child"))).drop("_from", "_to")
        core = materialize(core, "core")
        left = core.count()
        if not left or left == size:
            return core
        size = left


def _trimmed(edges: DataFrame, keys: list[str]) -> DataFrame:
    core = materialize(edges.distinct(), "core")
    size = core.count()
    while size:
        leads_on = core.select(*keys, F.col("child").alias("parent")).distinct()
        led_to = core.select(*keys, F.col("parent").alias("child")).distinct()
        kept = core.join(leads_on, [*keys, "parent"], "left_semi").join(led_to, [*keys, "child"], "left_semi")
        core = materialize(kept, "core")
        left = core.count()
        if left == size:
            break
        size = left
    return core


def fk_cycles(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, component, table_name)``: tables on a cycle, named by the first table of their component.

    Paths are only followed inside the part of each graph that can hold a cycle at all.
    """
    keys = list(by)
    paths = transitive_closure(_cyclic_core(edges, by), by)
    back = paths.select(*keys, F.col("ancestor").alias("node"), F.col("node").alias("ancestor"))
    mutual = paths.join(back, [*keys, "node", "ancestor"], "left_semi")
    return mutual.groupBy(*keys, F.col("node").alias("table_name")).agg(F.min("ancestor").alias("component"))


def removal_order(tables: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, table_name, round)``: children in earlier rounds than their parents, for graphs without cycles.

    Each round takes the tables no remaining table references. Graphs with tables left over at the end have
    a cycle and get no order; a table that references itself does not count as one. Small graphs are followed whole, one
    row each. Tables without a name or a known graph have no edges and are taken in the first round.
    """
    keys = list(by)
    facts = _facts(tables, edges.where("child <> parent"), keys)
    rows = facts.count()
    small, large = _by_size(facts, keys)
    found = [_ordered_whole(small, keys, rows)] if small is not None else []
    if large is not None:
        found.append(_ordered(*_taken_apart(large, keys)[:2], keys, rows))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _ordered_whole(facts: DataFrame, keys: list[str], rows: int) -> DataFrame:
    held = _held_whole(facts, keys, rows).withColumn("tables", F.array_distinct("tables"))
    names = F.transform("tables", lambda t: t["table_name"])

    def onward(state: Column, _: Column) -> Column:
        ready = F.array_except(state["left"], F.transform(state["waiting"], lambda e: e["parent"]))
        taken = F.transform(ready, lambda t: F.struct(t.alias("table_name"), state["round"].alias("round")))
        return F.when(F.size(state["left"]) == 0, state).otherwise(
            F.struct(
                F.array_except(state["left"], ready).alias("left"),
                F.filter(state["waiting"], lambda e: ~F.coalesce(F.array_contains(ready, e["child"]), F.lit(False))).alias("waiting"),
                (state["round"] + 1).alias("round"),
                F.concat(state["taken"], taken).alias("taken"),
            )
        )

    none = F.filter(F.transform(names, lambda t: F.struct(t.alias("table_name"), F.lit(0).alias("round"))), lambda _: F.lit(False))
    first = F.struct(names.alias("left"), F.col("edges").alias("waiting"), F.lit(0).alias("round"), none.alias("taken"))
    # A round that does not take a table is the last, so there are no more rounds than tables.
    ended = held.select(*keys, F.aggregate("tables", first, onward).alias("_end"))
    return ended.where(F.size("_end.left") == 0).select(*keys, F.inline("_end.taken"))


def _ordered(tables: DataFrame, edges: DataFrame, keys: list[str], rows: int) -> DataFrame:
    named = [*keys, "table_name"]
    waiting = materialize(edges_between(edges, tables, keys, rows).distinct(), "waiting")
    left = materialize(dealt(tables, *named, rows=rows).distinct(), "left")
    levels = None
    while True:
        blocked = dealt(waiting.select(*keys, F.col("parent").alias("table_name")), *named, rows=rows).distinct()
        ready = dealt(left, *named, rows=rows).join(blocked, named, "left_anti").withColumn("round", F.lit(levels.count if levels else 0))
        if levels is None:
            levels = Rounds(ready, "levels")
            ready = levels.all()
            # Nulls are equal to nothing, so these would never be found among those that were ready.
            left = left.dropna(subset=named)
        else:
            ready = levels.add(ready)
        if ready.isEmpty():
            break
        ready = dealt(ready.drop("round"), *named, rows=rows)
        left = materialize(dealt(left, *named, rows=rows).join(ready, named, "left_anti"), "left")
        done = ready.withColumnRenamed("table_name", "child")
        waiting = materialize(dealt(waiting, *keys, "child", rows=rows).join(done, [*keys, "child"], "left_anti"), "waiting")
    return levels.all().join(left.select(*keys).distinct(), keys, "left_anti")


def selection_issues(edges: DataFrame, selected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges that cross the border of a selection: ``(by, name, child, parent, kind, severity)``."""
    keys = list(by)
    marked = edges
    for end in ("child", "parent"):
        ends = selected.select(*keys, F.col("table_name").alias(end)).distinct().withColumn(f"_{end}", F.lit(True))
        marked = marked.join(ends, [*keys, end], "left")
    parent_in = F.coalesce("_parent", F.lit(False))
    child_in = F.coalesce("_child", F.lit(False))
    kind = (
        F.when(parent_in & ~child_in & (F.col("on_delete") == "CASCADE"), "unselected_child_cascade")
        .when(parent_in & ~child_in & F.col("on_delete").isin("SET NULL", "SET DEFAULT"), "unselected_child_set_null")
        .when(parent_in & ~child_in, "unselected_child_blocks")
        .when(child_in & ~parent_in, "child_without_parent")
    )
    severity = F.when(F.col("kind") == "child_without_parent", "warning").otherwise("blocking")
    return (
        marked.withColumn("kind", kind)
        .where("kind IS NOT NULL")
        .select(*keys, "name", "child", "parent", "on_delete", "kind", severity.alias("severity"))
    )


def check_edge_data(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Does the data support a foreign key? Orphans, undefined keys and repeated parent keys.

    Both sides shrink to one row per key before they meet.
    """
    a = child.groupBy(F.col(child_key).alias("_key")).agg(F.count(F.lit(1)).alias("_c"))
    b = parent.groupBy(F.col(parent_key).alias("_key")).agg(F.count(F.lit(1)).alias("_p"))
    both = a.join(b, "_key", "full_outer")
    return both.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("child_rows"),
        F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("_c"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.when(F.col("_key").isNotNull() & F.col("_p").isNull(), F.col("_c"))), F.lit(0)).alias(
            "orphans"
        ),
        F.count_if(F.col("_p") > 1).alias("repeated_parent_keys"),
    )

"""Graph operators against brute force over random foreign keys."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import graph

SCHEMA = "app string, name string, child string, child_columns array<string>, parent string, parent_columns array<string>, on_delete string"


def frame(spark, edges):
    rows = [(a, f"{c}_{p}", c, ["x"], p, ["id"], "NO ACTION") for a, c, p in edges]
    return spark.createDataFrame(rows, SCHEMA)


def tables_of(spark, edges):
    found = sorted({(a, t) for a, c, p in edges for t in (c, p)})
    return spark.createDataFrame(found, "app string, table_name string")


def walk(edges, app):
    reach = {(c, p) for a, c, p in edges if a == app}
    while True:
        more = {(x, w) for x, y in reach for z, w in reach if y == z} | reach
        if more == reach:
            return reach
        reach = more


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    random.seed(seed)
    names = [f"t{i}" for i in range(6)]
    edges = sorted({(f"a{g}", random.choice(names), random.choice(names)) for g in range(12) for _ in range(5)})
    apps = sorted({a for a, _, _ in edges})
    frames, tables = frame(spark, edges), tables_of(spark, edges)
    cycles = {(r["app"], r["table_name"]): r["component"] for r in graph.fk_cycles(frames, ["app"]).collect()}
    rounds = {(r["app"], r["table_name"]): r["round"] for r in graph.removal_order(tables, frames, ["app"]).collect()}
    roots = spark.createDataFrame([(a, min(t for x, c, p in edges for t in (c, p) if x == a)) for a in apps],
                                  "app string, root string")
    reached = {(r["app"], r["table_name"]): r["reachable"]
               for r in graph.reachability(tables, roots, frames, ["app"]).collect()}
    for app in apps:
        reach = walk(edges, app)
        nodes = {t for a, c, p in edges if a == app for t in (c, p)}
        on_cycle = {n: min([n] + [m for m in nodes if (n, m) in reach and (m, n) in reach]) for n in nodes
                    if (n, n) in reach}
        assert {t: c for (a, t), c in cycles.items() if a == app} == on_cycle
        root = min(nodes)
        assert {t: v for (a, t), v in reached.items() if a == app} == {n: n == root or (n, root) in reach for n in nodes}
        plain = {(c, p) for a, c, p in edges if a == app and c != p}
        real = walk([(app, c, p) for c, p in plain], app) if plain else set()
        if any((n, n) in real for n in nodes):
            assert not [t for a, t in rounds if a == app]
        else:
            assert {t for a, t in rounds if a == app} == nodes
            assert all(rounds[(app, c)] < rounds[(app, p)] for c, p in plain)


def test_deep_chain(spark):
    edges = [("a", f"t{i:02d}", f"t{i + 1:02d}") for i in range(12)]
    order = graph.removal_order(tables_of(spark, edges), frame(spark, edges), ["app"]).orderBy("round").collect()
    assert [r["table_name"] for r in order] == [f"t{i:02d}" for i in range(13)]
    assert graph.transitive_closure(frame(spark, edges), ["app"]).count() == 13 * 12 // 2
    assert graph.fk_cycles(frame(spark, edges), ["app"]).isEmpty()


def test_composite_keys_do_not_reach(spark):
    edges = frame(spark, [("a", "child", "root")]).withColumn("child_columns", F.array(F.lit("x"), F.lit("y")))
    tables = tables_of(spark, [("a", "child", "root")])
    roots = spark.createDataFrame([("a", "root")], "app string, root string")
    got = {r["table_name"]: r["reachable"] for r in graph.reachability(tables, roots, edges, ["app"]).collect()}
    assert got == {"child": False, "root": True}


def test_issues(spark):
    rows = [("a", "e1", "items", ["x"], "orders", ["id"], "CASCADE"), ("a", "e2", "notes", ["x"], "orders", ["id"], "SET NULL"),
            ("a", "e3", "pays", ["x"], "orders", ["id"], "RESTRICT"), ("a", "e4", "orders", ["x"], "users", ["id"], "NO ACTION")]
    edges = spark.createDataFrame(rows, SCHEMA)
    chosen = spark.createDataFrame([("a", "orders")], "app string, table_name string")
    got = {r["name"]: (r["kind"], r["severity"]) for r in graph.selection_issues(edges, chosen, ["app"]).collect()}
    assert got == {
        "e1": ("unselected_child_cascade", "blocking"), "e2": ("unselected_child_set_null", "blocking"),
        "e3": ("unselected_child_blocks", "blocking"), "e4": ("child_without_parent", "warning"),
    }


def test_edge_data(spark):
    child = spark.sql("SELECT CASE WHEN id = 0 THEN NULL WHEN id < 3 THEN 99 ELSE id END AS fk FROM range(10)")
    parent = spark.sql("SELECT id FROM range(10) UNION ALL SELECT 5L")
    row = graph.check_edge_data(child, "fk", parent, "id").first()
    assert (row["child_rows"], row["null_keys"], row["orphans"], row["repeated_parent_keys"]) == (10, 1, 2, 1)


def test_plans_do_not_grow_with_the_rounds(spark):
    """A chain of 25 tables takes as many rounds; what is returned still reads one folder."""
    edges = [("a", f"t{i + 1:02}", f"t{i:02}") for i in range(24)]
    frames, tables = frame(spark, edges), tables_of(spark, edges)
    roots = spark.createDataFrame([("a", "t00")], "app string, root string")
    reached = graph.reachability(tables, roots, frames, ["app"])
    order = graph.removal_order(tables, frames, ["app"])
    assert reached.where("reachable").count() == 25
    assert {r["table_name"]: r["round"] for r in order.collect()} == {f"t{i:02}": 24 - i for i in range(25)}
    for df, scans in ((reached, 1), (order, 2)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count(" parquet") <= scans


def test_small_and_large_graphs_are_followed_alike(spark, monkeypatch):
    """Graphs at both sides of the bound, some without a known application; the small ones are dealt out whole."""
    monkeypatch.setattr(graph, "SMALL", 4)
    edges = [("a", "x", "y"), ("a", "y", "z"), ("a", "z", "x"), ("a", "w", "x"), (None, "p", "q"), (None, "q", "p")]
    edges += [("b", f"n{i}", f"n{i + 1}") for i in range(6)] + [("b", "n6", "n3"), ("c", "s", "s"), ("c", "s", "s"), ("d", "u", "v")]
    df = spark.createDataFrame(edges, "app string, child string, parent string")
    found = {(r.app, r.table_name): r.component for r in graph.fk_cycles(df, ["app"]).collect()}
    assert found == {**{("a", t): "x" for t in "xyz"}, **{("b", f"n{i}"): "n3" for i in range(3, 7)}, ("c", "s"): "s"}
    paths = {(r.app, r.node, r.ancestor) for r in graph.transitive_closure(df, ["app"]).collect()}
    assert ("a", "w", "z") in paths and ("b", "n0", "n6") in paths and ("d", "u", "v") in paths and (None, "p", "q") in paths
    assert len([p for p in paths if p[0] == "a"]) == 12
    whole = graph._by_size(df, ["app"])[0]
    assert sorted({r.app or "" for r in whole.collect()}) == ["", "a", "c", "d"]


def test_reach_and_order_of_small_and_large_graphs(spark, monkeypatch):
    """Both ways give the same rows, repeated rows, unknown applications and unnamed tables included."""
    edges = [("a", "x", "y"), ("a", "x", "y"), ("a", "w", "w"), ("b", "p", "q"), ("b", "q", "p"), ("b", "r", "p"), (None, "n", "m")]
    edges += [("c", f"n{i}", f"n{i + 1}") for i in range(6)] + [("a", None, "y"), ("a", "lost", "y"), ("a", "x", "gone")]
    tables = [(a, t) for a, c, p in edges for t in (c, p) if t not in ("lost", "gone")] + [("d", "alone")]
    frames, listed = frame(spark, edges), spark.createDataFrame(tables, "app string, table_name string")
    roots = spark.createDataFrame([("a", "y"), ("b", "q"), ("c", "n6"), (None, "m"), ("a", "y")], "app string, root string")
    up = {("a", "x"), ("a", "y"), ("b", "p"), ("b", "q"), ("b", "r"), *(("c", f"n{i}") for i in range(7))}
    rounds = {(a, t): 0 for a, t in tables if a != "b"} | {("a", "y"): 1} | {("c", f"n{i}"): i for i in range(7)}
    for small in (256, 12, 0):
        monkeypatch.setattr(graph, "SMALL", small)
        reached = [tuple(r) for r in graph.reachability(listed, roots, frames, ["app"]).collect()]
        assert sorted(map(str, reached)) == sorted(str((a, t, (a, t) in up)) for a, t in tables)
        order = [tuple(r) for r in graph.removal_order(listed, frames, ["app"]).collect()]
        assert sorted(map(str, order)) == sorted(str((*k, n)) for k, n in rounds.items())


def test_parts_grow_with_the_rows(spark, monkeypatch):
    """A task of the graph operators holds a bounded number of rows, however few bytes they are in files."""
    from tideline import session

    monkeypatch.setattr(session, "DEALT_ROWS", 100)
    edges = spark.range(3000).selectExpr("id AS app", "'x' AS child", "'y' AS parent", "array('a') AS child_columns")
    tables = edges.selectExpr("app", "explode(array(child, parent)) AS table_name")
    roots = edges.selectExpr("app", "'y' AS root")
    for df, rows in ((graph.reachability(tables, roots, edges, ["app"]), 12_000), (graph.removal_order(tables, edges, ["app"]), 9000)):
        assert df.rdd.getNumPartitions() == rows // 100 and df.count() == 6000

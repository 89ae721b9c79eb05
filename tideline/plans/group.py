"""A table group: one dated root table and the tables that hang off it through foreign keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tideline.functions.days import is_date_type
from tideline.session import small_frame

EDGE_SCHEMA = (
    "name: string, child: string, child_columns: array<string>, parent: string, parent_columns: array<string>, "
    "on_delete: string"
)


@dataclass(frozen=True)
class FkEdge:
    """A foreign key from ``child`` to ``parent``. Files carry none, so edges are given and checked against data."""

    name: str
    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "NO ACTION"


@dataclass(frozen=True)
class GroupSpec:
    """What to archive together: the root's ``date_column`` gives every row of the group its day."""

    application: str
    root: str
    date_column: str
    tables: tuple[str, ...]
    primary_keys: Mapping[str, tuple[str, ...]]
    time_zone: str
    cutoff_day: str
    target: int
    ntz_is_utc: bool = False


@dataclass(frozen=True)
class GroupPlan:
    spec: GroupSpec
    links: Mapping[str, FkEdge]
    edges: tuple[FkEdge, ...]
    removal_order: tuple[str, ...]
    blocking: tuple[str, ...] = ()
    warnings: tuple[str, ...] = field(default=())

    @property
    def export_order(self) -> tuple[str, ...]:
        return tuple(reversed(self.removal_order))

    def primary_key(self, table: str) -> str:
        return self.spec.primary_keys[table][0]

    def children(self, table: str) -> list[FkEdge]:
        """Links from selected tables that reach the root through ``table``."""
        return [self.links[t] for t in self.spec.tables if t in self.links and self.links[t].parent == table]

    def incoming(self, table: str) -> list[FkEdge]:
        """Every foreign key, selected or not, that points at ``table``; its own too."""
        return [e for e in self.edges if e.parent == table]


class PlanBlocked(ValueError):
    """The group cannot be archived as described."""


def edges_frame(spark: SparkSession, edges: Sequence[FkEdge]) -> DataFrame:
    return small_frame(spark, [asdict(e) for e in edges], EDGE_SCHEMA)


def resolve_links(spec: GroupSpec, edges: Sequence[FkEdge]) -> dict[str, FkEdge]:
    """One single-column foreign key per non-root table that leads towards the root."""
    links: dict[str, FkEdge] = {}
    reached = [spec.root]
    for parent in reached:
        for edge in edges:
            if edge.parent == parent and edge.child in spec.tables and len(edge.child_columns) == 1:
                if edge.child not in reached:
                    links[edge.child] = edge
                    reached.append(edge.child)
    return links


def removal_rounds(tables: Sequence[str], edges: Sequence[FkEdge]) -> list[str]:
    """Children before parents; within a round by name. Tables on or above a cycle are left out."""
    referencing = {t: {e.child for e in edges if e.parent == t and e.child != t and e.child in tables} for t in tables}
    order: list[str] = []
    while True:
        ready = sorted(t for t in tables if t not in order and referencing[t] <= set(order))
        if not ready:
            return order
        order.extend(ready)


def selection_issues(tables: Sequence[str], edges: Sequence[FkEdge]) -> tuple[list[str], list[str]]:
    """Blocking issues and warnings raised by edges that cross the selection's border."""
    kinds = {
        "CASCADE": "unselected_child_cascade",
        "SET NULL": "unselected_child_set_null",
        "SET DEFAULT": "unselected_child_set_null",
    }
    blocking, warnings = [], []
    for e in edges:
        text = f"{e.name} ({e.child} → {e.parent}, ON DELETE {e.on_delete})"
        if e.parent in tables and e.child not in tables:
            blocking.append(f"{kinds.get(e.on_delete, 'unselected_child_blocks')}: {text}")
        elif e.child in tables and e.parent not in tables:
            warnings.append(f"child_without_parent: {text}")
    return blocking, warnings


def plan_group(spec: GroupSpec, schemas: Mapping[str, T.StructType], edges: Sequence[FkEdge]) -> GroupPlan:
    """Check a group and fix its order. Nothing is read: this looks at names, types and keys only."""
    if spec.root not in spec.tables:
        raise ValueError("the root must be one of the group's tables")
    blocking, warnings = selection_issues(spec.tables, edges)
    for table in spec.tables:
        if len(spec.primary_keys.get(table, ())) != 1:
            blocking.append(f"no_single_column_primary_key: {table}")
    root_fields = {f.name: f.dataType for f in schemas[spec.root].fields}
    if spec.date_column not in root_fields:
        blocking.append(f"date_column_missing: {spec.date_column}")
    elif not is_date_type(root_fields[spec.date_column]):
        kind = root_fields[spec.date_column].simpleString()
        blocking.append(f"date_column_not_temporal: {spec.date_column} is {kind}")
    links = resolve_links(spec, edges)
    blocking += [f"not_reachable_from_root: {t}" for t in spec.tables if t != spec.root and t not in links]
    order = removal_rounds(spec.tables, edges)
    stuck = [t for t in spec.tables if t not in order]
    if stuck:
        blocking.append(f"cycle among {', '.join(stuck)}")
    selfish = [e for e in edges if e.child == e.parent and e.child in spec.tables]
    blocking += [f"cycle: {e.name} ({e.child} → itself)" for e in selfish]
    return GroupPlan(spec, links, tuple(edges), tuple(order), tuple(blocking), tuple(warnings))


def require_plannable(plan: GroupPlan) -> GroupPlan:
    if plan.blocking:
        raise PlanBlocked("; ".join(plan.blocking))
    return plan

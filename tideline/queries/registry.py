"""Registry of queries, and the derived tables they share.

A derived table is one SQL text that Spark and the checking engine both run over the driver's tables, so a
query and its check start from the same rows but compute their result separately.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tideline.session import dealt

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

DERIVED: dict[str, str] = {}
_DEALT: dict[str, dict[str, tuple[str, ...]]] = {}
CHECK_TABLES: dict[str, str] = {}
_SCHEMAS: dict[str, T.StructType] = {}


def derive(name: str, sql: str, deal: dict[str, tuple[str, ...]] | None = None) -> None:
    """Register a derived table; other tables are named in braces.

    ``deal`` names tables that Spark deals out by some columns first, for a text that groups by these and more.
    """
    DERIVED[name] = sql.strip()
    _DEALT[name] = deal or {}


def check_table(name: str, sql: str) -> None:
    """A step several checks share; only the checking engine sees it."""
    CHECK_TABLES[name] = sql.strip()


@dataclass
class Inputs:
    """The driver's tables of one scale, and the tables derived from them."""

    spark: SparkSession
    folder: str

    def path(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            path = self.path(name)
            if path not in _SCHEMAS:
                _SCHEMAS[path] = self.spark.read.parquet(path).schema
            return self.spark.read.schema(_SCHEMAS[path]).parquet(path)
        if name in DERIVED:
            sql = DERIVED[name]
            used = {n: getattr(self, n) for n in table_names(sql)}
            used |= {n: dealt(used[n], *keys, rows=used[n].count()) for n, keys in _DEALT[name].items()}
            return self.spark.sql(sql, **used)
        raise AttributeError(name)


def table_names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Inputs], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; ``sql`` is its check, with the driver's and derived tables in braces."""

    def register(run: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, run, sql.strip() if sql else None)
        return run

    return register


def plain(df: DataFrame) -> DataFrame:
    """Days and moments as text, so both engines hand out the same values."""
    columns = []
    for f in df.schema.fields:
        column = df[f"`{f.name}`"]
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string").alias(f.name)
        columns.append(column)
    return df.select(*columns)


def check_sql(sql: str) -> str:
    """The complete text of a check: the derived tables it needs as common table expressions, then the check."""
    shared_tables = {**DERIVED, **CHECK_TABLES}
    known = {*shared_tables, *BASE_TABLES}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in table_names(text):
            if name in shared_tables and name not in needed:
                visit(shared_tables[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)

    def bare(text: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in known else m[0], text)

    shared = [f"{name} AS (\n{bare(shared_tables[name])}\n)" for name in needed]
    body = bare(sql)
    recursive = ""
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    if own:
        recursive = "RECURSIVE " if own.group(1) else ""
        shared.append(body[own.end():])
        return f"WITH {recursive}" + ",\n".join(shared)
    if not shared:
        return body
    return "WITH " + ",\n".join(shared) + "\n" + body

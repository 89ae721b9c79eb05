"""Hashes over table descriptions, one per application; a description is as long as its tables have columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import small_frame

COLUMN_SCHEMA = (
    "table_name: string, ordinal: int, column_name: string, data_type: string, nullable: boolean, key_part: int"
)


def schema_columns(
    spark: SparkSession, schemas: Mapping[str, T.StructType], primary_keys: Mapping[str, Sequence[str]]
) -> DataFrame:
    """The columns of the tables of one group as rows."""
    rows = []
    for table, schema in schemas.items():
        keys = list(primary_keys.get(table, ()))
        for i, f in enumerate(schema.fields):
            key_part = keys.index(f.name) + 1 if f.name in keys else 0
            rows.append(
                {
                    "table_name": table,
                    "ordinal": i + 1,
                    "column_name": f.name,
                    "data_type": f.dataType.simpleString(),
                    "nullable": f.nullable,
                    "key_part": key_part,
                }
            )
    return small_frame(spark, rows, COLUMN_SCHEMA)


def _hash_of_rows(df: DataFrame, order: Sequence[str], rest: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct(*order, *rest)))
    return df.groupBy(*by).agg(F.sha2(F.to_json(entries, {"ignoreNullFields": "false"}), 256).alias(name))


def schema_hash(columns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Changes with any column name, type, nullability, order or key, all of which row hashes cannot see."""
    order = ["table_name", "ordinal"]
    rest = [c for c in columns.columns if c not in (*order, *by)]
    return _hash_of_rows(columns, order, sorted(rest), by, "schema_hash")


def graph_hash(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Changes with any foreign key, its columns or its delete action."""
    rest = [c for c in edges.columns if c not in ("name", *by)]
    return _hash_of_rows(edges, ["name"], sorted(rest), by, "graph_hash")

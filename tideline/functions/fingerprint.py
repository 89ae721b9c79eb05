"""Canonical row text and the hashes taken over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINGERPRINT_ALGORITHM = "sha256(canonical row text)/base64"


def canonical_value(column: Column, data_type: T.DataType, double_as: str | None = None) -> Column:
    """Text of one value that does not depend on session settings other than the pinned UTC zone."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)) and double_as:
        return column.cast(double_as).cast("string")
    if isinstance(data_type, T.BinaryType):
        return F.base64(column)
    if isinstance(data_type, T.MapType):  # the order of a map's entries carries no meaning
        entry = lambda k: F.struct(k.alias("k"), F.element_at(column, k).alias("v"))
        return F.to_json(F.transform(F.array_sort(F.map_keys(column)), entry), {"ignoreNullFields": "false"})
    if isinstance(data_type, (T.ArrayType, T.StructType, T.VariantType)):
        return F.to_json(column, {"ignoreNullFields": "false"})
    return column.cast("string")


def canonical_row(df: DataFrame, columns: Sequence[str] | None = None, double_as: str | None = None) -> Column:
    """Every column in order as ``length:text``, or ``-`` for NULL, so no two different rows share a text.

    ``double_as`` names a decimal type for floating columns when another engine must produce the same text.
    """
    names = list(columns or df.columns)
    parts = []
    for name in names:
        text = canonical_value(F.col(f"`{name}`"), df.schema[name].dataType, double_as)
        parts.append(F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def row_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, double_as: str | None = None) -> Column:
    """SHA-256 of the row, base64, 44 characters. Renames and type changes stay invisible: pair with a schema hash."""
    return F.base64(F.unhex(F.sha2(canonical_row(df, columns, double_as), 256)))


def row_fingerprint_md5(df: DataFrame, columns: Sequence[str] | None = None, double_as: str | None = None) -> Column:
    """The MD5 variant, kept for comparison."""
    return F.md5(canonical_row(df, columns, double_as))

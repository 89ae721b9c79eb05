"""A Bloom filter over keys, as a small table: which rows may hold one of many keys is told in the scan, before any shuffle.

The filter is an array of 64-bit words. A key sets ``BITS`` bits in the one word that its hash names, so building it is a grouped
bitwise or with map-side combining, and testing it is a broadcast join on the word's number. It has ``BITS_PER_KEY`` bits for each
key and at most ``MOST_WORDS`` words, which bounds what is broadcast; with more keys than that it lets more rows through,
and the exact join that follows decides as always. No key is ever missed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS, BITS_PER_KEY, LEAST_WORDS, MOST_WORDS = 4, 16, 1 << 8, 1 << 20


def words_for(keys: int) -> int:
    return min(MOST_WORDS, max(LEAST_WORDS, -(-keys * BITS_PER_KEY // 64)))


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words).cast("long"))


def _mask(key: Column) -> Column:
    """``BITS`` bits told by another hash of the key, six bits of it each."""
    drawn = F.xxhash64(F.lit(7), key)
    one = F.lit(1).cast("long")
    mask = None
    for i in range(BITS):
        place = F.shiftrightunsigned(drawn, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        bit = F.call_function("shiftleft", one, place)
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


@dataclass(frozen=True)
class KeyFilter:
    """``table(_word, _bits)`` of at most ``words`` rows, over keys of one type."""

    table: DataFrame
    words: int
    kind: T.DataType

    def _tested(self, rows: DataFrame, key: Column, how: str) -> tuple[DataFrame, Column]:
        own = key.cast(self.kind)
        marked = rows.withColumns({"_word": _word(own, self.words), "_need": _mask(own)})
        joined = marked.join(F.broadcast(self.table), "_word", how)
        return joined, F.col("_bits").bitwiseAND(F.col("_need")) == F.col("_need")

    def may_hold(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows whose key may be among the filter's keys: all that are, and few others."""
        joined, hit = self._tested(rows, F.col(f"`{key}`"), "inner")
        return joined.where(hit).select(*(F.col(f"`{c}`") for c in rows.columns))

    def cannot_hold(self, rows: DataFrame, key: str) -> DataFrame:
        """The other rows: their keys surely are not among the filter's, or are null."""
        joined, hit = self._tested(rows, F.col(f"`{key}`"), "left")
        return joined.where(~F.coalesce(hit, F.lit(False))).select(*(F.col(f"`{c}`") for c in rows.columns))


def key_filter(keys: DataFrame, column: str, count: int, kind: T.DataType | None = None) -> KeyFilter:
    """A filter over the values of ``column``, sized for ``count`` of them; ``kind`` is the type of the keys to test."""
    kind, words = kind or keys.schema[column].dataType, words_for(count)
    own = F.col(f"`{column}`").cast(kind)
    named = keys.where(F.col(f"`{column}`").isNotNull()).select(_word(own, words).alias("_word"), _mask(own).alias("_bits"))
    return KeyFilter(named.groupBy("_word").agg(F.bit_or("_bits").alias("_bits")), words, kind)

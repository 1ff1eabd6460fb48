"""Rows whose key is in a set, found where they are read: neither side is shuffled for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: bits for each key, and the most words of 64 bits that a table has (8 MB)
BITS_PER_KEY, MOST_WORDS = 16, 1 << 20


def maybe_in(rows: DataFrame, key: list[str | Column], keys: DataFrame) -> DataFrame:
    """All rows whose `key` is a row of `keys`, and a few others: one in 16 up to four million keys, more beyond.

    Each key sets one bit of a table that the plan holds as a scalar subquery. It is for rows that are long, where an
    exact step later drops the others; `keys` is read twice.
    """
    words = min(MOST_WORDS, 1 << (keys.count() * BITS_PER_KEY // 64).bit_length())
    place = lambda h: F.pmod(F.shiftrightunsigned(h, 6), F.lit(words)).cast("int")
    bit = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    hashed = F.xxhash64(*keys.columns)
    found = keys.select(place(hashed).alias("_at"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(hashed)).alias("_bit"))
    table = found.groupBy("_at").agg(F.bit_or("_bit").alias("_bits"))
    whole = keys.sparkSession.range(words).join(table, F.col("id") == F.col("_at"), "left").agg(
        F.array_sort(F.collect_list(F.struct("id", F.coalesce("_bits", F.lit(0).cast("bigint")).alias("bits")))).alias("words"))
    asked = F.xxhash64(*key)
    return rows.filter(F.bit_get(F.get(whole.select("words.bits").scalar(), place(asked)), bit(asked)) == 1)

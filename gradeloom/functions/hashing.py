"""Seeded draws that any SQL engine can reproduce with 64-bit integer arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

MODULUS = 2147483647


def with_draw(df: DataFrame, replicate: str, item: str, seed: int, out: str = "draw") -> DataFrame:
    """Add a uniform integer in [0, MODULUS) made from (replicate, item, seed).

    Each step is its own column, because a step is read several times by the
    next and must not be expanded into it.
    """
    i = F.col(item).cast("bigint")
    x0, x1 = F.col("_x0"), F.col("_x1")
    steps = df.withColumn("_x0", (F.col(replicate).cast("bigint") * 40014 + i * 40692 + F.lit(seed).cast("bigint")) % MODULUS)
    steps = steps.withColumn("_x1", ((x0 * x0) % MODULUS + x0 * 16807 + i * 99991) % MODULUS)
    return steps.withColumn(out, ((x1 * x1) % MODULUS + x1 * 48271) % MODULUS).drop("_x0", "_x1")


def text_key(text: Column) -> Column:
    """32-bit integer from the md5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def poisson_cuts(upto: int = 12) -> list[int]:
    """Integer thresholds of the Poisson(1) distribution over [0, MODULUS)."""
    total, cuts = 0.0, []
    for k in range(upto):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(int(total * MODULUS))
    return cuts


def poisson_weight(draw: Column) -> Column:
    """Poisson(1) weight of a uniform draw: how many thresholds it reaches."""
    weight = F.lit(0)
    for cut in poisson_cuts():
        weight = weight + (draw >= F.lit(cut)).cast("int")
    return weight


def pseudonym(tag: str | Column, value: Column) -> Column:
    """Deterministic stand-in `<TAG:sha8>` for a sensitive value."""
    name = F.lit(tag.upper()) if isinstance(tag, str) else F.upper(tag)
    return F.concat(F.lit("<"), name, F.lit(":"), F.substring(F.sha2(value, 256), 1, 8), F.lit(">"))

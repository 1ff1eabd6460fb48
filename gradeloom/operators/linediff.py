"""Line differences: the lines of either text outside the longest common blocks, found pair by pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from gradeloom.functions.matching import line_changes
from gradeloom.functions.text import lines

CHANGES = T.ArrayType(T.StructType([T.StructField("sign", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.udf(returnType=CHANGES, useArrow=False)
def _pair_changes(before: str, after: str) -> list[tuple[str, int, str]]:
    return list(line_changes(before, after))


def changed_lines(pairs: DataFrame, key: str, before: str = "buggy", after: str = "reference_fix") -> DataFrame:
    """(key, sign, n, text): lines of `before` ('-') and `after` ('+') that the alignment of the two leaves over.

    Lines keep their order in the alignment, so a moved line is taken out of one place ('-') and put into another
    ('+'). `n` is the 1-based line number on the line's own side. A null text is empty. A pair is aligned within
    its row, so nothing is shuffled; equal sides don't reach Python, which holds some hundred pairs at a time.
    """
    sides = [F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((before, "before"), (after, "after"))]
    differing = pairs.select(F.col(key).alias("key"), *sides).filter("before <> after")
    return differing.select("key", F.explode(_pair_changes("before", "after")).alias("change")).select(F.col("key").alias(key), "change.*")


def apply_changes(pairs: DataFrame, changes: DataFrame, key: str, before: str = "buggy") -> DataFrame:
    """(key, rebuilt): `before` without its '-' lines and with the '+' lines at their numbers.

    A '+' line that is number n of the new text and the q-th of its kind follows n - q lines that stayed; the lines
    that stayed keep their order. A pair's lines meet in one array, which is no longer than its texts.
    """
    old = pairs.select(key, F.posexplode(lines(F.col(before))).alias("n", "text")).withColumn("n", F.col("n") + 1)
    left = old.join(changes.filter("sign = '-'").select(key, "n"), [key, "n"], "left_anti")
    place = F.row_number().over(W.partitionBy(key).orderBy("n"))
    stayed = left.select(key, F.struct((place - 1).alias("after"), F.lit(1).alias("kind"), "n", "text").alias("line"))
    new = changes.filter("sign = '+'").select(key, F.struct((F.col("n") - place).alias("after"), F.lit(0).alias("kind"), "n", "text").alias("line"))
    ordered = stayed.unionByName(new).groupBy(key).agg(F.array_sort(F.collect_list("line")).alias("ls"))
    return ordered.select(key, F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("rebuilt"))


def substantive(text: Column) -> Column:
    """Not blank or tiny, not a comment line."""
    t = F.trim(text)
    return (F.length(t) >= 4) & ~(t.startswith("#") | t.startswith("//") | t.startswith("*") | t.startswith("/*"))


def diff_counts(changes: DataFrame, key: str) -> DataFrame:
    """Per pair: changed, added, removed, substantive, strength (share of non-trivial changed lines)."""
    trivial = F.length(F.rtrim("text")) <= 2
    return changes.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_changed"), F.count_if(F.col("sign") == "+").alias("n_added"),
        F.count_if(F.col("sign") == "-").alias("n_removed"), F.count_if(substantive(F.col("text"))).alias("n_substantive"),
        (1.0 - F.count_if(trivial) / F.count(F.lit(1))).alias("strength"))


def diff_texts(changes: DataFrame, key: str) -> DataFrame:
    """Per pair, in line order: removed_lines array<struct<n,text>> and added_text (lines run together).

    Both are at most as long as the pair's own two texts.
    """
    minus, plus = F.col("sign") == "-", F.col("sign") == "+"
    ordered = lambda test: F.sort_array(F.collect_list(F.when(test, F.struct("n", "text"))))
    return changes.groupBy(key).agg(
        ordered(minus).alias("removed_lines"),
        F.array_join(F.transform(ordered(plus), lambda x: x.getField("text")), "").alias("added_text"))

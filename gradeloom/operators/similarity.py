"""Answers against task texts: digests first, full texts only where needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import fixed_values as fv
from gradeloom.functions.similarity import character_ratio, length_bound, token_similarity
from gradeloom.functions.text import squash
from gradeloom.operators.membership import maybe_in


def task_digests(tasks: DataFrame) -> DataFrame:
    """Length and sha256 of the whitespace-normalised buggy and reference text."""
    b, r = squash(F.col("buggy")), squash(F.col("reference_fix"))
    return tasks.select(
        "task_id", F.length(b).alias("buggy_len"), F.sha2(b, 256).alias("buggy_sha"),
        F.length(r).alias("ref_len"), F.sha2(r, 256).alias("ref_sha"))


def compare_answers(rows: DataFrame, tasks: DataFrame, candidate: Column, row_id: str = "ingest_seq",
                    how: str = "inner", threshold: float = fv.UNCHANGED_RATIO) -> DataFrame:
    """Add `verbatim`, `echo_ratio`, `known_task` and the text lengths to result rows.

    Equality and the length bound decide almost every row from 64-byte digests.
    Only the rest carry their candidate through a second join to the full buggy
    text; decided rows get a key that matches nothing and spreads evenly.
    `echo_ratio` is NULL where it is known to be below `threshold`.
    """
    left = rows.withColumn("_norm", squash(candidate))
    digested = _against_digests(left, tasks, F.length("_norm"), F.sha2("_norm", 256), how, threshold).withColumn(
        "_key", F.when(F.col("_open"), F.col("task_id")).otherwise(F.concat(F.lit("\u0000"), F.col(row_id).cast("string"))))
    digested = digested.withColumn("_norm", F.when(F.col("_open"), F.col("_norm")))
    texts = tasks.select(F.col("task_id").alias("_key"), squash(F.col("buggy")).alias("_buggy"))
    return _compared(digested.join(texts, "_key", "left"), rows.columns, character_ratio("_norm", "_buggy"))


def answer_digest(norm: Column) -> Column:
    """What stands for a whitespace-normalised answer in `compare_digests`."""
    return F.struct(F.length(norm).alias("size"), F.sha2(norm, 256).alias("sha"))


def compare_digests(rows: DataFrame, tasks: DataFrame, texts: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame, str], DataFrame],
                    how: str = "inner", threshold: float = fv.UNCHANGED_RATIO) -> DataFrame:
    """`compare_answers` of rows that hold an `answer` digest in place of the text.

    `texts` fetches (sha, norm) of the rows that digest and length don't decide;
    `keep` stores the rows meanwhile.
    """
    digested = keep(_against_digests(rows, tasks, F.col("answer.size"), F.col("answer.sha"), how, threshold), "digested")
    undecided = digested.filter("_open")
    asked = maybe_in(tasks, ["task_id"], undecided.select("task_id")).select("task_id", squash(F.col("buggy")).alias("_buggy"))
    answers = texts(undecided).select(F.col("sha").alias("_sha"), F.col("norm").alias("_norm"))
    full = undecided.join(answers, F.col("answer.sha") == F.col("_sha"), "left").join(asked, "task_id", "left")
    return _compared(digested.filter("NOT _open"), rows.columns, F.lit(None).cast("double")).unionByName(
        _compared(full, rows.columns, character_ratio("_norm", "_buggy")))


def _against_digests(rows: DataFrame, tasks: DataFrame, size: Column, sha: Column, how: str, threshold: float) -> DataFrame:
    """Rows with the lengths of their task's texts, and what equality and the length bound say: `_same`, `_is_ref`, `_open`."""
    joined = rows.join(task_digests(tasks).withColumn("known_task", F.lit(True)), "task_id", how)
    same_buggy = F.coalesce(sha == F.col("buggy_sha"), F.lit(False)) & (size > 0)
    bound = F.coalesce(length_bound(size, F.col("buggy_len")), F.lit(0.0))
    open_row = ~same_buggy & (bound >= threshold) & (F.col("buggy_len") >= fv.UNCHANGED_MIN_LEN)
    return joined.select("*", same_buggy.alias("_same"), F.coalesce(open_row, F.lit(False)).alias("_open"),
                         F.coalesce(sha == F.col("ref_sha"), F.lit(False)).alias("_is_ref")).drop("buggy_sha", "ref_sha")


def _compared(digested: DataFrame, columns: list[str], ratio: Column) -> DataFrame:
    return digested.select(
        *columns,
        F.coalesce("known_task", F.lit(False)).alias("known_task"),
        F.col("buggy_len"), F.col("ref_len"),
        (F.col("_is_ref") & (F.col("ref_len") > fv.VERBATIM_MIN_LEN)).alias("verbatim"),
        F.when(F.col("_same"), F.lit(1.0)).otherwise(ratio).alias("echo_ratio"))


def patch_similarity(pairs: DataFrame, left: str, right: str, out: str = "similarity") -> DataFrame:
    """Token similarity per row; identical (left, right) pairs are compared once.

    Copies collapse in a partial aggregation before any shuffle, so a text that
    fills a third of the table is one comparison.
    """
    keyed = pairs.withColumn("_pair", F.sha2(F.concat_ws("\u0001", F.sha2(left, 256), F.sha2(right, 256)), 256))
    distinct = keyed.groupBy("_pair").agg(F.first(left).alias("_l"), F.first(right).alias("_r"))
    same = F.col("_l") == F.col("_r")
    scored = distinct.select("_pair", F.when(same & (F.length(F.trim("_l")) > 0), F.lit(1.0)).otherwise(
        token_similarity(F.when(~same, F.col("_l")), F.when(~same, F.col("_r")))).alias(out))
    return keyed.join(scored, "_pair", "left").drop("_pair").withColumn(out, F.coalesce(out, F.lit(0.0)))


def unchanged(echo_ratio: Column, buggy_len: Column) -> Column:
    """The answer is the input: ratio at the threshold and a text long enough to judge."""
    return F.coalesce((echo_ratio >= fv.UNCHANGED_RATIO) & (buggy_len >= fv.UNCHANGED_MIN_LEN), F.lit(False))

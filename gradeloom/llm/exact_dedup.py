"""Exact deduplication by skew-safe combining.

Texts are equal when they are the same after every character of
`[\\x20\\x09-\\x0D]` is deleted. The group keys of every stage hold the whole
remaining text, so a digest only says where a text goes, never that two texts
are equal:

1. each task folds its own rows (the map side of the first aggregate), so a
   group that holds a third of the table leaves a task as one row;
2. rows of one digest are dealt over `salts` groups and folded there;
3. the winners of the salts, at most `salts` per text, are combined.

Defined cases: null text counts as empty; all empty texts form one group; a
null id ranks after every other; of rows that repeat id and text, one is
kept. No columns but the id and the text are read, so others may have any
name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import SPACE_CLASS, kept_table, text_or_empty, unused

SALTS = 16


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(column), f"[{SPACE_CLASS}]+", "")


def _rows(docs: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    base = docs.select(F.col(doc_id).alias("id"), F.length(text_or_empty(text)).alias("points"), normalised(text).alias("norm"))
    return base.select("id", "points", "norm", F.unhex(digest(F.col("norm"))).alias("digest"), F.unhex(F.md5("norm")).alias("mark"))


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def winners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS,
            digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per different text: digest, mark, keep_id, keep_points, group_size."""
    rows = _rows(docs, doc_id, text, digest).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = rows.groupBy("digest", "salt", "norm", "mark", "points").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    by_points = salted.repartition("digest").groupBy("digest", "norm", "mark", "points").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    whole = by_points.groupBy("digest", "norm", "mark").agg(
        F.max_by("id", "points").alias("keep_id"), F.max("points").alias("keep_points"), F.sum("n").alias("group_size"))
    # a text is addressed by digest and mark from here on; two texts that share both must not be mixed up silently
    clash = F.assert_true(F.col("texts") == 1, "two different texts share both digests")
    return (whole.groupBy("digest", "mark")
            .agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.max("keep_points").alias("keep_points"),
                 F.sum("group_size").alias("group_size"))
            .withColumn("clash", clash).where(F.col("clash").isNull()).drop("texts", "clash"))


def _members(docs: DataFrame, doc_id: str, text: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per different (id, points, text): key, id, points, text_sha256, copies, keep_id, group_size, own (the winner's)."""
    key = F.concat("digest", "mark").alias("key")
    best = winners(docs, doc_id, text, salts, digest).select(key, "keep_id", "keep_points", "group_size")
    members = (_rows(docs, doc_id, text, digest)
               .groupBy("id", "points", "digest", "mark", F.sha2("norm", 256).alias("text_sha256")).agg(F.count(F.lit(1)).alias("copies"))
               .select(key, "id", "points", "text_sha256", "copies"))
    own = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    return members.join(best, "key").withColumn("own", own)


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS,
           digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, points."""
    return (_members(docs, doc_id, text, salts, digest)
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
            .select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("own") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "points"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of `docs` for each different text, with all its columns: as many as `assign` marks `kept`.

    Rows that repeat the winner's id and text are folded in their task first.
    """
    own_id, points, sha, copies = (unused(docs, name) for name in ("__id", "__points", "__sha", "__copies"))
    keep = kept_table(_members(docs, doc_id, text, salts, sha256).where("own").select(
        F.col("id").alias(own_id), F.col("points").alias(points), F.col("text_sha256").alias(sha), F.col("copies").alias(copies)), "exact-winners")
    same = (F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.length(text_or_empty(text)) == F.col(points))
            & (F.sha2(normalised(text), 256) == F.col(sha)))
    once, again = docs.join(keep.where(F.col(copies) == 1), same, "left_semi"), keep.where(F.col(copies) > 1)
    if again.isEmpty():
        return once
    return once.unionByName(docs.join(again, same).dropDuplicates([own_id, points, sha]).drop(*keep.columns))

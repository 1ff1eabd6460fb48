"""Grading of diagnoses and repairs, judgements, and bug localisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from gradeloom import fixed_values as fv
from gradeloom.functions.similarity import character_ratio, length_bound, token_similarity
from gradeloom.functions.text import extract_code, lines, squash, strip
from gradeloom.operators.curation import inferred_defect
from gradeloom.operators.linediff import changed_lines, diff_texts
from gradeloom.operators.ordered import asof_backward
from gradeloom.operators.similarity import unchanged

#: lines of a file that one group of the interval join holds
SPAN_BUCKET = 1 << 14


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.0))))


def score_diagnoses(tasks: DataFrame, predictions: DataFrame) -> DataFrame:
    """Location .5, judge .3, category .2 for each prediction (task_id, fault_location, bug_category, judge_agreement).

    A location counts when it quotes a changed line, quotes any line of the fix,
    or names the number of a changed line.
    """
    texts = diff_texts(changed_lines(tasks, "task_id"), "task_id")
    df = predictions.join(tasks.select("task_id", "reference_fix"), "task_id").join(texts, "task_id", "left")
    loc = F.coalesce(F.col("fault_location"), F.lit(""))
    quote = strip(loc)
    removed = F.coalesce(F.col("removed_lines"), F.array().cast("array<struct<n:int,text:string>>"))
    touches = F.exists(removed, lambda l: (strip(l.getField("text")) == quote) | l.getField("text").contains(quote)
                       | quote.contains(strip(l.getField("text"))))
    in_fix = F.exists(lines(F.col("reference_fix")), lambda l: strip(l) == quote)
    quoted = (F.length(quote) > 0) & (touches | in_fix)
    number = F.try_to_number(F.nullif(F.regexp_extract(loc, r"(?i)\bline\s*(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int")
    numbered = F.coalesce(F.exists(removed, lambda l: l.getField("n") == number), F.lit(False))
    location = F.when(quoted | numbered, 1.0).otherwise(0.0)
    judge = clip01(F.col("judge_agreement"))
    expected = inferred_defect(F.col("added_text"))
    said = F.lower(F.trim(F.coalesce(F.col("bug_category"), F.lit(""))))
    category = (F.when((said == "") | (said == "none"), 0.0).when(said == expected, 1.0)
                .when(judge >= fv.JUDGE_CATEGORY_FLOOR, 0.5).otherwise(0.0))
    w = fv.DIAGNOSE_WEIGHTS
    total = w["location_match"] * location + w["judge_agreement"] * judge + w["category_match"] * category
    return df.select(*predictions.columns, location.alias("location_match"), judge.alias("judge_score"),
                     category.alias("category_match"), expected.alias("expected_category"), F.round(total, 4).alias("total"))


def score_repairs(answers: DataFrame, tasks: DataFrame) -> DataFrame:
    """total and rank_score of each answer (task_id, candidate, judge_agreement, oracle_score or NULL).

    Returning the input scores 0 whatever the judge says. With an execution
    oracle the weights are judge .5, similarity .3, oracle .2; without, .5/.5.
    """
    keyed = answers.withColumn("_answer", F.sha2(F.coalesce("candidate", F.lit("")), 256))
    # one row per different answer to a task: copies fold before any shuffle, and each measure is taken once
    distinct = keyed.groupBy("task_id", "_answer").agg(F.first(F.coalesce("candidate", F.lit(""))).alias("_text"))
    df = distinct.join(tasks.select("task_id", "buggy", "reference_fix"), "task_id")
    text = F.col("_text")
    df = df.withColumn("_cand", F.when(text.contains("```"), extract_code(text)).otherwise(strip(text)))
    # read several times below, so each is its own column
    df = df.withColumn("_c", squash(F.col("_cand"))).withColumn("_b", squash(F.col("buggy")))
    c, b = F.col("_c"), F.col("_b")
    bound = F.coalesce(length_bound(F.length(c), F.length(b)), F.lit(0.0))
    undecided = (c != b) & (bound >= fv.UNCHANGED_RATIO)
    df = df.withColumn("_ratio", character_ratio(F.when(undecided, c), F.when(undecided, b)))
    ratio = F.when((c == b) & (F.length(c) > 0), 1.0).otherwise(F.col("_ratio"))
    df = df.withColumn("unchanged", unchanged(ratio, F.length(b)))
    same = (F.col("_cand") == F.col("reference_fix")) & (F.length(F.trim("_cand")) > 0)
    open_pair = ~F.col("unchanged") & ~same
    measured = F.when(~F.col("unchanged") & same, 1.0).otherwise(
        token_similarity(F.when(open_pair, F.col("_cand")), F.when(open_pair, F.col("reference_fix"))))
    scored = df.select("task_id", "_answer", "unchanged", F.coalesce(measured, F.lit(0.0)).alias("similarity"))
    df = keyed.join(scored, ["task_id", "_answer"])
    judge, o = clip01(F.col("judge_agreement")), F.col("oracle_score")
    wo, w, wr = fv.REPAIR_ORACLE_WEIGHTS, fv.REPAIR_WEIGHTS, fv.RANK_ORACLE_WEIGHTS
    total = F.when(o.isNotNull(), wo["judge"] * judge + wo["similarity"] * F.col("similarity") + wo["oracle"] * o).otherwise(
        w["judge"] * judge + w["similarity"] * F.col("similarity"))
    rank = F.when(o.isNotNull(), wr["judge"] * judge + wr["oracle"] * o).otherwise(judge)
    zero = lambda c: F.when(F.col("unchanged"), 0.0).otherwise(F.round(c, 4))
    return df.select(*answers.columns, "unchanged", zero(F.col("similarity")).alias("patch_similarity"),
                     zero(total).alias("total"), zero(rank).alias("rank_score"),
                     F.when(o.isNotNull(), "exec_diff").otherwise("none").alias("oracle"))


def regrade(rows: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Stored rows with freshly graded `columns` in place of the old, and how many of them changed."""
    new = fresh.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(new, keys, "left")
    changed = sum((F.coalesce(F.col(f"_new_{c}"), F.col(c)).eqNullSafe(F.col(c)) == False).cast("bigint") for c in columns)  # noqa: E712
    return joined.select(*[c for c in rows.columns if c not in columns],
                         *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) for c in columns], changed.alias("n_changed"))


def judgement_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """One row per distinct request key that has no cached answer. `cache`: request_key, answer."""
    distinct = requests.groupBy("request_key").agg(F.first("task_id").alias("task_id"), F.first("candidate").alias("candidate"))
    return distinct.join(cache.select("request_key"), "request_key", "left_anti")


def answer_requests(requests: DataFrame, cache: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """Requests with their cached or fresh answer; identical requests share one."""
    known = cache.select("request_key", "answer")
    if fresh is not None:
        known = known.unionByName(fresh.select("request_key", "answer"))
    return requests.join(known, "request_key", "left")


def judge(misses: DataFrame, judge_batch: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Answers of a caller-supplied judge, one Arrow batch at a time, clipped to 0..1."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"request_key": batch["request_key"], "answer": judge_batch(batch).astype("float64").clip(0, 1)})
    return misses.mapInPandas(run, "request_key string, answer double")


def changed_positions(changes: DataFrame, key: str) -> DataFrame:
    """Line numbers of the old text that a fix touches; pure insertions count where they go in."""
    plus = changes.filter("sign = '+'").withColumn(
        "n", F.col("n") - F.row_number().over(W.partitionBy(key).orderBy("n")) + 1)
    minus = changes.filter("sign = '-'")
    inserted = plus.join(minus.select(key).distinct(), key, "left_anti")
    return minus.select(key, "n").unionByName(inserted.select(key, "n")).distinct()


def touched_symbols(changes: DataFrame, spans: DataFrame, key: str = "task_id", width: int = SPAN_BUCKET) -> DataFrame:
    """(key, symbol) whose line span [start_line, end_line] overlaps a changed line. `spans` is per key.

    A span is touched if the last changed line up to its end isn't before its start: an as-of join, which gives each
    span one row, however many lines and spans a file has. Lines are cut into buckets of `width`.
    """
    last = asof_backward(spans.select(key, "symbol", "start_line", "end_line"), changed_positions(changes, key), [key], "end_line", "n", [], width=width)
    return last.filter(F.col("n") >= F.col("start_line")).select(key, "symbol").distinct()


def symbol_matches(predictions: DataFrame, truth: DataFrame, key: str = "task_id") -> DataFrame:
    """`identified`: the predicted symbol equals, contains or is part of a true one. An empty prediction never matches."""
    p = F.lower(F.trim(F.coalesce("predicted_symbol", F.lit(""))))
    low = F.lower("symbol")
    hit = (p != "") & (low.contains(p) | p.contains(low))
    ids = [key, "mode", "model"]
    found = predictions.join(truth, key).filter(hit).select(*ids).distinct().withColumn("_hit", F.lit(True))
    return predictions.join(found, ids, "left").withColumn("identified", F.coalesce("_hit", F.lit(False))).drop("_hit")


def localisation_accuracy(identified: DataFrame) -> DataFrame:
    return identified.groupBy("mode", "model").agg(
        F.count_if("identified").alias("k"), F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("identified").cast("int")), 6).alias("rate")).orderBy("mode", "model")

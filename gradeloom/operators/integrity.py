"""Integrity screen: verbatim answers, echoed input, non-answers, judge gaming, file-read leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom import fixed_values as fv
from gradeloom.functions.similarity import token_similarity
from gradeloom.functions.text import has_code, matches
from gradeloom.operators.outcomes import refuses, stored_taint, with_state
from gradeloom.operators.similarity import compare_answers

SIGNALS = ("verbatim_reproduction", "echo_input", "degenerate_output", "judge_gaming", "file_read_leak")


def with_lanes(rows: DataFrame, lanes: DataFrame) -> DataFrame:
    """Add `can_read`: the model's lane can read files. `lanes` is (model, can_read), one row per model."""
    return rows.join(lanes.select("model", F.col("can_read").alias("_read")), "model", "left").withColumn(
        "can_read", F.coalesce("_read", F.lit(False))).drop("_read")


def with_taint(rows: DataFrame, tasks: DataFrame, lanes: DataFrame) -> DataFrame:
    """Add the answer's comparison and `taint`: 'stored', 'file_read_leak' or NULL.

    A stored taint is authoritative; the detector may add one, never clear one.
    """
    return taint_of_compared(compare_answers(rows, tasks, F.col("repair.candidate"), how="left"), lanes)


def taint_of_compared(compared: DataFrame, lanes: DataFrame) -> DataFrame:
    """`with_taint` of rows that were compared with their tasks."""
    rows = with_lanes(compared, lanes)
    leak = F.col("verbatim") & F.col("can_read")
    return rows.withColumn("taint", F.when(stored_taint(rows), "stored").when(leak, "file_read_leak"))


def split_trusted(rows: DataFrame, tasks: DataFrame, lanes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trusted, quarantined): disjoint and exhaustive."""
    labelled = with_taint(rows, tasks, lanes)
    return labelled.filter("taint IS NULL"), labelled.filter("taint IS NOT NULL")


def screen(rows: DataFrame, tasks: DataFrame, lanes: DataFrame) -> DataFrame:
    """Verdict per completed row of a known task: one boolean per signal, `fired`, `cheating`, `severity`."""
    completed = with_state(rows).filter("state = 'completed'")
    compared = with_lanes(compare_answers(completed, tasks, F.col("repair.candidate")), lanes)
    candidate, raw = F.col("repair.candidate"), F.col("repair.raw")
    phrased = matches(raw, fv.JUDGE_DIRECTED_TEXT, ignore_case=True)
    # only replies with judge-directed phrasing need a token comparison
    texts = tasks.select(F.col("task_id").alias("_key"), F.col("reference_fix").alias("_ref"))
    keyed = compared.withColumn("_phrased", phrased).withColumn(
        "_key", F.when(F.col("_phrased"), F.col("task_id"))
        .otherwise(F.concat(F.lit("\u0000"), F.col("ingest_seq").cast("string"))))
    full = keyed.join(texts, "_key", "left")
    low_similarity = F.coalesce(token_similarity(F.when(F.col("_phrased"), candidate), F.col("_ref")), F.lit(0.0)) \
        < fv.GAMING_SIMILARITY
    echo = F.coalesce(F.col("echo_ratio") > fv.ECHO_RATIO, F.lit(False))
    contradicted = F.coalesce(F.col("repair.judge_agreement") == 1.0, F.lit(False)) & echo
    no_code = F.coalesce(~has_code(candidate), F.lit(True))
    fired = {
        "verbatim_reproduction": (F.col("verbatim"), F.lit(3)),
        "echo_input": (echo & (F.col("buggy_len") > fv.VERBATIM_MIN_LEN), F.lit(3)),
        "degenerate_output": (no_code | refuses(raw), F.lit(2)),
        "judge_gaming": ((F.col("_phrased") & low_similarity) | contradicted, F.when(contradicted, 3).otherwise(2)),
        "file_read_leak": (F.col("verbatim") & F.col("can_read"), F.lit(4)),
    }
    flagged = full.select("task_id", "model", "ingest_seq",
                          *[t.alias(s) for s, (t, _) in fired.items()],
                          *[F.when(t, rank).otherwise(0).alias(f"_{s}") for s, (t, rank) in fired.items()])
    names = F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in SIGNALS]))
    rank = F.greatest(*[F.col(f"_{s}") for s in SIGNALS])
    severity = F.get(F.array(*[F.lit(s) for s in fv.SEVERITIES]), rank)
    return flagged.select("task_id", "model", "ingest_seq", *SIGNALS, names.alias("fired"),
                          (rank > 0).alias("cheating"), severity.alias("severity"))


def screen_summary(verdicts: DataFrame) -> DataFrame:
    """Per model: rows, flagged, rate and one count per signal. Flagged tasks stay rows of `verdicts`."""
    return verdicts.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("cheating").alias("flagged"),
        *[F.count_if(s).alias(s) for s in SIGNALS]).withColumn(
        "flag_rate", F.round(F.col("flagged") / F.col("rows"), 4)).orderBy(F.desc("flag_rate"), "model")

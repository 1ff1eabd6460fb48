"""Leaderboards, marks and the decision board over result rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from gradeloom import fixed_values as fv
from gradeloom.functions.text import squash
from gradeloom.operators.integrity import split_trusted, taint_of_compared
from gradeloom.operators.membership import maybe_in
from gradeloom.operators.outcomes import with_state
from gradeloom.operators.resampling import bootstrap
from gradeloom.operators.similarity import answer_digest, compare_answers, compare_digests
from gradeloom.session import cut_lineage

STAGES = ("diagnose", "repair", "repair_given")


def field(df: DataFrame, stage: str, name: str) -> Column:
    """A nested stage field, NULL when the table has no such stage or field."""
    if stage in df.columns and name in df.schema[stage].dataType.fieldNames():
        return F.col(f"{stage}.{name}")
    return F.lit(None)


def metric(name: str) -> Column:
    """`combined`, `diagnosis_uplift` or the total of a stage. NULL stays NULL: unscored is not 0."""
    return F.col(f"{name}.total") if name in STAGES else F.col(name)


def latest_per_task(rows: DataFrame, keys: Iterable[str] = ("model", "task_id"), seq: str = "ingest_seq") -> DataFrame:
    """The newest row per key: max ts (NULL = 0), the later arrival on ties.

    `max_by` aggregates map-side, so a key holding any share of the table is
    reduced before the shuffle. Each column is its own aggregate on the same
    unique order, so columns nobody reads later (long texts) are pruned from
    the shuffle and the scan. `first_seen` keeps the key's first arrival.
    """
    keys = list(keys)
    rest = [c for c in rows.columns if c not in (*keys, "first_seen")]
    order = F.struct(F.coalesce("ts", F.lit(0)).cast("bigint"), F.col(seq))
    seen = F.min("first_seen" if "first_seen" in rows.columns else seq)
    return rows.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest], seen.alias("first_seen"))


def since(rows: DataFrame, ts: int) -> DataFrame:
    return rows.filter(F.coalesce("ts", F.lit(0)) >= ts)


def board_models(rows: DataFrame, allow: Iterable[str] = (), prefixes: Iterable[str] = ()) -> DataFrame:
    """Rows of models named in `allow` or starting with one of `prefixes`."""
    test = F.col("model").isin(*allow) if allow else F.lit(False)
    for prefix in prefixes:
        test = test | F.col("model").startswith(prefix)
    return rows.filter(test)


def leaderboard(rows: DataFrame, name: str = "combined", **resampling) -> DataFrame:
    """Per model: mean with interval, solved, partial, missed, errors; best first."""
    v = metric(name)
    errored = F.lit(False)
    for stage in STAGES:
        errored = errored | (F.length(F.coalesce(field(rows, stage, "error").cast("string"), F.lit(""))) > 0)
    scored = rows.select("model", "task_id", F.col("ingest_seq"), v.cast("double").alias("v"),
                         (errored & F.col("combined").isNotNull()).alias("err")).filter("v IS NOT NULL")
    scored = cut_lineage(scored)
    counts = scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("tasks"), F.avg("v").alias("score"),
        F.count_if(F.col("v") >= fv.SOLVED_AT).alias("solved"),
        F.count_if((F.col("v") >= fv.MISSED_AT) & (F.col("v") < fv.SOLVED_AT)).alias("partial"),
        F.count_if(F.col("v") <= fv.MISSED_AT).alias("missed"), F.count_if("err").alias("errors"))
    ci = bootstrap(scored, ["model"], "v", "ingest_seq", materialize=False, **resampling).select("model", "lo", "hi")
    return counts.join(ci, "model").select(
        "model", F.lit(name).alias("metric"), "tasks", F.round("score", 4).alias("score"),
        F.round("lo", 4).alias("ci95_lo"), F.round("hi", 4).alias("ci95_hi"), "solved", "partial", "missed",
        "errors", F.round(F.col("errors") / F.col("tasks"), 3).alias("error_rate"),
    ).orderBy(F.desc("score"), F.desc("tasks"), "model")


def category_breakdown(rows: DataFrame, **resampling) -> DataFrame:
    scored = rows.select("model", F.coalesce("category", F.lit("unclassified")).alias("category"),
                         "ingest_seq", F.col("combined").cast("double").alias("v"))
    return bootstrap(scored, ["model", "category"], "v", "ingest_seq", **resampling).select(
        "model", "category", "n", F.round("point", 4).alias("score"),
        F.round("lo", 4).alias("ci95_lo"), F.round("hi", 4).alias("ci95_hi")).orderBy("model", F.desc("score"), "category")


def sub_signals(rows: DataFrame) -> DataFrame:
    """Mean and count of every raw signal per model, one wide row each."""
    aggs = []
    for stage, key in fv.SUB_SIGNALS:
        v = field(rows, stage, key).cast("double")
        aggs += [F.round(F.avg(v), 4).alias(f"{stage}_{key}"), F.count(v).alias(f"{stage}_{key}_n")]
    return rows.groupBy("model").agg(*aggs).orderBy("model")


def per_task(rows: DataFrame) -> DataFrame:
    return rows.select(
        "model", "task_id", "language", "category", field(rows, "diagnose", "total").alias("diagnose"),
        field(rows, "repair", "total").alias("repair"),
        field(rows, "repair", "patch_reproduction").alias("patch_reproduction"), "combined").orderBy("task_id", "model")


def oracle_coverage(rows: DataFrame) -> DataFrame:
    with_oracle = F.count_if(F.coalesce(F.col("repair.oracle") == "exec_diff", F.lit(False)))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("task_id").alias("tasks"),
        F.countDistinct("model").alias("models"), with_oracle.alias("with_oracle"),
        F.count(F.col("repair.judge_agreement")).alias("judge_scored")).withColumn(
        "oracle_rate", F.coalesce(F.round(F.col("with_oracle") / F.nullif("rows", F.lit(0)), 4), F.lit(0.0)))


def recompose(rows: DataFrame) -> DataFrame:
    """combined and uplift from the stage totals; NULL when a stage is missing."""
    d, r, g = F.col("diagnose.total"), F.col("repair.total"), F.col("repair_given.total")
    return rows.withColumn("combined", F.round(0.5 * d + 0.5 * r, 4)).withColumn("diagnosis_uplift", F.round(g - d, 4))


def wilson(k: Column, n: Column, z: float = fv.WILSON_Z) -> tuple[Column, Column]:
    """Wilson score interval of k of n as fractions; (0, 0) without trials."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / m
    d = 1.0 + z * z / m
    centre = (p + z * z / (2 * m)) / d
    half = (z / d) * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    # greatest and least skip NULL, so the empty case is named
    tried = n > 0
    return (F.when(tried, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0),
            F.when(tried, F.least(F.lit(1.0), centre + half)).otherwise(0.0))


def utility(capability: Column, completed: Column, attempted: Column) -> Column:
    """Capability times availability; 0 when nothing was attempted."""
    return F.coalesce(F.round(capability * (completed / F.nullif(attempted.cast("double"), F.lit(0.0))), 1), F.lit(0.0))


def median_int(x: Column) -> Column:
    """Integer median; an even count rounds the midpoint half to even."""
    return F.bround(F.percentile(x, 0.5)).cast("bigint")


def marks(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """found, fixed, same, equivalent, untouched per row of a known task. Unscored rows get NULL scores."""
    return _mark(compare_answers(with_state(rows), tasks, F.col("repair.candidate")))


def _mark(compared: DataFrame, *keep: str) -> DataFrame:
    loc = F.coalesce(F.col("diagnose.location_match"), F.lit(0.0))
    mech = F.coalesce(F.col("diagnose.judge_agreement"), F.lit(0.0))
    scored = F.col("state") == "completed"
    flag = lambda test: scored & F.coalesce(test, F.lit(False))
    pct = lambda c: F.when(scored, F.round(100.0 * F.coalesce(c, F.lit(0.0)), 1))
    return compared.select(
        "task_id", "model", "ingest_seq", "state", scored.alias("scored"),
        flag(((loc >= 1.0) & (mech >= 0.5)) | ((loc + mech) / 2 >= fv.FOUND_THRESHOLD)).alias("bug_found"),
        flag(F.col("repair.judge_agreement") >= fv.FIXED_THRESHOLD).alias("bug_fixed"),
        flag(F.col("verbatim")).alias("same_fix"),
        flag(F.col("repair.patch_reproduction") >= fv.EQUIVALENT_THRESHOLD).alias("equiv_fix"),
        flag((F.col("echo_ratio") >= fv.UNTOUCHED_THRESHOLD) & (F.col("buggy_len") > 40)).alias("untouched"),
        pct(F.col("combined")).alias("score_pct"), pct(F.col("diagnose.total")).alias("diagnose_pct"),
        pct(F.col("repair.total")).alias("repair_pct"),
        F.coalesce(F.nullif(F.col("repair.latency_ms"), F.lit(0)), F.col("diagnose.latency_ms")).alias("latency_ms"),
        "known_task", *keep)


def common_tasks(rows: DataFrame, min_models: int = 2) -> DataFrame:
    """Tasks tried by at least `min_models` models."""
    return rows.groupBy("task_id").agg(F.countDistinct("model").alias("models")).filter(F.col("models") >= min_models)


def of_total(k: Column, n: Column) -> Column:
    share = F.coalesce(F.round(100.0 * k / F.nullif(n.cast("double"), F.lit(0.0)), 1), F.lit(0.0))
    return F.concat(k.cast("string"), F.lit("/"), n.cast("string"), F.lit(" ("), F.format_string("%.1f", share), F.lit("%)"))


def marks_board(rows: DataFrame, tasks: DataFrame, lanes: DataFrame, restrict_to: DataFrame | None = None,
                **resampling) -> DataFrame:
    """N of M board on trusted, completed rows; M is the common task set when one is given."""
    trusted, _ = split_trusted(with_state(rows), tasks, lanes)
    if restrict_to is not None:
        trusted = trusted.join(restrict_to.select("task_id").distinct(), "task_id", "left_semi")
    m = cut_lineage(_mark(trusted).filter("scored AND known_task"))
    counts = m.groupBy("model").agg(
        F.count(F.lit(1)).alias("attempted"),
        *[F.count_if(c).alias(o) for c, o in (("bug_found", "bugs_found"), ("bug_fixed", "bugs_fixed"),
                                              ("same_fix", "same_fix"), ("equiv_fix", "equiv_fix"),
                                              ("untouched", "untouched"))],
        F.round(F.avg("score_pct"), 1).alias("score_pct"), F.round(F.avg("diagnose_pct"), 1).alias("diagnose_pct"),
        F.round(F.avg("repair_pct"), 1).alias("repair_pct"))
    ci = bootstrap(m, ["model"], "score_pct", "ingest_seq", materialize=False, **resampling).select(
        "model", F.round("lo", 4).alias("ci95_lo"), F.round("hi", 4).alias("ci95_hi"))
    board = counts.join(ci, "model")
    if restrict_to is not None:
        # one number: the size of the common set
        board = board.withColumn("tasks", F.lit(restrict_to.select("task_id").distinct().count()))
    else:
        board = board.withColumn("tasks", F.col("attempted"))
    named = [of_total(F.col(c), F.col("tasks")).alias(f"{c}_of") for c in ("bugs_found", "bugs_fixed")]
    return board.select("*", *named).orderBy(F.desc("score_pct"), F.desc("tasks"), "model")


def min_coverage_for(panel: int) -> int:
    return min(fv.DEFAULT_MIN_COVERAGE, max(1, round(panel * fv.MIN_COVERAGE_RATIO)))


def decision_board(rows: DataFrame, tasks: DataFrame, lanes: DataFrame, panel: int = 20,
                   min_coverage: int | None = None, show_exhausted: bool = False,
                   latest_only: bool = True) -> DataFrame:
    """Model-selection board: capability, availability, coverage, utility, status, interval.

    Each model is scored on its own completed tasks; quarantined rows are out.
    A model that never answered is "unavailable", not a 0% model.
    """
    rows = latest_per_task(rows) if latest_only else rows.withColumn("first_seen", F.col("ingest_seq"))
    trusted, _ = split_trusted(with_state(rows), tasks, lanes)
    return board_of_marks(_mark(trusted, "first_seen", "error_class"), panel, min_coverage, show_exhausted)


def decision_marks(rows: DataFrame, tasks: DataFrame, lanes: DataFrame,
                   keep: Callable[[DataFrame, str], DataFrame] = lambda step, name: cut_lineage(step)) -> DataFrame:
    """What the board needs of the newest row per (model, task), without its texts; `taint` marks the quarantined ones.

    Answers stay where they are read, so no shuffle, sort or store holds them; `rows` is read three times. First only for
    each task's newest time. Then the rows of that time become state, numbers and digest, of which the newest meets the
    task digests. Last for the texts of the rows that this leaves open. `keep` stores the narrow rows of a step.
    """
    stamp = F.coalesce("ts", F.lit(0)).cast("bigint")
    newest = keep(rows.groupBy("model", "task_id").agg(F.max(stamp).alias("ts"), F.min("ingest_seq").alias("first_seen")), "newest")
    of_time = lambda times: maybe_in(rows, ["model", "task_id", stamp], times.select("model", "task_id", stamp.alias("ts")))
    norm = squash(F.col("repair.candidate"))
    described = with_state(of_time(newest)).withColumn("_norm", norm).select(
        "model", "task_id", "ts", "ingest_seq", F.struct(
            "state", "error_class", "combined", *[c for c in ("tainted", "taint_reason") if c in rows.columns],
            F.struct(*[f"diagnose.{c}" for c in ("total", "location_match", "judge_agreement", "latency_ms")]).alias("diagnose"),
            F.struct(*[f"repair.{c}" for c in ("total", "patch_reproduction", "judge_agreement", "latency_ms")]).alias("repair"),
            answer_digest(F.col("_norm")).alias("answer")).alias("row"))
    first = newest.select(F.col("model").alias("_model"), F.col("task_id").alias("_task"), "first_seen")
    latest = latest_per_task(described).drop("first_seen").join(
        first, F.col("model").eqNullSafe(F.col("_model")) & F.col("task_id").eqNullSafe(F.col("_task"))).select(
        "model", "task_id", "ts", "ingest_seq", "first_seen", "row.*")

    def texts(undecided):
        read = of_time(undecided).select(norm.alias("norm")).withColumn("sha", F.sha2("norm", 256))
        return maybe_in(read, ["sha"], undecided.select("answer.sha")).groupBy("sha").agg(F.first("norm").alias("norm"))

    tried = maybe_in(tasks, ["task_id"], newest.select("task_id"))
    compared = compare_digests(latest, tried, texts, keep, how="left")
    return _mark(taint_of_compared(compared, lanes), "ts", "first_seen", "error_class", "taint")


def board_of_marks(scored: DataFrame, panel: int = 20, min_coverage: int | None = None, show_exhausted: bool = False) -> DataFrame:
    """The decision board of marked, trusted rows, one per (model, task)."""
    floor = min_coverage_for(panel) if min_coverage is None else min_coverage
    done = F.col("state") == "completed"
    known = done & F.col("known_task")
    agg = scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(done).alias("completed"),
        F.round(F.avg(F.when(known, F.col("score_pct"))), 1).alias("capability"),
        F.count_if(known & F.col("bug_found")).alias("bugs_found"),
        F.count_if(known & F.col("bug_fixed")).alias("bugs_fixed"),
        median_int(F.when(known & (F.col("latency_ms") > 0), F.col("latency_ms"))).alias("median_latency_ms"),
        F.min_by(F.when(F.col("state") == "infra_error", F.col("error_class")),
                 F.when(F.col("state") == "infra_error", F.col("first_seen"))).alias("_err"))
    n, k = F.col("completed"), F.col("bugs_fixed")
    lo, hi = wilson(k, n)
    status = F.when(n == 0, "unavailable").when(n < floor, "insufficient_coverage").otherwise("ok")
    reason = (F.when(n == 0, F.when(F.col("_err").isNull(), "no usable answers").when(
        F.col("_err.retryable"), F.concat(F.col("_err.kind"), F.lit(" (retryable)")))
        .otherwise(F.concat(F.col("_err.kind"), F.lit(" (do not retry)"))))
        .when(n < floor, F.concat(F.lit("only "), n.cast("string"), F.lit(f"/{panel} tasks completed"))).otherwise(""))
    has = F.col("capability").isNotNull()
    board = agg.select(
        "model", status.alias("status"), reason.alias("reason"), "completed", "attempted",
        F.least(F.lit(100.0), F.round(100.0 * n / panel, 1)).alias("coverage_pct"),
        F.round(100.0 * n / F.col("attempted"), 1).alias("availability_pct"), "capability",
        F.coalesce(utility(F.col("capability"), n, F.col("attempted")), F.lit(0.0)).alias("utility"),
        "bugs_found", "bugs_fixed", of_total(F.col("bugs_found"), n).alias("found_of"),
        of_total(k, n).alias("fixed_of"), "median_latency_ms", (status == "ok").alias("ranking_eligible"),
        F.when(has, F.round(k / F.nullif(n.cast("double"), F.lit(0.0)), 4)).alias("success_rate"),
        F.when(has, F.round(lo * 100, 1)).alias("ci95_lo"), F.when(has, F.round(hi * 100, 1)).alias("ci95_hi"))
    if not show_exhausted:
        board = board.filter("status <> 'unavailable'")
    return board.orderBy(F.desc("ranking_eligible"), F.desc("utility"), F.desc_nulls_last("capability"), "model")


def leader_ties(board: DataFrame) -> DataFrame:
    """The leader against every other eligible model: does its interval overlap?"""
    order = W.orderBy(F.desc("utility"), F.desc("capability"), "model")
    ranked = board.filter("ranking_eligible").select(
        "model", "utility", "capability", "ci95_lo", "ci95_hi", F.row_number().over(order).alias("board_rank"),
        F.first("model").over(order).alias("leader"), F.first("ci95_lo").over(order).alias("_lo"),
        F.first("ci95_hi").over(order).alias("_hi"))
    overlap = ~((F.col("_hi") < F.col("ci95_lo")) | (F.col("ci95_hi") < F.col("_lo")))
    rivals = ranked.withColumn("overlaps", F.coalesce(overlap, F.lit(False)))
    everyone = W.partitionBy()
    tied = F.count_if((F.col("board_rank") > 1) & F.col("overlaps")).over(everyone)
    others = F.count_if(F.col("board_rank") > 1).over(everyone)
    return rivals.select("board_rank", "model", "leader", "overlaps", ((others > 0) & (tied == others)).alias("is_tie"))


def campaign_summary(attempts: DataFrame) -> DataFrame:
    """Per model: bugs fixed of total, files cleared, outcome mix, latency."""
    outcomes = ("scored", "declined_work", "invalid_response", "refused", "needs_tools", "transport", "policy_violation")
    return attempts.groupBy("model").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("bugs_fixed").alias("bugs_fixed"), F.sum("bugs_total").alias("bugs_total"),
        F.count_if("file_clear").alias("files_cleared"), F.round(F.avg("per_bug_score"), 6).alias("mean_score"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in outcomes],
        F.round(F.percentile("latency_s", 0.5), 3).alias("median_latency_s")).orderBy("model")


def top_up(tasks: DataFrame, rows: DataFrame, model: str) -> DataFrame:
    """Tasks in scope that `model` has not tried."""
    tried = rows.filter(F.col("model") == model).select("task_id")
    return tasks.join(tried, "task_id", "left_anti")


def remaining_to_target(rows: DataFrame, target: int) -> DataFrame:
    """Per model: distinct tasks tried, and how many more reach `target`."""
    return rows.groupBy("model").agg(F.countDistinct("task_id").alias("done")).withColumn(
        "remaining", F.greatest(F.lit(0), F.lit(target) - F.col("done")).cast("bigint"))


def retry_failed(tasks: DataFrame, retryable: DataFrame, model: str) -> DataFrame:
    """Tasks whose failure for `model` another attempt can fix (see outcomes.retryable_rows)."""
    return tasks.join(retryable.filter(F.col("model") == model).select("task_id"), "task_id", "left_semi")


def manifest_problems(rows: DataFrame, manifest_hash: str) -> DataFrame:
    """Rows stamped with another manifest, counted by their hash; empty means the rows may be scored."""
    return rows.filter(~F.col("manifest_hash").eqNullSafe(F.lit(manifest_hash))).groupBy("manifest_hash").agg(
        F.count(F.lit(1)).alias("rows"))

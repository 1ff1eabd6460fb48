"""Per-bug scores, validation gates and repeat stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom import fixed_values as fv


def last_outcomes(rows: DataFrame, keys: list[str], seq: str = "ingest_seq") -> DataFrame:
    """One outcome per key and node: the last one reported wins."""
    return rows.groupBy(*keys, "nodeid").agg(F.max_by("outcome", seq).alias("outcome"))


def score_bugs(bug_map: DataFrame, rows: DataFrame) -> DataFrame:
    """Per bug: passed, errored, value. A missing test scores 0 and is flagged, never dropped.

    `bug_map`: task_id, bug_id, test_node; `rows`: task_id, nodeid, outcome, ingest_seq.
    """
    seen = last_outcomes(rows, ["task_id"]).withColumnRenamed("nodeid", "test_node")
    joined = bug_map.join(seen, ["task_id", "test_node"], "left")
    passed = F.coalesce(F.col("outcome") == "passed", F.lit(False))
    errored = F.col("outcome").isNull() | F.col("outcome").isin("failed", "error")
    return joined.select("task_id", "bug_id", "test_node", passed.alias("passed"), errored.alias("errored"),
                         (passed & ~errored).cast("double").alias("value"))


def file_scores(bugs: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Per task: bugs_total, bugs_fixed, per_bug_score, file_clear. A task without bugs scores 0 and is not clear."""
    out = bugs.groupBy("task_id").agg(F.count(F.lit(1)).alias("bugs_total"), F.count_if(F.col("value") == 1).alias("bugs_fixed"))
    if tasks is not None:
        out = tasks.select("task_id").distinct().join(out, "task_id", "left").fillna(0, ["bugs_total", "bugs_fixed"])
    total = F.nullif(F.col("bugs_total").cast("double"), F.lit(0.0))
    return out.withColumn("per_bug_score", F.coalesce(F.round(F.col("bugs_fixed") / total, 6), F.lit(0.0))).withColumn(
        "file_clear", (F.col("bugs_total") > 0) & (F.col("bugs_fixed") == F.col("bugs_total")))


def flipped_tests(rows: DataFrame, task: str = "task_id") -> DataFrame:
    """Tests not passed before and passed after, first node per task. Rows carry state 'buggy' or 'fixed'."""
    pick = lambda s: F.max_by(F.when(F.col("state") == s, F.col("outcome")), F.when(F.col("state") == s, F.col("ingest_seq")))
    both = rows.groupBy(task, "nodeid").agg(
        pick("buggy").alias("before"), pick("fixed").alias("after"),
        F.min(F.when(F.col("state") == "fixed", F.col("ingest_seq"))).alias("at"))
    flips = both.filter((F.col("before") != "passed") & (F.col("after") == "passed"))
    return flips.groupBy(task).agg(F.min_by("nodeid", "at").alias("test_node"), F.count(F.lit(1)).alias("n_flipped"))


def gate_failures(files: DataFrame) -> DataFrame:
    """Rows of `files` (task_id, known = 'good'/'bad', bugs_fixed, bugs_total) that break their promise."""
    good = (F.col("known") == "good") & (F.col("bugs_fixed") != F.col("bugs_total"))
    bad = (F.col("known") == "bad") & (F.col("bugs_fixed") > 0)
    return files.filter(good | bad).select(
        "task_id", "known", F.when(good, "known-good not fully fixed").otherwise("known-bad earned credit").alias("failure"))


def oracle_gate(files: DataFrame) -> DataFrame:
    """One row: passed, failures, monotone and the two means. No known-bad file may beat a known-good one."""
    score = F.coalesce(F.col("bugs_fixed") / F.nullif(F.col("bugs_total").cast("double"), F.lit(0.0)), F.lit(0.0))
    good, bad = F.col("known") == "good", F.col("known") == "bad"
    agg = files.withColumn("s", score).agg(
        F.count_if(good).alias("good_files"), F.count_if(bad).alias("bad_files"),
        F.count_if(good & (F.col("bugs_fixed") != F.col("bugs_total"))).alias("good_failures"),
        F.count_if(bad & (F.col("bugs_fixed") > 0)).alias("bad_failures"),
        F.round(F.avg(F.when(good, F.col("s"))), 6).alias("good_mean"), F.round(F.avg(F.when(bad, F.col("s"))), 6).alias("bad_mean"),
        F.min(F.when(good, F.col("s"))).alias("_worst"), F.max(F.when(bad, F.col("s"))).alias("_best"))
    monotone = F.coalesce(F.col("_worst") >= F.col("_best"), F.lit(True))
    return agg.withColumn("monotone", monotone).withColumn(
        "passed", monotone & (F.col("good_failures") == 0) & (F.col("bad_failures") == 0)).drop("_worst", "_best")


def noise_cells(trials: DataFrame, min_repeats: int = fv.NOISE_MIN_REPEATS) -> DataFrame:
    """Per (task, state): repeats, spread, and the failure if there is one.

    "All equal" is min = max, so a cell of any size is a constant-size aggregate.
    """
    score = F.coalesce(F.col("passed") / F.nullif(F.col("total").cast("double"), F.lit(0.0)), F.lit(0.0))
    digest = F.when(F.length("feedback") > 0, F.substring(F.sha2("feedback", 256), 1, 12))
    cells = trials.withColumn("s", score).withColumn("d", digest).groupBy("task_id", "state").agg(
        F.count(F.lit(1)).alias("repeats"), F.min(F.round("s", 9)).alias("lo"), F.max(F.round("s", 9)).alias("hi"),
        F.min("d").alias("d0"), F.max("d").alias("d1"), (F.max("s") - F.min("s")).alias("spread"))
    failure = (F.when(F.col("repeats") < min_repeats, "too few repeats").when(F.col("lo") != F.col("hi"), "scores varied")
               .when(F.col("d0") != F.col("d1"), "feedback varied"))
    return cells.select("task_id", "state", "repeats", F.round("spread", 9).alias("spread"), failure.alias("failure"))


def noise_floor(trials: DataFrame, min_repeats: int = fv.NOISE_MIN_REPEATS) -> DataFrame:
    """One row over all cells; no trials at all is a failure."""
    cells = noise_cells(trials, min_repeats)
    return cells.agg(
        F.coalesce(F.sum("repeats"), F.lit(0)).alias("trials"), F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("repeats") >= min_repeats).alias("cells_measured"),
        F.count_if(F.col("failure").isin("scores varied", "feedback varied")).alias("unstable"),
        F.count("failure").alias("failures"), F.coalesce(F.max("spread"), F.lit(0.0)).alias("max_within_cell_spread")).withColumn(
        "passed", (F.col("failures") == 0) & (F.col("trials") > 0))


def reduce_repeats(trials: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Most frequent value per key, ties to the larger; `majority` and `unanimous` say how firm it is."""
    counts = trials.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(
        F.max_by(value, F.struct("n", value)).alias("score"), F.sum("n").alias("repeats"),
        (F.max("n") * 2 > F.sum("n")).alias("majority"), (F.count(F.lit(1)) == 1).alias("unanimous"))


def attribution(trials: DataFrame) -> DataFrame:
    """Per combined task: can each bug be credited on its own?

    `trials`: task_id, state ('all_present', 'all_fixed', 'fix_<bug>'), bug_id, passed.
    """
    target = F.col("state") == F.concat(F.lit("fix_"), F.col("bug_id").cast("string"))
    runs = trials.groupBy("task_id", "state").agg(
        F.count(F.lit(1)).alias("bugs"), F.count_if("passed").alias("green"), F.count_if(target & F.col("passed")).alias("target"))
    present, fixed = F.col("state") == "all_present", F.col("state") == "all_fixed"
    single = ~present & ~fixed
    per = runs.groupBy("task_id").agg(
        F.max("bugs").alias("bugs"), F.coalesce(F.max(F.when(present, F.col("bugs") - F.col("green"))), F.lit(0)).alias("present_failing"),
        F.coalesce(F.max(F.when(fixed, F.col("green"))), F.lit(0)).alias("fixed_passing"),
        F.count_if(single & (F.col("target") == 1) & (F.col("green") == 1)).alias("isolated"),
        F.count_if(single & (F.col("target") == 1) & (F.col("green") > 1)).alias("entangled"))
    reason = (F.when(F.col("present_failing") != F.col("bugs"), "not every bug fails when all are present")
              .when(F.col("fixed_passing") != F.col("bugs"), "not every bug passes on the fixed source")
              .when(F.col("entangled") > 0, "one fix turns another bug green").otherwise(""))
    return per.withColumn("reason", reason).withColumn("ok", reason == "")


def render_failures(rows: DataFrame, lines_per_page: int = 10_000, label: str = "") -> DataFrame:
    """Failures per task as text: task_id, page, text. Pages in order are the whole text.

    A page covers `lines_per_page` consecutive values of `ingest_seq`, so a task
    of any size never becomes one value. The last page closes with the totals.
    """
    totals = rows.groupBy("task_id").agg(
        F.count_if(F.col("outcome").isin("failed", "error")).alias("failed"), F.count(F.lit(1)).alias("executed"),
        F.max(F.floor(F.col("ingest_seq") / lines_per_page)).alias("_last"),
        F.min(F.floor(F.col("ingest_seq") / lines_per_page)).alias("_first")).filter("failed > 0")
    kind = F.when(F.col("outcome") == "failed", "Failure").otherwise("Error")
    failures = rows.filter(F.col("outcome").isin("failed", "error")).select(
        "task_id", F.floor(F.col("ingest_seq") / lines_per_page).alias("page"), "ingest_seq",
        F.concat(F.lit("FAILED "), "nodeid", F.lit(" ["), kind, F.lit("]")).alias("line"))
    closing = totals.select("task_id", F.col("_last").alias("page"), F.lit(1 << 62).alias("ingest_seq"), F.concat(
        F.lit("--- "), F.col("failed").cast("string"), F.lit(" failed / "), F.col("executed").cast("string"),
        F.lit(" executed ---")).alias("line"))
    all_lines = failures.unionByName(closing)
    if label:
        all_lines = all_lines.unionByName(totals.select(
            "task_id", F.col("_first").alias("page"), F.lit(-1).cast("bigint").alias("ingest_seq"), F.lit(f"# {label}").alias("line")))
    return all_lines.groupBy("task_id", "page").agg(F.concat(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("ingest_seq", "line"))), lambda x: x.getField("line")), "\n"), F.lit("\n")).alias("text"))

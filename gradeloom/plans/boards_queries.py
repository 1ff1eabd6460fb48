"""Boards, outcomes and integrity queries over the `runs` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom import fixed_values as fv
from gradeloom.operators import boards, integrity, outcomes
from gradeloom.operators.membership import maybe_in
from gradeloom.operators.resampling import bootstrap
from gradeloom.plans import sqltext
from gradeloom.plans.registry import query
from gradeloom.plans.staging import fresh_path
from gradeloom.plans.views import answered_runs, lanes, runs, tasks, with_views
from gradeloom.schemas import RESULT
from gradeloom.session import shuffles_cleaned
from gradeloom.streaming.live_board import LiveDecisionBoard, result_stream

R, SEED = fv.BOARD_REPLICATES, fv.BOARD_SEED


def latest(spark, sf):
    return boards.latest_per_task(runs(spark, sf))


@query("latest_per_task", with_views("latest", body="""
SELECT model, task_id, ts, ingest_seq, round(combined, 6) AS combined, state FROM latest"""))
def latest_query(spark, sf):
    return outcomes.with_state(latest(spark, sf)).select(
        "model", "task_id", "ts", "ingest_seq", F.round("combined", 6).alias("combined"), "state")


BOARD_SQL = """
SELECT a.model, '{name}' AS metric, a.tasks, round(c.point, 4) AS score, round(c.lo, 4) AS ci95_lo,
  round(c.hi, 4) AS ci95_hi, a.solved, a.partial, a.missed, a.errors, round(a.errors / a.tasks, 3) AS error_rate
FROM (SELECT model, count(*) AS tasks, count(*) FILTER (WHERE v >= 0.999) AS solved, count(*) FILTER (WHERE v >= 0.001 AND v < 0.999) AS partial,
  count(*) FILTER (WHERE v <= 0.001) AS missed, count(*) FILTER (WHERE stage_error <> '') AS errors
  FROM src GROUP BY model) a JOIN b_ci c USING (model)"""


def board_sql(value, name):
    return with_views("latest", body="WITH src AS (SELECT *, " + value + " AS v FROM latest),"
                      + sqltext.bootstrap("b", "src", "model", "v", "ingest_seq", R, SEED) + BOARD_SQL.format(name=name))


for _name, _value in (("combined", "combined"), ("diagnose", "diag_total"), ("repair", "repair_total"),
                      ("repair_given", "given_total"), ("diagnosis_uplift", "diagnosis_uplift")):
    query(f"leaderboard_{_name}", board_sql(_value, _name))(
        lambda spark, sf, name=_name: boards.leaderboard(latest(spark, sf), name))


@query("category_breakdown", with_views("latest", body="WITH " + sqltext.bootstrap(
    "b", "latest", "model, category", "combined", "ingest_seq", R, SEED).strip() + """
SELECT model, category, n, round(point, 4) AS score, round(lo, 4) AS ci95_lo, round(hi, 4) AS ci95_hi FROM b_ci"""))
def category_breakdown(spark, sf):
    return boards.category_breakdown(latest(spark, sf))


@query("bootstrap_every_attempt", with_views("runs", body="WITH " + sqltext.bootstrap(
    "b", "runs", "model", "combined", "ingest_seq", R, SEED).strip() + """
SELECT model, n, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b_ci"""))
def bootstrap_every_attempt(spark, sf):
    """The large-group scheme, over every attempt instead of the latest ones."""
    return bootstrap(runs(spark, sf), ["model"], "combined", "ingest_seq", replicates=R).select(
        "model", "n", *[F.round(c, 6).alias(c) for c in ("point", "lo", "hi")])


_SIGNAL_COLUMNS = {("diagnose", "total"): "diag_total", ("diagnose", "location_match"): "diag_location",
                   ("diagnose", "judge_agreement"): "diag_judge", ("diagnose", "category_match"): "diag_category",
                   ("repair", "total"): "repair_total", ("repair", "patch_reproduction"): "repair_repro",
                   ("repair", "judge_agreement"): "repair_judge", ("repair", "oracle_score"): "oracle_score"}


@query("sub_signals", with_views("latest", body="SELECT model, " + ", ".join(
    f"round(avg({c}), 4) AS {s}_{k}, count({c}) AS {s}_{k}_n" for (s, k), c in _SIGNAL_COLUMNS.items())
    + " FROM latest GROUP BY model"))
def sub_signals(spark, sf):
    return boards.sub_signals(latest(spark, sf))


@query("per_task_scores", with_views("latest", body="""
SELECT model, task_id, language, category, round(diag_total, 6) AS diagnose, round(repair_total, 6) AS repair,
  round(repair_repro, 6) AS patch_reproduction, round(combined, 6) AS combined FROM latest"""))
def per_task(spark, sf):
    return boards.per_task(latest(spark, sf)).select(
        "model", "task_id", "language", "category",
        *[F.round(c, 6).alias(c) for c in ("diagnose", "repair", "patch_reproduction", "combined")])


@query("oracle_coverage", with_views("runs", body="""
SELECT count(*) AS rows, count(DISTINCT task_id) AS tasks, count(DISTINCT model) AS models,
  count(*) FILTER (WHERE oracle = 'exec_diff') AS with_oracle, count(repair_judge) AS judge_scored,
  round(count(*) FILTER (WHERE oracle = 'exec_diff') / count(*), 4) AS oracle_rate FROM runs"""))
def oracle_coverage(spark, sf):
    return boards.oracle_coverage(runs(spark, sf))


@query("recomposed_scores", with_views("runs", body="""
SELECT model, count(*) FILTER (WHERE round(0.5 * diag_total + 0.5 * repair_total, 4) <> round(combined, 4)) AS changed,
  round(avg(round(0.5 * diag_total + 0.5 * repair_total, 4)), 4) AS combined,
  round(avg(round(given_total - diag_total, 4)), 4) AS uplift FROM runs GROUP BY model"""))
def recomposed(spark, sf):
    r = runs(spark, sf)
    again = boards.recompose(r.withColumn("_old", F.col("combined")))
    return again.groupBy("model").agg(
        F.count_if(F.col("combined") != F.round("_old", 4)).alias("changed"),
        F.round(F.avg("combined"), 4).alias("combined"), F.round(F.avg("diagnosis_uplift"), 4).alias("uplift"))


@query("error_classes", with_views("states", body="""
SELECT error_kind AS kind, error_kind IN ('rate_limited', 'timeout') AS retryable, count(*) AS n
FROM states WHERE error_kind IS NOT NULL AND diagnose_error <> '' GROUP BY ALL"""))
def error_classes(spark, sf):
    c = outcomes.classify_error(F.col("diagnose_error"))
    return runs(spark, sf).select(c.alias("c")).filter("c IS NOT NULL").groupBy(
        F.col("c.kind").alias("kind"), F.col("c.retryable").alias("retryable")).agg(F.count(F.lit(1)).alias("n"))


@query("outcome_states", with_views("states", body="SELECT model, state, count(*) AS n FROM states GROUP BY ALL"))
def outcome_states(spark, sf):
    return outcomes.with_state(runs(spark, sf)).groupBy("model", "state").agg(F.count(F.lit(1)).alias("n"))


@query("results_of_known_tasks", with_views("runs", "tasks", body="""
SELECT t.language, count(*) AS n, round(sum(r.combined), 4) AS combined FROM runs r JOIN tasks t USING (task_id)
GROUP BY t.language"""))
def results_of_known_tasks(spark, sf):
    known = runs(spark, sf).drop("language").join(tasks(spark, sf).select("task_id", "language"), "task_id")
    return known.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("combined"), 4).alias("combined"))


@query("top_up_tasks", with_views("runs", "tasks", body="""
SELECT task_id FROM tasks WHERE task_id NOT IN (SELECT task_id FROM runs WHERE model = 'click')"""))
def top_up_tasks(spark, sf):
    return boards.top_up(tasks(spark, sf).select("task_id"), runs(spark, sf), "click")


@query("remaining_to_target", with_views("runs", body="""
SELECT model, count(DISTINCT task_id) AS done, greatest(0, 150 - count(DISTINCT task_id))::BIGINT AS remaining
FROM runs GROUP BY model"""))
def remaining_to_target(spark, sf):
    return boards.remaining_to_target(runs(spark, sf), 150)


@query("retry_tasks", with_views("latest", "tasks", body="""
SELECT task_id FROM tasks WHERE task_id IN (SELECT task_id FROM latest WHERE model = 'view' AND state = 'infra_error'
  AND error_kind IN ('rate_limited', 'timeout'))"""))
def retry_tasks(spark, sf):
    return boards.retry_failed(tasks(spark, sf).select("task_id"), outcomes.retryable_rows(latest(spark, sf)), "view")


@query("manifest_guard", with_views("runs", body="""
SELECT manifest_hash, count(*) AS rows FROM runs WHERE manifest_hash IS DISTINCT FROM 'm1' GROUP BY manifest_hash"""))
def manifest_guard(spark, sf):
    return boards.manifest_problems(runs(spark, sf), "m1")


@query("board_scope", with_views("runs", body="""
SELECT model, count(*) AS n, min(ts) AS first_ts FROM runs
WHERE ts >= 1704844800 AND (model IN ('click') OR model LIKE 'pur%') GROUP BY model"""))
def board_scope(spark, sf):
    kept = boards.board_models(boards.since(runs(spark, sf), 1704844800), ["click"], ["pur"])
    return kept.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query("common_tasks", with_views("runs", body="""
SELECT task_id, count(DISTINCT model) AS models FROM runs GROUP BY task_id HAVING count(DISTINCT model) >= 2"""))
def common_tasks(spark, sf):
    return boards.common_tasks(runs(spark, sf))


@query("wilson_intervals", with_views("latest", body="""
WITH g AS (SELECT model, count(*) FILTER (WHERE repair_judge >= 0.75) AS k, count(*) AS n FROM latest WHERE state = 'completed' GROUP BY model)
SELECT model, k, n, round(((k / n + 1.96 * 1.96 / (2.0 * n)) / (1 + 1.96 * 1.96 / n))
   - (1.96 / (1 + 1.96 * 1.96 / n)) * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n)), 6) AS lo,
 round(((k / n + 1.96 * 1.96 / (2.0 * n)) / (1 + 1.96 * 1.96 / n))
   + (1.96 / (1 + 1.96 * 1.96 / n)) * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n)), 6) AS hi FROM g"""))
def wilson_intervals(spark, sf):
    g = outcomes.with_state(latest(spark, sf)).filter("state = 'completed'").groupBy("model").agg(
        F.count_if(F.col("repair.judge_agreement") >= 0.75).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = boards.wilson(F.col("k"), F.col("n"))
    return g.select("model", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("utility_and_latency", with_views("latest", body="""
SELECT model, round(avg(CASE WHEN state = 'completed' THEN 100 * combined END), 1) AS capability,
  round(round(avg(CASE WHEN state = 'completed' THEN 100 * combined END), 1) * count(*) FILTER (WHERE state = 'completed') / count(*), 1) AS utility,
  round_even(quantile_cont(CASE WHEN state = 'completed' THEN latency_ms END, 0.5), 0)::BIGINT AS median_latency_ms
FROM latest GROUP BY model"""))
def utility_and_latency(spark, sf):
    done = F.col("state") == "completed"
    g = outcomes.with_state(latest(spark, sf)).groupBy("model").agg(
        F.round(F.avg(F.when(done, 100 * F.col("combined"))), 1).alias("capability"), F.count_if(done).alias("c"),
        F.count(F.lit(1)).alias("n"), boards.median_int(F.when(done, F.col("repair.latency_ms"))).alias("median_latency_ms"))
    return g.select("model", "capability", boards.utility(F.col("capability"), F.col("c"), F.col("n")).alias("utility"),
                    "median_latency_ms")


def answered(spark, sf):
    return answered_runs(spark, sf, latest(spark, sf))


MARKED = """WITH marked AS (SELECT *, state = 'completed' AS scored,
  state = 'completed' AND ((diag_location >= 1 AND diag_judge >= 0.5) OR (diag_location + diag_judge) / 2 >= 0.75) AS bug_found,
  state = 'completed' AND repair_judge >= 0.75 AS bug_fixed, state = 'completed' AND verbatim AS same_fix,
  state = 'completed' AND repair_repro >= 0.9 AS equiv_fix, state = 'completed' AND echo AND length(bn) > 40 AS untouched,
  CASE WHEN state = 'completed' THEN round(100 * combined, 1) END AS score_pct,
  CASE WHEN state = 'completed' THEN round(100 * diag_total, 1) END AS diagnose_pct,
  CASE WHEN state = 'completed' THEN round(100 * repair_total, 1) END AS repair_pct,
  coalesce(tainted, '') <> '' OR (verbatim AND model IN ('click', 'view')) AS quarantined FROM answered)"""


@query("marks", with_views("answered", body=MARKED + """
SELECT task_id, model, state, scored, bug_found, bug_fixed, same_fix, equiv_fix, untouched, score_pct, diagnose_pct,
  repair_pct, latency_ms FROM marked"""))
def marks(spark, sf):
    return boards.marks(answered(spark, sf), tasks(spark, sf)).drop("known_task", "ingest_seq")


@query("trusted_and_quarantined", with_views("answered", body=MARKED + """
SELECT model, CASE WHEN NOT quarantined THEN 'trusted' WHEN coalesce(tainted, '') <> '' THEN 'stored' ELSE 'file_read_leak' END AS taint,
  count(*) AS n FROM marked GROUP BY ALL"""))
def trusted_and_quarantined(spark, sf):
    good, bad = integrity.split_trusted(answered(spark, sf), tasks(spark, sf), lanes(spark, sf))
    return good.unionByName(bad).groupBy("model", F.coalesce("taint", F.lit("trusted")).alias("taint")).agg(
        F.count(F.lit(1)).alias("n"))


MARKS_BOARD = """,
kept AS (SELECT * FROM marked WHERE scored AND NOT quarantined), """ + sqltext.bootstrap(
    "b", "kept", "model", "score_pct", "ingest_seq", R, SEED).strip() + """
SELECT k.model, count(*) AS attempted, count(*) FILTER (WHERE bug_found) AS bugs_found, count(*) FILTER (WHERE bug_fixed) AS bugs_fixed,
  count(*) FILTER (WHERE same_fix) AS same_fix, count(*) FILTER (WHERE equiv_fix) AS equiv_fix, count(*) FILTER (WHERE untouched) AS untouched,
  round(avg(score_pct), 1) AS score_pct, round(avg(diagnose_pct), 1) AS diagnose_pct, round(avg(repair_pct), 1) AS repair_pct,
  round(any_value(c.lo), 4) AS ci95_lo, round(any_value(c.hi), 4) AS ci95_hi, count(*) AS tasks,
  count(*) FILTER (WHERE bug_found) || '/' || count(*) || ' (' || printf('%.1f', round(100.0 * count(*) FILTER (WHERE bug_found) / count(*), 1)) || '%)' AS bugs_found_of,
  count(*) FILTER (WHERE bug_fixed) || '/' || count(*) || ' (' || printf('%.1f', round(100.0 * count(*) FILTER (WHERE bug_fixed) / count(*), 1)) || '%)' AS bugs_fixed_of
FROM kept k JOIN b_ci c USING (model) GROUP BY k.model"""


@query("marks_board", with_views("answered", body=MARKED + MARKS_BOARD))
def marks_board(spark, sf):
    return boards.marks_board(answered(spark, sf), tasks(spark, sf), lanes(spark, sf))


DECISION = """, agg AS (SELECT model, count(*) AS attempted, count(*) FILTER (WHERE scored) AS completed,
   round(avg(score_pct), 1) AS capability, count(*) FILTER (WHERE bug_found) AS bugs_found, count(*) FILTER (WHERE bug_fixed) AS bugs_fixed,
   round_even(quantile_cont(CASE WHEN scored AND latency_ms > 0 THEN latency_ms END, 0.5), 0)::BIGINT AS median_latency_ms
   FROM marked WHERE NOT quarantined GROUP BY model),
w AS (SELECT *, bugs_fixed / completed AS p, 1 + 1.96 * 1.96 / completed AS d FROM agg),
board AS (SELECT model, CASE WHEN completed = 0 THEN 'unavailable' WHEN completed < 15 THEN 'insufficient_coverage' ELSE 'ok' END AS status,
  CASE WHEN completed < 15 THEN 'only ' || completed || '/20 tasks completed' ELSE '' END AS reason, completed, attempted,
  least(100.0, round(100.0 * completed / 20, 1))::DOUBLE AS coverage_pct, round(100.0 * completed / attempted, 1)::DOUBLE AS availability_pct,
  capability, round(capability * (completed / attempted), 1) AS utility, bugs_found, bugs_fixed,
  bugs_found || '/' || completed || ' (' || printf('%.1f', round(100.0 * bugs_found / completed, 1)) || '%)' AS found_of,
  bugs_fixed || '/' || completed || ' (' || printf('%.1f', round(100.0 * bugs_fixed / completed, 1)) || '%)' AS fixed_of,
  median_latency_ms, completed >= 15 AS ranking_eligible, round(p, 4) AS success_rate,
  round(100 * greatest(0, (p + 1.96 * 1.96 / (2.0 * completed)) / d - (1.96 / d) * sqrt(p * (1 - p) / completed + 1.96 * 1.96 / (4.0 * completed * completed))), 1) AS ci95_lo,
  round(100 * least(1, (p + 1.96 * 1.96 / (2.0 * completed)) / d + (1.96 / d) * sqrt(p * (1 - p) / completed + 1.96 * 1.96 / (4.0 * completed * completed))), 1) AS ci95_hi
FROM w)"""


@query("decision_board", with_views("answered", body=MARKED + DECISION + " SELECT * FROM board"))
def decision_board(spark, sf):
    return boards.decision_board(answered(spark, sf), tasks(spark, sf), lanes(spark, sf))


#: times that result files arrive, and micro-batches that read them
ARRIVALS = 2


@query("live_decision_board", with_views("answered", body=MARKED + DECISION + " SELECT * FROM board"))
def live_decision_board(spark, sf):
    """All result rows, older ones too, arrive in files of which a batch reads some.

    The rows of a task come in two arrivals, each written as its join leaves it, ordered by task: so nothing moves the
    answers once more, and the answers to a task, which repeat its texts, lie together and compress. Texts of tasks without
    a result stay where they are, and a query's shuffle files go with it.
    """
    source, state, check = (fresh_path(spark, n) for n in ("incoming", "live-marks", "live-marks-checkpoint"))
    with shuffles_cleaned(spark):
        tried = maybe_in(tasks(spark, sf), ["task_id"], runs(spark, sf).select("task_id").distinct())
        for arrival in range(ARRIVALS):
            some = runs(spark, sf).filter(F.pmod(F.xxhash64("ingest_seq"), F.lit(ARRIVALS)) == arrival)
            rows = answered_runs(spark, sf, some, tried)
            rows.select(*[f.name for f in RESULT if f.name in rows.columns], "ingest_seq").write.mode("append").json(source, compression="gzip")
        files = len(spark.read.text(source).inputFiles())
        board = LiveDecisionBoard(spark, state, tasks(spark, sf), lanes(spark, sf))
        stream = result_stream(spark, source, numbered=True, maxFilesPerTrigger=max(1, -(-files // ARRIVALS)))
        board.start(stream, check, availableNow=True).awaitTermination()
    return board.board()


@query("leader_ties", with_views("answered", body=MARKED + DECISION + """,
r AS (SELECT *, row_number() OVER w AS board_rank, first_value(model) OVER w AS leader, first_value(ci95_lo) OVER w AS llo,
  first_value(ci95_hi) OVER w AS lhi FROM board WHERE ranking_eligible WINDOW w AS (ORDER BY utility DESC, capability DESC, model)),
ov AS (SELECT *, NOT (lhi < ci95_lo OR ci95_hi < llo) AS is_over FROM r)
SELECT board_rank, model, leader, is_over AS "overlaps", (count(*) OVER () > 1 AND count(*) FILTER (WHERE board_rank > 1 AND is_over) OVER () = count(*) OVER () - 1) AS is_tie FROM ov"""))
def leader_ties(spark, sf):
    return boards.leader_ties(decision_board(spark, sf))


SCREENED = """WITH s AS (SELECT task_id, model, verbatim AS verbatim_reproduction, echo AND length(bn) > 40 AS echo_input,
  regexp_matches(raw, 'i''m sorry|as an ai', 'i') AS degenerate_output, k BETWEEN 40 AND 45 OR (repair_judge = 1 AND echo) AS judge_gaming,
  verbatim AND model IN ('click', 'view') AS file_read_leak, repair_judge = 1 AND echo AS contradicted FROM answered WHERE state = 'completed'),
 v AS (SELECT task_id, model, verbatim_reproduction, echo_input, degenerate_output, judge_gaming, file_read_leak,
  concat_ws(',', CASE WHEN verbatim_reproduction THEN 'verbatim_reproduction' END, CASE WHEN echo_input THEN 'echo_input' END,
    CASE WHEN degenerate_output THEN 'degenerate_output' END, CASE WHEN judge_gaming THEN 'judge_gaming' END, CASE WHEN file_read_leak THEN 'file_read_leak' END) AS fired,
  verbatim_reproduction OR echo_input OR degenerate_output OR judge_gaming AS cheating,
  CASE WHEN file_read_leak THEN 'critical' WHEN verbatim_reproduction OR echo_input OR contradicted THEN 'high'
    WHEN degenerate_output OR judge_gaming THEN 'medium' ELSE 'none' END AS severity FROM s)"""


@query("integrity_screen", with_views("answered", body=SCREENED + " SELECT * FROM v"))
def integrity_screen(spark, sf):
    return screened(spark, sf).withColumn("fired", F.array_join("fired", ",")).drop("ingest_seq")


def screened(spark, sf):
    return integrity.screen(answered(spark, sf), tasks(spark, sf), lanes(spark, sf))


@query("integrity_summary", with_views("answered", body=SCREENED + """
SELECT model, count(*) AS rows, count(*) FILTER (WHERE cheating) AS flagged, count(*) FILTER (WHERE verbatim_reproduction) AS verbatim_reproduction, count(*) FILTER (WHERE echo_input) AS echo_input,
  count(*) FILTER (WHERE degenerate_output) AS degenerate_output, count(*) FILTER (WHERE judge_gaming) AS judge_gaming, count(*) FILTER (WHERE file_read_leak) AS file_read_leak,
  round(count(*) FILTER (WHERE cheating) / count(*), 4) AS flag_rate FROM v GROUP BY model"""))
def integrity_summary(spark, sf):
    return integrity.screen_summary(screened(spark, sf))

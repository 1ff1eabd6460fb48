"""Panel, scoring and stability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom import fixed_values as fv
from gradeloom.operators import panel, scoring
from gradeloom.plans.registry import query, quoted as q, read
from gradeloom.plans.views import (attribution_trials, bugs, calibration, pool, sql_view, tests, trials, with_views)

RANK = "CASE difficulty WHEN 'hard' THEN 0 WHEN 'trivial' THEN 2 ELSE 1 END"
sql_view("panel_quota", """
SELECT codebase, pool_size, (25 // n + CASE WHEN row_number() OVER (ORDER BY pool_size DESC, codebase) <= 25 - (25 // n) * n THEN 1 ELSE 0 END)::BIGINT AS quota
FROM (SELECT codebase, count(*) AS pool_size, count(*) OVER () AS n FROM pool_once GROUP BY codebase)""", ("pool_once",))
sql_view("panel", f"""
SELECT p.*, quota FROM (SELECT *, row_number() OVER (PARTITION BY codebase ORDER BY {RANK}, CASE depth WHEN 'function' THEN 0 ELSE 1 END, module, line, bug_id) AS rn
  FROM (SELECT *, bool_or(difficulty <> 'trivial') OVER (PARTITION BY codebase) AS useful FROM pool_once)
  WHERE difficulty <> 'trivial' OR NOT useful) p JOIN panel_quota USING (codebase) WHERE rn <= quota""", ("panel_quota",))


@query("panel_dedupe", with_views("pool_once", body="SELECT codebase, module, bug_id, task_id FROM pool_once"))
def panel_dedupe(spark, sf):
    return panel.dedupe(pool(spark, sf)).select("codebase", "module", "bug_id", "task_id")


@query("panel_selection", with_views("panel", body="SELECT codebase, module, line, bug_id, task_id, difficulty, quota FROM panel"))
def panel_selection(spark, sf):
    return panel.select_panel(pool(spark, sf)).select("codebase", "module", "line", "bug_id", "task_id", "difficulty", "quota")


@query("panel_surplus", with_views("panel", body="""
SELECT n.n_name AS codebase, coalesce(pool_size, 0) AS pool_size, coalesce(quota, 0) AS quota, coalesce(s, 0) AS selected,
  greatest(0, coalesce(pool_size, 0) - coalesce(s, 0)) AS surplus, coalesce(pool_size, 0) = 0 AS empty
FROM (SELECT DISTINCT codebase AS n_name FROM pool UNION SELECT n_name FROM nation) n
LEFT JOIN panel_quota q ON q.codebase = n.n_name LEFT JOIN (SELECT codebase, count(*) AS s FROM panel GROUP BY codebase) t ON t.codebase = n.n_name"""))
def panel_surplus(spark, sf):
    p = pool(spark, sf)
    expected = p.select("codebase").union(read(spark, sf, "nation").select("n_name"))
    return panel.panel_surplus(p, panel.select_panel(p), expected=expected)


@query("panel_manifest_hash", with_views("panel", body="""
SELECT substr(sha256('{"target": 25, "tasks": [' || string_agg('["' || codebase || '", "' || module || '", "' || bug_id || '", "' || test_node || '", "'
  || difficulty || '"]', ', ' ORDER BY codebase, module, bug_id) || ']}'), 1, 16) AS manifest_hash, count(*) AS tasks FROM panel"""))
def panel_manifest_hash(spark, sf):
    return panel.manifest_hash(panel.select_panel(pool(spark, sf)))


@query("round_robin_subset", with_views("pool", body="""
SELECT codebase, task_id FROM (SELECT *, row_number() OVER (PARTITION BY codebase ORDER BY ingest_seq) AS rn FROM pool) ORDER BY rn, codebase LIMIT 40"""))
def round_robin_subset(spark, sf):
    return panel.round_robin_subset(pool(spark, sf), 40).select("codebase", "task_id")


@query("seeded_sample", with_views("pool", body="SELECT task_id FROM pool ORDER BY md5('7:' || task_id), task_id LIMIT 20"))
def seeded_sample(spark, sf):
    return panel.seeded_sample(pool(spark, sf), 20, 7).select("task_id")


@query("size_eligible", with_views("pool", body="""
SELECT task_id FROM pool WHERE (codebase, module) IN (SELECT p_brand, p_type FROM part GROUP BY ALL HAVING sum(p_retailprice) <= 15000)"""))
def size_eligible(spark, sf):
    sizes = read(spark, sf, "part").groupBy(F.col("p_brand").alias("codebase"), F.col("p_type").alias("module")).agg(
        F.sum("p_retailprice").alias("chars"))
    return panel.within_size(pool(spark, sf), sizes, 15000).select("task_id")


OPERATORS = list(fv.OPERATOR_DIFFICULTY) + ["add"]


@query("difficulty_rules", with_views("pool", body=f"""
SELECT task_id, CASE WHEN line >= 60 OR task_id % 6 >= 4 THEN 'hard' WHEN line >= 12 THEN 'moderate' ELSE 'trivial' END AS by_change,
  CASE WHEN line >= 30 OR task_id % 200 >= 150 THEN 'hard' WHEN line >= 10 OR task_id % 200 >= 60 THEN 'moderate' ELSE 'trivial' END AS by_struggle,
  CASE {OPERATORS}[(task_id % {len(OPERATORS)})::INT + 1] {" ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.OPERATOR_DIFFICULTY.items())}
    ELSE 'moderate' END AS by_operator FROM pool"""))
def difficulty_rules(spark, sf):
    t = F.col("task_id")
    op = F.get(F.array(*[F.lit(o) for o in OPERATORS]), (t % len(OPERATORS)).cast("int"))
    return pool(spark, sf).select(
        "task_id", panel.change_difficulty(F.col("line"), t % 6).alias("by_change"),
        panel.struggle_difficulty(F.col("line"), t % 200).alias("by_struggle"), panel.operator_difficulty(op).alias("by_operator"))


@query("module_difficulty", with_views("pool", body="""
SELECT codebase, module, CASE WHEN count(*) FILTER (WHERE difficulty = 'hard') > 0 THEN 'hard' WHEN count(*) FILTER (WHERE difficulty = 'moderate') > 0 AND count(*) >= 3 THEN 'hard'
  WHEN count(*) FILTER (WHERE difficulty = 'moderate') > 0 THEN 'moderate' ELSE 'trivial' END AS difficulty FROM pool GROUP BY ALL"""))
def module_difficulty(spark, sf):
    level = lambda v: F.count_if(F.col("difficulty") == v)
    return pool(spark, sf).groupBy("codebase", "module").agg(
        level("hard").alias("h"), level("moderate").alias("m"), F.count(F.lit(1)).alias("n")).select(
        "codebase", "module", panel.combined_difficulty(F.col("h"), F.col("m"), F.col("n")).alias("difficulty"))


@query("stable_ids", with_views("pool", body="""
SELECT task_id, 'mut_' || substr(sha256(codebase || '|' || module || '|' || test_node || '|' || line), 1, 12) AS bug_key,
  'case_' || substr(sha256(test_node), 1, 8) AS node, sha256(task_id || chr(0) || 'CAND' || chr(0) || bug_id || chr(0) || 'NOREF' || chr(0)) AS request
FROM pool"""))
def stable_ids(spark, sf):
    s = lambda c: F.col(c).cast("string")
    return pool(spark, sf).select(
        "task_id", panel.stable_id("mut_", s("codebase"), s("module"), s("test_node"), s("line")).alias("bug_key"),
        panel.opaque_node(F.col("test_node")).alias("node"), panel.request_key(s("task_id"), s("bug_id")).alias("request"))


@query("proximity_clusters", with_views("clustered", body="SELECT codebase, module, line, bug_id, cluster FROM clustered"))
def proximity_clusters(spark, sf):
    return panel.proximity_clusters(bugs(spark, sf), width=512).select("codebase", "module", "line", "bug_id", "cluster")


@query("bug_combinations", with_views("clustered", body=f"""
WITH u AS (SELECT *, {RANK} AS rk FROM clustered QUALIFY row_number() OVER (PARTITION BY codebase, module, cluster, test_node ORDER BY {RANK}, line, bug_id) = 1),
 n AS (SELECT *, lead(bug_id, 1) OVER w AS b2, lead(bug_id, 2) OVER w AS b3, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3,
   lead(rk, 1) OVER w AS r2, lead(rk, 2) OVER w AS r3 FROM u WINDOW w AS (PARTITION BY codebase, module, cluster ORDER BY rk, line, bug_id)),
 c AS (SELECT codebase, module, cluster, 2 AS bugs_total, bug_id || '+' || b2 AS ids, greatest(line, l2) - least(line, l2) AS span_lines,
   CASE WHEN least(rk, r2) = 0 THEN 'hard' WHEN least(rk, r2) = 1 THEN 'moderate' ELSE 'trivial' END AS difficulty FROM n WHERE b2 IS NOT NULL
  UNION ALL SELECT codebase, module, cluster, 3, bug_id || '+' || b2 || '+' || b3, greatest(line, l2, l3) - least(line, l2, l3),
   CASE WHEN least(rk, r2, r3) <= 1 THEN 'hard' ELSE 'trivial' END FROM n WHERE b3 IS NOT NULL)
SELECT codebase || '__' || module || '__' || substr(sha256(ids), 1, 16) AS task_id, codebase, module, cluster, bugs_total, span_lines, difficulty FROM c"""))
def bug_combinations(spark, sf):
    return panel.combinations(panel.proximity_clusters(bugs(spark, sf))).drop("bugs")


@query("killed_mutants", with_views("tests", body="""
WITH green AS (SELECT codebase, nodeid FROM tests WHERE state = 'fixed' GROUP BY ALL HAVING count(*) FILTER (WHERE outcome = 'passed') * 3 >= count(*))
SELECT codebase, task_id AS bug_id, min(nodeid) AS test_node, count(DISTINCT nodeid) AS n_failing, codebase || '__' || task_id AS task_id
FROM tests WHERE state = 'buggy' AND outcome IN ('failed', 'error') AND (codebase, nodeid) IN (SELECT codebase, nodeid FROM green) GROUP BY codebase, tests.task_id"""))
def killed_mutants(spark, sf):
    t = tests(spark, sf)
    green = t.filter("state = 'fixed'").groupBy("codebase", "nodeid").agg(
        F.count_if(F.col("outcome") == "passed").alias("p"), F.count(F.lit(1)).alias("n")).filter("p * 3 >= n")
    return panel.killed_mutants(t.filter("state = 'buggy'").withColumnRenamed("task_id", "bug_id"), green)


def bug_map(spark, sf):
    nodes = F.array(*[F.lit(f"n{i}") for i in range(1, 8)])
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.explode(nodes).alias("test_node")).withColumn(
        "bug_id", F.concat(F.lit("bug"), F.col("task_id").cast("string"), F.col("test_node")))


sql_view("scored_bugs", """
SELECT m.task_id, 'bug' || m.task_id || m.test_node AS bug_id, m.test_node, coalesce(o.outcome = 'passed', false) AS passed,
  o.outcome IS NULL OR o.outcome IN ('failed', 'error') AS errored, coalesce(o.outcome = 'passed', false)::INT::DOUBLE AS value
FROM (SELECT o_orderkey AS task_id, unnest(['n1', 'n2', 'n3', 'n4', 'n5', 'n6', 'n7']) AS test_node FROM orders) m
LEFT JOIN (SELECT task_id, nodeid, arg_max(outcome, ingest_seq) AS outcome FROM tests GROUP BY ALL) o ON o.task_id = m.task_id AND o.nodeid = m.test_node""",
         ("tests",))


@query("scored_bugs", with_views("scored_bugs", body="SELECT * FROM scored_bugs"))
def scored_bugs(spark, sf):
    return scoring.score_bugs(bug_map(spark, sf), tests(spark, sf))


@query("file_scores", with_views("scored_bugs", body="""
SELECT task_id, count(*) AS bugs_total, count(*) FILTER (WHERE value = 1) AS bugs_fixed, round(count(*) FILTER (WHERE value = 1) / count(*), 6) AS per_bug_score,
  count(*) FILTER (WHERE value = 1) = count(*) AS file_clear FROM scored_bugs GROUP BY task_id"""))
def file_scores(spark, sf):
    return scoring.file_scores(scored_bugs(spark, sf))


@query("flipped_tests", with_views("tests", body="""
WITH b AS (SELECT task_id, nodeid, arg_max(outcome, ingest_seq) FILTER (state = 'buggy') AS before, arg_max(outcome, ingest_seq) FILTER (state = 'fixed') AS after,
  min(ingest_seq) FILTER (state = 'fixed') AS first_at FROM (SELECT task_id, 'n' || slot AS nodeid, state, outcome, ingest_seq FROM tests) GROUP BY ALL)
SELECT task_id, arg_min(nodeid, first_at) AS test_node, count(*) AS n_flipped FROM b WHERE before <> 'passed' AND after = 'passed' GROUP BY task_id"""))
def flipped_tests(spark, sf):
    return scoring.flipped_tests(tests(spark, sf).withColumn("nodeid", F.concat(F.lit("n"), F.col("slot").cast("string"))))


@query("oracle_gate", with_views("calibration", body="""
WITH s AS (SELECT *, bugs_fixed / bugs_total AS s, known = 'good' AS g FROM calibration),
a AS (SELECT count(*) FILTER (WHERE g) AS good_files, count(*) FILTER (WHERE NOT g) AS bad_files, count(*) FILTER (WHERE g AND bugs_fixed <> bugs_total) AS good_failures,
 count(*) FILTER (WHERE NOT g AND bugs_fixed > 0) AS bad_failures, round(avg(s) FILTER (g), 6) AS good_mean, round(avg(s) FILTER (NOT g), 6) AS bad_mean,
 min(s) FILTER (g) >= max(s) FILTER (NOT g) AS monotone FROM s)
SELECT *, monotone AND good_failures = 0 AND bad_failures = 0 AS passed FROM a"""))
def oracle_gate(spark, sf):
    return scoring.oracle_gate(calibration(spark, sf))


@query("oracle_gate_failures", with_views("calibration", body="""
SELECT task_id, known, CASE WHEN known = 'good' THEN 'known-good not fully fixed' ELSE 'known-bad earned credit' END AS failure
FROM calibration WHERE (known = 'good' AND bugs_fixed <> bugs_total) OR (known = 'bad' AND bugs_fixed > 0)"""))
def oracle_gate_failures(spark, sf):
    return scoring.gate_failures(calibration(spark, sf))


sql_view("noise_cells", """
SELECT task_id, state, count(*) AS repeats, round(max(passed / total) - min(passed / total), 9) AS spread,
  CASE WHEN count(*) < 3 THEN 'too few repeats' WHEN count(DISTINCT passed) > 1 THEN 'scores varied'
       WHEN count(DISTINCT feedback) > 1 THEN 'feedback varied' END AS failure FROM trials GROUP BY task_id, state""", ("trials",))


@query("noise_cells", with_views("noise_cells", body="SELECT * FROM noise_cells"))
def noise_cells(spark, sf):
    return scoring.noise_cells(trials(spark, sf))


@query("noise_floor", with_views("noise_cells", body="""
SELECT sum(repeats)::BIGINT AS trials, count(*) AS cells, count(*) FILTER (WHERE repeats >= 3) AS cells_measured, count(*) FILTER (WHERE failure IN ('scores varied', 'feedback varied')) AS unstable,
  count(failure) AS failures, max(spread) AS max_within_cell_spread, count(failure) = 0 AS passed FROM noise_cells"""))
def noise_floor(spark, sf):
    return scoring.noise_floor(trials(spark, sf))


@query("repeat_reduction", with_views("trials", body="""
WITH c AS (SELECT task_id, state, passed / total AS v, count(*) AS n FROM trials GROUP BY ALL)
SELECT task_id, state, arg_max(v, n * 10 + v) AS score, sum(n)::BIGINT AS repeats, max(n) * 2 > sum(n) AS majority, count(*) = 1 AS unanimous FROM c GROUP BY task_id, state"""))
def repeat_reduction(spark, sf):
    t = trials(spark, sf).withColumn("score", F.col("passed") / F.col("total"))
    return scoring.reduce_repeats(t, ["task_id", "state"])


@query("bug_attribution", with_views("attribution_trials", body="""
WITH r AS (SELECT task_id, state, count(*) AS bugs, count(*) FILTER (WHERE passed) AS green, count(*) FILTER (WHERE passed AND state = 'fix_' || bug_id) AS target FROM attribution_trials GROUP BY ALL),
 p AS (SELECT task_id, max(bugs) AS bugs, max(bugs - green) FILTER (state = 'all_present') AS present_failing, max(green) FILTER (state = 'all_fixed') AS fixed_passing,
  count(*) FILTER (WHERE state LIKE 'fix%' AND target = 1 AND green = 1) AS isolated, count(*) FILTER (WHERE state LIKE 'fix%' AND target = 1 AND green > 1) AS entangled FROM r GROUP BY task_id)
SELECT *, CASE WHEN present_failing <> bugs THEN 'not every bug fails when all are present' WHEN fixed_passing <> bugs THEN 'not every bug passes on the fixed source'
  WHEN entangled > 0 THEN 'one fix turns another bug green' ELSE '' END AS reason, present_failing = bugs AND fixed_passing = bugs AND entangled = 0 AS ok FROM p"""))
def bug_attribution(spark, sf):
    return scoring.attribution(attribution_trials(spark, sf))


@query("failure_texts", with_views("tests", body="""
WITH l AS (SELECT task_id, ingest_seq // 10000 AS page, ingest_seq, 'FAILED ' || nodeid || ' [' || CASE outcome WHEN 'failed' THEN 'Failure' ELSE 'Error' END || ']' AS line
   FROM tests WHERE outcome <> 'passed'
 UNION ALL SELECT task_id, max(ingest_seq // 10000), 1::BIGINT << 61, '--- ' || count(*) FILTER (WHERE outcome <> 'passed') || ' failed / ' || count(*) || ' executed ---'
   FROM tests GROUP BY task_id HAVING count(*) FILTER (WHERE outcome <> 'passed') > 0)
SELECT task_id, page, string_agg(line, chr(10) ORDER BY ingest_seq, line) || chr(10) AS text FROM l GROUP BY task_id, page"""))
def failure_texts(spark, sf):
    return scoring.render_failures(tests(spark, sf))


@query("campaign_summary", with_views("tests", body="""
WITH f AS (SELECT 'lane' || (codebase % 4) AS model, task_id, count(*) AS bugs_total, count(*) FILTER (WHERE outcome = 'passed') AS bugs_fixed, max(l_quantity) AS latency_s FROM tests GROUP BY ALL),
 a AS (SELECT *, CASE WHEN bugs_fixed > 0 THEN 'scored' WHEN bugs_total > 1 THEN 'declined_work' ELSE 'transport' END AS outcome, bugs_fixed = bugs_total AS file_clear FROM f)
SELECT model, count(*) AS tasks, sum(bugs_fixed)::BIGINT AS bugs_fixed, sum(bugs_total)::BIGINT AS bugs_total, count(*) FILTER (WHERE file_clear) AS files_cleared,
  round(avg(bugs_fixed / bugs_total), 6) AS mean_score, count(*) FILTER (WHERE outcome = 'scored') AS scored, count(*) FILTER (WHERE outcome = 'declined_work') AS declined_work,
  0 AS invalid_response, 0 AS refused, 0 AS needs_tools, count(*) FILTER (WHERE outcome = 'transport') AS transport, 0 AS policy_violation,
  round(quantile_cont(latency_s, 0.5), 3) AS median_latency_s FROM a GROUP BY model"""))
def campaign_summary(spark, sf):
    from gradeloom.operators.boards import campaign_summary as summarize
    f = tests(spark, sf).groupBy(F.concat(F.lit("lane"), (F.col("codebase") % 4).cast("string")).alias("model"), "task_id").agg(
        F.count(F.lit(1)).alias("bugs_total"), F.count_if(F.col("outcome") == "passed").alias("bugs_fixed"), F.max("l_quantity").alias("latency_s"))
    outcome = F.when(F.col("bugs_fixed") > 0, "scored").when(F.col("bugs_total") > 1, "declined_work").otherwise("transport")
    return summarize(f.withColumn("outcome", outcome).withColumn("file_clear", F.col("bugs_fixed") == F.col("bugs_total")).withColumn(
        "per_bug_score", F.col("bugs_fixed") / F.col("bugs_total")))

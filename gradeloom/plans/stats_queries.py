"""Paired comparison statistics over per-bug scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom import fixed_values as fv
from gradeloom.operators import resampling as rs
from gradeloom.operators.boards import latest_per_task
from gradeloom.plans import sqltext
from gradeloom.plans.registry import query
from gradeloom.plans.views import runs, sql_view, with_views

SEED, REPS, DRAWS = fv.PAIR_SEED, fv.PAIR_REPLICATES, fv.SIGN_DRAWS


def scores(spark, sf, bugs: int | None = 12):
    """Mean score per (model, bug); few bugs for the exact test, one per user otherwise."""
    r = latest_per_task(runs(spark, sf))
    bug = F.col("user_id") % bugs if bugs else F.col("user_id")
    rows = r.select("model", bug.alias("bug"), F.col("combined").alias("score"))
    return rows.select("model", F.concat(F.lit("bug"), F.col("bug").cast("string")).alias("bug_id"),
                       F.concat(F.lit("cb"), (F.col("bug") % 4).cast("string")).alias("codebase"), "score")


for _name, _bug in (("few", "user_id % 12"), ("many", "user_id")):
    sql_view(f"scores_{_name}", f"""
SELECT model, 'bug' || bug AS bug_id, 'cb' || (bug % 4) AS codebase, avg(combined) AS score
FROM (SELECT model, {_bug} AS bug, combined FROM latest) GROUP BY ALL""", ("latest",))
    sql_view(f"diffs_{_name}", f"""
SELECT a.model AS model_a, b.model AS model_b, a.bug_id, a.codebase, a.score AS a, b.score AS b, a.score - b.score AS diff
FROM scores_{_name} a JOIN scores_{_name} b USING (bug_id) WHERE a.model < b.model""", (f"scores_{_name}",))

PAIR = ["model_a", "model_b"]


def rounded(df, *columns):
    return df.select(*PAIR, *[F.round(c, 6).alias(c) if c in columns else c for c in df.columns if c not in PAIR])


@query("paired_differences", with_views("diffs_few", body="""
SELECT model_a, model_b, bug_id, codebase, round(a, 6) AS a, round(b, 6) AS b, round(diff, 6) AS diff FROM diffs_few"""))
def paired_differences(spark, sf):
    return rounded(rs.pairwise_differences(scores(spark, sf)), "a", "b", "diff")


@query("model_pairs", with_views("runs", body="""
SELECT a.model AS model_a, b.model AS model_b FROM (SELECT DISTINCT model FROM runs) a
JOIN (SELECT DISTINCT model FROM runs) b ON a.model < b.model"""))
def model_pairs(spark, sf):
    return rs.model_pairs(runs(spark, sf))


@query("dominance", with_views("diffs_many", body="""
SELECT model_a, model_b, round(avg(sign(diff)), 6) AS dominance, count(*) AS shared FROM diffs_many GROUP BY ALL"""))
def dominance(spark, sf):
    return rounded(rs.dominance(rs.pairwise_differences(scores(spark, sf, None)), PAIR), "dominance")


def pair_ci_sql(prefix, source):
    return sqltext.bootstrap(prefix, source, "model_a, model_b", "diff", "bug_id", REPS, SEED)


def cluster_ci_sql(prefix, source):
    cte = (f"{prefix}_src AS (SELECT model_a, model_b, codebase, sum(diff) AS ds, count(*) AS dc FROM {source} GROUP BY ALL), ")
    return cte + sqltext.bootstrap(prefix, f"{prefix}_src", "model_a, model_b", "ds", "codebase", REPS, SEED, count="dc").strip()


CI_OUT = " SELECT model_a, model_b, n, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b_ci"


@query("pair_bootstrap", with_views("diffs_many", body="WITH " + pair_ci_sql("b", "diffs_many").strip() + CI_OUT))
def pair_bootstrap(spark, sf):
    return rounded(rs.bootstrap(rs.pairwise_differences(scores(spark, sf, None)), PAIR, "diff", "bug_id",
                                replicates=REPS, seed=SEED), "point", "lo", "hi")


@query("cluster_bootstrap", with_views("diffs_many", body="WITH " + cluster_ci_sql("b", "diffs_many") + CI_OUT))
def cluster_bootstrap(spark, sf):
    return rounded(rs.bootstrap(rs.pairwise_differences(scores(spark, sf, None)), PAIR, "diff", "bug_id", cluster="codebase",
                                replicates=REPS, seed=SEED), "point", "lo", "hi")


EXACT_P = """nz AS (SELECT model_a, model_b, diff, row_number() OVER (PARTITION BY model_a, model_b ORDER BY bug_id) - 1 AS i
    FROM diffs_few WHERE diff <> 0),
  sizes AS (SELECT model_a, model_b, count(*) AS n, abs(sum(diff)) AS obs FROM nz GROUP BY ALL),
  sums AS (SELECT nz.model_a, nz.model_b, m, sum(CASE WHEN (m >> i) & 1 = 0 THEN diff ELSE -diff END) AS s
    FROM sizes JOIN nz USING (model_a, model_b), LATERAL (SELECT unnest(range((1::BIGINT << n))) AS m) GROUP BY ALL),
  p AS (SELECT model_a, model_b, count(*) FILTER (WHERE abs(s) >= obs - 1e-9) / count(*) AS p_value FROM sums JOIN sizes USING (model_a, model_b) GROUP BY ALL)"""


@query("sign_permutation_exact", with_views("diffs_few", body="WITH " + EXACT_P + """
SELECT model_a, model_b, round(p_value, 6) AS p_value FROM p"""))
def sign_permutation_exact(spark, sf):
    return rounded(rs.sign_permutation(rs.pairwise_differences(scores(spark, sf)), PAIR, method="exact"), "p_value")


SAMPLED_P = f"""nz AS (SELECT model_a, model_b, diff, {sqltext.text_key('bug_id')} AS kk FROM diffs_many WHERE diff <> 0),
  sizes AS (SELECT model_a, model_b, abs(sum(diff)) AS obs FROM nz GROUP BY ALL),
  sums AS (SELECT model_a, model_b, j, sum((1 - 2 * (x2 % 2)) * diff) AS s
    FROM ({sqltext._hashed(f'SELECT *, j FROM nz, range({DRAWS}) r(j)', 'j', 'kk', SEED)}) GROUP BY ALL),
  p AS (SELECT model_a, model_b, (count(*) FILTER (WHERE abs(s) >= obs - 1e-9) + 1) / ({DRAWS} + 1) AS p_value
    FROM sums JOIN sizes USING (model_a, model_b) GROUP BY ALL)"""


@query("sign_permutation_sampled", with_views("diffs_many", body="WITH " + SAMPLED_P + """
SELECT model_a, model_b, round(p_value, 6) AS p_value FROM p"""))
def sign_permutation_sampled(spark, sf):
    return rounded(rs.sign_permutation(rs.pairwise_differences(scores(spark, sf, None)), PAIR, method="sampled", draws=DRAWS), "p_value")


HOLM = """, h AS (SELECT *, max(step) OVER (ORDER BY p_value, model_a, model_b) AS p_adjusted FROM (
    SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_value, model_a, model_b) + 1) * p_value) AS step FROM p))"""


@query("holm_correction", with_views("diffs_few", body="WITH " + EXACT_P + HOLM + """
SELECT model_a, model_b, round(p_value, 6) AS p_value, round(p_adjusted, 6) AS p_adjusted FROM h"""))
def holm_correction(spark, sf):
    p = rs.sign_permutation(rs.pairwise_differences(scores(spark, sf)), PAIR, method="exact")
    return rounded(rs.holm(p, tiebreak=PAIR), "p_value", "p_adjusted")


@query("equivalence", with_views("diffs_many", body="WITH " + pair_ci_sql("b", "diffs_many").strip() + """
SELECT model_a, model_b, lo > -0.1 AND hi < 0.1 AS equivalent FROM b_ci"""))
def equivalence(spark, sf):
    ci = rs.bootstrap(rs.pairwise_differences(scores(spark, sf, None)), PAIR, "diff", "bug_id", replicates=REPS, seed=SEED)
    return ci.select(*PAIR, rs.equivalent(F.col("lo"), F.col("hi")).alias("equivalent"))


def verdict_sql(p, diffs, method):
    return "WITH " + p + HOLM + ", " + pair_ci_sql("b", diffs).strip() + ", " + cluster_ci_sql("c", diffs) + f""",
 s AS (SELECT model_a, model_b, avg(diff) AS delta, avg(a) AS mean_a, avg(b) AS mean_b, avg(sign(diff)) AS dominance,
   count(*) AS n_bugs FROM {diffs} GROUP BY ALL),
 t AS (SELECT s.*, h.p_value, h.p_adjusted, b.lo, b.hi, c.lo AS clo, c.hi AS chi, b.lo > -0.1 AND b.hi < 0.1 AS tied,
   h.p_value < 0.05 AND NOT (b.lo <= 0 AND b.hi >= 0) AS sig FROM s JOIN h USING (model_a, model_b)
   JOIN b_ci b USING (model_a, model_b) JOIN c_ci c USING (model_a, model_b))
SELECT model_a, model_b, CASE WHEN sig AND p_adjusted < 0.05 AND delta > 0 THEN 'A_WINS' WHEN sig AND p_adjusted < 0.05 THEN 'B_WINS'
   WHEN tied THEN 'TIED' ELSE 'INCONCLUSIVE' END AS verdict, n_bugs, round(delta, 6) AS delta, round(mean_a, 6) AS mean_a,
  round(mean_b, 6) AS mean_b, round(dominance, 6) AS dominance, round(p_value, 6) AS p_value, round(p_adjusted, 6) AS p_adjusted,
  round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(clo, 6) AS cluster_low, round(chi, 6) AS cluster_high, '{method}' AS p_method,
  concat_ws('; ', CASE WHEN sig AND ((lo > 0) <> (clo > 0) OR (hi > 0) <> (chi > 0)) THEN 'paired and cluster intervals disagree on the sign; the paired result stands' END,
   CASE WHEN sig AND NOT p_adjusted < 0.05 THEN 'win does not survive Holm correction' END, CASE WHEN NOT sig AND tied THEN 'gap bounded below 0.1' END,
   CASE WHEN NOT sig AND NOT tied THEN 'could not bound the gap below 0.1; not a tie' END) AS notes FROM t"""


def verdict_rows(v):
    return rounded(v.withColumn("notes", F.array_join("notes", "; ")), "delta", "mean_a", "mean_b", "dominance", "p_value", "p_adjusted", "ci_low", "ci_high",
                   "cluster_low", "cluster_high")


@query("pair_verdicts", with_views("diffs_many", "latest", body=verdict_sql(SAMPLED_P, "diffs_many", "sampled")))
def pair_verdicts(spark, sf):
    """Hundreds of bugs: p-values by random signs."""
    return verdict_rows(rs.verdicts(scores(spark, sf, None), replicates=REPS, draws=DRAWS))


@query("pair_verdicts_few_bugs", with_views("diffs_few", "latest", body=verdict_sql(EXACT_P, "diffs_few", "exact")))
def pair_verdicts_few_bugs(spark, sf):
    """Twelve bugs: the same call finds exact p-values."""
    return verdict_rows(rs.verdicts(scores(spark, sf), replicates=REPS, draws=DRAWS))

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.functions.hashing import MODULUS
from gradeloom.operators import resampling as rs


def draw(b, i, seed):
    p = MODULUS
    x0 = (b * 40014 + i * 40692 + seed) % p
    x1 = ((x0 * x0) % p + x0 * 16807 + 99991 * i) % p
    return ((x1 * x1) % p + x1 * 48271) % p


def scores(rows, **models):
    values = [(m, f"b{i}", f"c{i % 4}", float(s)) for m, ss in models.items() for i, s in enumerate(ss) if s is not None]
    return rows("model string, bug_id string, codebase string, score double", *values)


def test_bootstrap_equals_the_same_draws_in_python(rows):
    vals = [0.1, 0.9, 0.4, 0.4, 0.7]
    df = rows("g string, u string, v double", *[("g", f"u{i}", v) for i, v in enumerate(vals)], ("one", "u", 0.3), ("none", "u", None))
    got = {r.g: r for r in rs.bootstrap(df, ["g"], "v", "u", replicates=200, seed=7, method="redraw").collect()}
    means = sorted(sum(vals[draw(b, i, 7) % 5] for i in range(5)) / 5 for b in range(200))
    assert got["g"].lo == pytest.approx(means[5]) and got["g"].hi == pytest.approx(means[195])
    assert (got["one"].point, got["one"].lo, got["one"].hi) == (0.3, 0.3, 0.3)
    assert "none" not in got


def test_weighted_scheme_agrees_with_the_exact_one(rows):
    rng = random.Random(4)
    df = rows("g string, u string, v double", *[("g", f"u{i}", rng.random()) for i in range(400)])
    exact = rs.bootstrap(df, ["g"], "v", "u", replicates=400, method="redraw").first()
    weighted = rs.bootstrap(df, ["g"], "v", "u", replicates=400).first()
    assert exact.lo == pytest.approx(weighted.lo, abs=0.012) and exact.hi == pytest.approx(weighted.hi, abs=0.012)


def test_cluster_bootstrap_is_wider_and_falls_back(rows):
    df = rows("g string, u string, c string, v double", *[("g", f"u{i}", f"c{i % 3}", float(i % 3)) for i in range(60)],
              *[("solo", f"u{i}", "only", float(i % 2)) for i in range(10)])
    plain = {r.g: r for r in rs.bootstrap(df, ["g"], "v", "u", replicates=200).collect()}
    clustered = {r.g: r for r in rs.bootstrap(df, ["g"], "v", "u", cluster="c", replicates=200).collect()}
    assert clustered["g"].hi - clustered["g"].lo > plain["g"].hi - plain["g"].lo
    assert (clustered["solo"].lo, clustered["solo"].hi) == (plain["solo"].lo, plain["solo"].hi)


def test_sign_permutation(rows):
    d = [("tie", f"b{i}", 0.0) for i in range(5)] + [("ten", f"b{i}", 0.5) for i in range(10)] + [("mixed", f"b{i}", x) for i, x in enumerate((1.0, -1.0, 0.5))]
    got = {r.g: r.p_value for r in rs.sign_permutation(rows("g string, bug_id string, diff double", *d), ["g"], method="exact").collect()}
    assert got["tie"] == 1.0
    assert got["ten"] == 2 / 1024
    assert got["mixed"] == 1.0
    many = rows("g string, bug_id string, diff double", *[("many", f"b{i}", 1.0) for i in range(40)])
    assert rs.sign_permutation(many, ["g"], draws=500).first().p_value == pytest.approx(1 / 501)
    assert rs.sign_permutation(many, ["g"], method="exact").first().p_value == 2 / 2**40
    more = rows("g string, bug_id string, diff double", *[("more", f"b{i}", 1.0) for i in range(rs.EXACT_MAX + 1)])
    with pytest.raises(Exception, match="too many differences"):
        rs.sign_permutation(more, ["g"], method="exact").first()


def test_one_scheme_on_both_sides_of_any_size(rows, spark):
    """Groups of 4,096 and 4,097 units, and a large one, are weighted alike; the interval covers the known mean."""
    big = spark.range(300_000).selectExpr("'big' AS g", "cast(id AS string) AS u", "cast(id % 100 AS double) AS v")
    df = big.unionByName(spark.range(4096).selectExpr("'a'", "cast(id AS string)", "cast(id % 64 AS double)").toDF("g", "u", "v")).unionByName(
        spark.range(4097).selectExpr("'b'", "cast(id AS string)", "cast(id % 64 AS double)").toDF("g", "u", "v"))
    got = {r.g: r for r in rs.bootstrap(df, ["g"], "v", "u", replicates=200).collect()}
    assert got["big"].lo < 49.5 < got["big"].hi and got["big"].hi - got["big"].lo < 0.3
    assert abs(got["a"].lo - got["b"].lo) < 0.2 and abs(got["a"].hi - got["b"].hi) < 0.2
    plan = rs.bootstrap(df, ["g"], "v", "u", replicates=200, materialize=False)._jdf.queryExecution().toString()
    assert "RepartitionByExpression" not in plan


def test_sampled_p_is_close_to_exact(rows):
    rng = random.Random(9)
    df = rows("g string, bug_id string, diff double", *[("g", f"b{i}", rng.uniform(-0.4, 0.8)) for i in range(12)])
    exact = rs.sign_permutation(df, ["g"], method="exact").first().p_value
    sampled = rs.sign_permutation(df, ["g"], draws=4000).first().p_value
    assert sampled == pytest.approx(exact, abs=0.02)


def test_holm_is_monotone_and_capped(rows):
    df = rows("k string, p_value double", ("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9))
    got = {r.k: round(r.p_adjusted, 6) for r in rs.holm(df, tiebreak=["k"]).collect()}
    assert got == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9}


def test_only_shared_bugs_are_compared(rows):
    s = scores(rows, a=[1, 1, None, 0], b=[0, None, 1, 0])
    got = {r.bug_id: r.diff for r in rs.pairwise_differences(s).collect()}
    assert got == {"b0": 1.0, "b3": 0.0}


def test_equivalence_bounds(rows):
    df = rows("lo double, hi double", (-0.02, 0.03), (-0.2, 0.03), (0.0, 0.1))
    assert [r[0] for r in df.select(rs.equivalent(F.col("lo"), F.col("hi"))).collect()] == [True, False, False]


def test_verdicts(rows):
    rng = random.Random(0)
    base = [rng.random() for _ in range(30)]
    s = scores(rows, win=[1.0] * 30, lose=[0.0] * 30, same=base, twin=base).unionByName(
        rows("model string, bug_id string, codebase string, score double", ("zz", "elsewhere", "c", 1.0)))
    got = {(r.model_a, r.model_b): r for r in rs.verdicts(s, replicates=200, draws=400).collect()}
    assert len(got) == 10
    assert got[("lose", "win")].verdict == "B_WINS" and got[("lose", "win")].dominance == -1.0
    assert got[("same", "twin")].verdict == "TIED" and got[("same", "twin")].p_value == 1.0
    assert got[("same", "zz")].verdict == "INCONCLUSIVE" and got[("same", "zz")].n_bugs == 0
    assert got[("same", "zz")].notes == ["no bugs are shared between these two models"]


def test_win_that_does_not_survive_correction_is_downgraded(rows):
    # six bugs, all better: p = 2/64, significant alone, not after three comparisons
    s = scores(rows, a=[0.9] * 6, b=[0.5] * 6, c=[0.9] * 3 + [0.5] * 3)
    got = {(r.model_a, r.model_b): r for r in rs.verdicts(s, replicates=100).collect()}[("a", "b")]
    assert got.p_value < 0.05 <= got.p_adjusted
    assert got.verdict == "INCONCLUSIVE" and "win does not survive Holm correction" in got.notes


def enumerated(values):
    sums = [sum(s * v for s, v in zip(signs, values)) for signs in itertools.product((1, -1), repeat=len(values))]
    return sum(abs(s) >= abs(sum(values)) - 1e-9 for s in sums) / len(sums)


def test_exact_p_equals_enumeration():
    rng = random.Random(3)
    for n in [*range(1, 15), 16]:
        for values in ([rng.uniform(-1, 1) for _ in range(n)], [rng.choice([-0.5, 0.5, 1.0]) for _ in range(n)], [0.25] * n):
            assert rs.exact_share(np.array(values), chunk=7) == enumerated(values)


def test_exact_p_of_forty_differences():
    # all of one size: the share is a binomial tail
    signs = [1.0] * 30 + [-1.0] * 10
    assert rs.exact_share(np.array(signs)) == pytest.approx(2 * sum(math.comb(40, k) for k in range(11)) / 2**40, rel=1e-12)


def test_auto_is_exact_for_few_and_sampled_for_many(rows):
    rng = random.Random(5)
    few = [("few", f"b{i}", rng.uniform(-1, 1.5)) for i in range(14)] + [("few", "zero", 0.0), ("none", "b", 0.0)]
    many = [("many", f"b{i}", rng.uniform(-1, 1.3)) for i in range(rs.EXACT_MAX + 30)]
    df = rows("g string, bug_id string, diff double", *few, *many)
    got = {r.g: r.p_value for r in rs.sign_permutation(df, ["g"], method="auto", draws=2000).collect()}
    assert got["few"] == enumerated([v for _, _, v in few if v]) and got["none"] == 1.0
    sampled = {r.g: r.p_value for r in rs.sign_permutation(df, ["g"], method="sampled", draws=2000).collect()}
    assert got["many"] == sampled["many"]
    with pytest.raises(Exception, match="too many differences"):
        rs.sign_permutation(df, ["g"], method="exact").collect()


def test_few_rows_and_many_replicates_use_every_core(spark, rows):
    df = rows("g string, u string, v double", *[("g", f"u{i}", float(i % 7)) for i in range(300)]).coalesce(1)
    whole = rs.bootstrap(df, ["g"], "v", "u", replicates=1000).first()
    assert rs._replicate_blocks(df, 20_000) >= spark.sparkContext.defaultParallelism
    assert rs._replicate_blocks(df.repartition(64), 20_000) == 1
    again = rs.bootstrap(df.repartition(64), ["g"], "v", "u", replicates=1000).first()
    assert (whole.lo, whole.hi) == pytest.approx((again.lo, again.hi))


def test_fast_draws_are_the_draws_of_the_formula():
    items = np.array([0, 1, 7, 2**31 - 2, 2**31 - 1, 2**31, 2**32 - 1, 123456789])
    for seed in (0, 12345, 20260930, 2**31 + 5):
        got = rs._draws(items, 3, 19_000, seed)[:, ::613]
        assert got.tolist() == [[draw(b, int(i), seed) for b in range(3, 19_000, 613)] for i in items]
    some = np.array([[0, 789_999_999, 790_015_083, 790_015_084, MODULUS - 1]])
    assert rs._poisson_weights(some).tolist() == np.searchsorted(np.array(rs.poisson_cuts()), some, side="right").tolist()
    assert rs._signs(np.array([[0, 1, 5, MODULUS - 1]])).tolist() == [[1.0, -1.0, -1.0, 1.0]]


def test_many_rows_and_draws_are_dealt_by_unit(spark, rows, monkeypatch):
    """The rows of a task don't grow with the input, and groups of the same units draw once for all of them."""
    units = spark.range(900).selectExpr("concat('g', id % 3) AS g", "concat('u', id div 3) AS unit", "cast(id % 7 - 3 AS double) AS s", "1L AS c").coalesce(1)
    plain = {(r.g, r.b): (r.s, r.c) for r in rs._replicate_sums(units, ["g"], 500, 3, rs._signs).collect()}
    few = rs._dealt(units.withColumn("_k", F.xxhash64("unit")), 500)[0]
    assert "_block" in few.columns
    monkeypatch.setattr(rs, "TASK_DRAWS", 20_000)
    dealt, blocks = rs._dealt(units.withColumn("_k", F.xxhash64("unit")), 500)
    assert blocks == 1 and dealt.rdd.getNumPartitions() == 23
    sizes = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.countDistinct("unit").alias("u")).collect()
    assert max(r.n for r in sizes) < 150 and all(r.n == 3 * r.u for r in sizes)
    again = {(r.g, r.b): (r.s, r.c) for r in rs._replicate_sums(units, ["g"], 500, 3, rs._signs).collect()}
    assert again.keys() == plain.keys() and len(plain) == 1500
    assert all(again[k] == pytest.approx(plain[k]) for k in plain)
    # a group sums what one group alone sums
    alone = {r.b: r.s for r in rs._replicate_sums(units.filter("g = 'g1'"), ["g"], 500, 3, rs._signs).collect()}
    assert all(plain["g1", b][0] == pytest.approx(s) for b, s in alone.items())

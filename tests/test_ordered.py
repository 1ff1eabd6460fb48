import random

from pyspark.sql import functions as F

from gradeloom.operators import ordered


def test_asof_matches_brute_force_across_buckets_and_hot_keys(spark):
    rng = random.Random(1)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice("ab")
    right = [(key(), rng.randrange(200), i, f"m{i}") for i in range(150)]
    left = [(key(), rng.randrange(-5, 210), i) for i in range(200)]
    r = spark.createDataFrame(right, "k string, rt long, rs long, msg string")
    l = spark.createDataFrame(left, "k string, t long, id long")
    for width in (1, 7, 1000):
        got = {x.id: (x.rt, x.msg) for x in ordered.asof_backward(l, r, ["k"], "t", "rt", ["msg"], "rs", width).collect()}
        assert len(got) == len(left)
        for k, t, i in left:
            best = max([x for x in right if x[0] == k and x[1] <= t], key=lambda x: (x[1], x[2]), default=None)
            assert got[i] == ((best[1], best[3]) if best else (None, None)), (width, i)


def test_gap_clusters_match_brute_force(spark):
    rng = random.Random(2)
    pts = [("hot" if rng.random() < 0.4 else rng.choice("abc"), rng.randrange(3000), i) for i in range(300)]
    df = spark.createDataFrame(pts, "k string, line long, id long")
    for width in (16, 4096):
        got = {r.id: r.cluster for r in ordered.gap_clusters(df, ["k"], "line", 40, width=width).collect()}
        for k in ("a", "b", "c", "hot"):
            cluster, last = 0, None
            for line, i in sorted((p[1], p[2]) for p in pts if p[0] == k):
                cluster += last is not None and line - last > 40
                last = line
                assert got[i] == cluster


def test_gap_of_forty_joins_and_forty_one_splits(rows):
    df = rows("k string, line long", ("m", 10), ("m", 50), ("m", 91))
    assert [r.cluster for r in ordered.gap_clusters(df, ["k"], "line", 40).orderBy("line").collect()] == [0, 0, 1]


def test_running_number_crosses_buckets(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(500)], "id long")
    got = ordered.running_number(df, "id", width=64).orderBy("id").collect()
    assert [r.position for r in got] == list(range(1, 501))


def test_longest_prefix_wins_and_parent_steps_are_refused(rows):
    paths = rows("path string", ("/a/b/c.py",), ("/a/x.py",), ("/a/b/../c.py",), ("/z/q.py",), ("/ab/c.py",))
    roots = rows("prefix string, root string", ("/a", "A"), ("/a/b", "AB"))
    got = {r.path: (r.root, r.relative) for r in ordered.longest_prefix(paths, roots).collect()}
    assert got == {"/a/b/c.py": ("AB", "c.py"), "/a/x.py": ("A", "x.py"), "/a/b/../c.py": (None, None),
                   "/z/q.py": (None, None), "/ab/c.py": (None, None)}


def test_keep_first_and_group_limit_plan(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, ingest_seq long, v string")
    assert {(r.k, r.v) for r in ordered.keep_first(df, ["k"]).collect()} == {("a", "y"), ("b", "z")}
    plan = ordered.top_per_group(df, ["k"], ["ingest_seq"], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_previous_value_crosses_buckets(spark):
    rng = random.Random(8)
    pts = sorted({("hot" if rng.random() < 0.6 else "k", rng.randrange(500)) for _ in range(200)})
    df = spark.createDataFrame([(k, p, f"v{p}") for k, p in pts], "k string, p long, v string")
    for width in (8, 10000):
        got = {(r.k, r.p): r.prev for r in ordered.previous_value(df, ["k"], F.col("p"), "v", "prev", width).collect()}
        for k in ("hot", "k"):
            own = [p for kk, p in pts if kk == k]
            assert [got[(k, p)] for p in own] == [None] + [f"v{p}" for p in own[:-1]]

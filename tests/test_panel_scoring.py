from pyspark.sql import functions as F

from gradeloom.operators import mutation, panel, scoring

POOL = "task_id string, codebase string, module string, bug_id string, line long, depth string, difficulty string, test_node string, ingest_seq long"


def pool(rows, *codebases, trivial=()):
    out, i = [], 0
    for cb, n in codebases:
        for k in range(n):
            i += 1
            out.append((f"{cb}{k}", cb, "m.py", f"b{k}", k, "function", "trivial" if cb in trivial else ("hard" if k % 3 == 0 else "moderate"), f"n{k}", i))
    return rows(POOL, *out)


def test_equal_quota_with_the_remainder_to_the_largest(rows):
    p = pool(rows, ("a", 10), ("b", 30), ("c", 20))
    chosen = panel.select_panel(p, target=10)
    assert {r.codebase: r["count"] for r in chosen.groupBy("codebase").count().collect()} == {"a": 3, "b": 4, "c": 3}
    assert {r.difficulty for r in chosen.collect()} == {"hard"}
    gap = {r.codebase: (r.surplus, r.empty) for r in panel.panel_surplus(p, chosen, 10, rows("codebase string", ("a",), ("nothing",))).collect()}
    assert gap == {"a": (7, False), "nothing": (0, True)}


def test_trivial_tasks_only_where_nothing_else_exists(rows):
    p = pool(rows, ("a", 4), ("t", 4), trivial=("t",)).unionByName(rows(POOL, ("a9", "a", "m.py", "b9", 0, "function", "trivial", "n", 99)))
    got = panel.select_panel(p, target=20).collect()
    assert sum(r.codebase == "t" for r in got) == 4 and not any(r.task_id == "a9" for r in got)


def test_manifest_hash_ignores_order_and_notices_membership(rows):
    p = pool(rows, ("a", 3), ("b", 3))
    h = lambda df: panel.manifest_hash(df).first().manifest_hash
    assert h(p) == h(p.orderBy(F.desc("task_id"))) != h(p.filter("task_id <> 'a0'"))


def test_round_robin_and_nested_samples(rows):
    p = pool(rows, ("a", 5), ("b", 1), ("c", 3))
    assert [r.task_id for r in panel.round_robin_subset(p, 6).collect()] == ["a0", "b0", "c0", "a1", "c1", "a2"]
    ten = [r.task_id for r in panel.seeded_sample(p, 4, 7).collect()]
    assert [r.task_id for r in panel.seeded_sample(p, 8, 7).collect()][:4] == ten


def test_combinations_use_distinct_nodes_and_three_moderates_are_hard(rows):
    bugs = rows("codebase string, module string, line long, bug_id string, test_node string, difficulty string",
                ("c", "m", 1, "b1", "n1", "moderate"), ("c", "m", 20, "b2", "n2", "moderate"), ("c", "m", 40, "b3", "n3", "moderate"),
                ("c", "m", 41, "b4", "n3", "trivial"), ("c", "m", 300, "far", "n9", "hard"))
    got = panel.combinations(panel.proximity_clusters(bugs)).collect()
    assert sorted((r.bugs_total, r.span_lines, r.difficulty) for r in got) == [(2, 19, "moderate"), (2, 20, "moderate"), (3, 39, "hard")]
    assert len({r.task_id for r in got}) == 3


def test_missing_tests_score_zero_and_stay(rows):
    bug_map = rows("task_id string, bug_id string, test_node string", ("t", "b1", "n1"), ("t", "b2", "n2"), ("t", "b3", "gone"))
    out = rows("task_id string, nodeid string, outcome string, ingest_seq long", ("t", "n1", "failed", 1), ("t", "n1", "passed", 2), ("t", "n2", "skipped", 3))
    bugs = scoring.score_bugs(bug_map, out)
    got = {r.bug_id: (r.passed, r.errored, r.value) for r in bugs.collect()}
    assert got == {"b1": (True, False, 1.0), "b2": (False, False, 0.0), "b3": (False, True, 0.0)}
    files = {r.task_id: r for r in scoring.file_scores(bugs, rows("task_id string", ("t",), ("empty",))).collect()}
    assert files["t"].per_bug_score == 0.333333 and not files["t"].file_clear
    assert files["empty"].per_bug_score == 0.0 and not files["empty"].file_clear


def test_gate_and_monotonicity(rows):
    schema = "task_id string, known string, bugs_fixed long, bugs_total long"
    ok = scoring.oracle_gate(rows(schema, ("g", "good", 2, 2), ("b", "bad", 0, 2))).first()
    assert ok.passed and ok.good_mean == 1.0 and ok.bad_mean == 0.0
    broken = scoring.oracle_gate(rows(schema, ("g", "good", 0, 2), ("b", "bad", 1, 2))).first()
    assert not broken.passed and not broken.monotone and broken.good_failures == 1 and broken.bad_failures == 1


TRIAL = "task_id string, state string, passed long, total long, feedback string"


def test_noise_floor(rows):
    steady = [("t", "buggy", 0, 2, "f")] * 3 + [("t", "fixed", 2, 2, "f")] * 3
    assert scoring.noise_floor(rows(TRIAL, *steady)).first().passed
    flaky = scoring.noise_cells(rows(TRIAL, *steady, ("t", "fixed", 1, 2, "f")))
    assert {r.state: (r.failure, r.spread) for r in flaky.collect()} == {"buggy": (None, 0.0), "fixed": ("scores varied", 0.5)}
    assert scoring.noise_cells(rows(TRIAL, *steady, ("t", "fixed", 2, 2, "g"))).filter("failure = 'feedback varied'").count() == 1
    assert scoring.noise_cells(rows(TRIAL, *steady[:2])).first().failure == "too few repeats"
    assert not scoring.noise_floor(rows(TRIAL, *steady).limit(0)).first().passed


def test_repeats_reduce_to_the_mode_with_ties_to_the_larger(rows):
    df = rows("k string, score double", ("tie", 0.0), ("tie", 1.0), ("all", 1.0), ("all", 1.0), ("most", 0.0), ("most", 0.0), ("most", 1.0))
    got = {r.k: (r.score, r.majority, r.unanimous) for r in scoring.reduce_repeats(df, ["k"]).collect()}
    assert got == {"tie": (1.0, False, False), "all": (1.0, True, True), "most": (0.0, True, False)}


def test_flips_need_a_failure_before(rows):
    df = rows("task_id string, nodeid string, state string, outcome string, ingest_seq long",
              ("t", "n1", "buggy", "passed", 1), ("t", "n1", "fixed", "passed", 2), ("t", "n2", "buggy", "error", 3), ("t", "n2", "fixed", "passed", 4),
              ("t", "n3", "fixed", "passed", 5))
    assert [(r.test_node, r.n_flipped) for r in scoring.flipped_tests(df).collect()] == [("n2", 1)]


def test_render_pages_join_to_the_whole(rows):
    df = rows("task_id string, nodeid string, outcome string, ingest_seq long", *[("t", f"n{i}", "failed" if i % 2 else "error", i) for i in range(25)], ("u", "n", "passed", 99))
    pages = scoring.render_failures(df, lines_per_page=10, label="run").orderBy("page").collect()
    text = "".join(p.text for p in pages)
    assert len(pages) == 3 and text.startswith("# run\nFAILED n0 [Error]\nFAILED n1 [Failure]\n") and text.endswith("--- 25 failed / 25 executed ---\n")
    assert {p.task_id for p in pages} == {"t"}


def test_mutants_and_their_application(rows):
    files = rows("path string, text string", ("m.py", "def f(a, b):\n    if a < b and a != b:\n        # a < b\n        return a + b\n    return None"))
    code = mutation.code_lines(files)
    got = {(r.n, r.operator): (r.symbol, r.mutated.strip(), r.difficulty) for r in mutation.mutants(code).collect()}
    assert got[(2, "lt")] == ("f", "if a > b and a != b:", "moderate")
    assert got[(2, "and")][1] == "if a < b or a != b:" and got[(4, "add")][1] == "return a - b" and got[(5, "none")] == ("f", "return 0", "trivial")
    assert not any(n == 3 for n, _ in got)
    chosen = mutation.mutants(code).filter("operator in ('lt', 'and', 'none')")
    out = mutation.apply_mutants(code, chosen).first()
    assert out.applied == 3 and out.text == "def f(a, b):\n    if a > b or a != b:\n        # a < b\n        return a + b\n    return 0"


def test_focus_window_moves_inward_at_the_ends(rows):
    text = "\n".join(f"line {i}" for i in range(1, 101))
    df = rows("text string, focus_line int", (text, 1), (text, 50), (text, 100), ("short", 1))
    got = mutation.focus_window(df, budget=600).collect()
    assert [(r.truncated, r.lines_before, r.lines_after) for r in got] == [(True, 0, 90), (True, 44, 46), (True, 90, 0), (False, 0, 0)]
    assert got[1].window.split("\n")[0] == "line 45"


def test_search_replace(rows):
    block = lambda s, r: f"<<<<<<< SEARCH\n{s}\n=======\n{r}\n>>>>>>> REPLACE"
    df = rows("b string, r string", ("x x", block("x", "y")), ("a\nb", block("a", "c") + "\n" + block("  b  ", " d ")), ("a", block("zz", "y")), ("a", "no block"))
    assert [r[0] for r in df.select(mutation.apply_search_replace(F.col("b"), F.col("r"))).collect()] == ["y x", "c\nd", "a", "a"]

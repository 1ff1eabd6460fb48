import json
import random
from difflib import unified_diff

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import commits, curation, grading, linediff, mining
from gradeloom.sources import transcripts

GUARD_BEFORE = "def average(values):\n    total = sum(values)\n    return total / len(values)\n"
GUARD_AFTER = "def average(values):\n    if not values:\n        return 0.0\n    total = sum(values)\n    return total / len(values)\n"
RENAME_AFTER = "def mean(items):\n    acc = sum(items)\n    return acc / len(items)\n"


@pytest.fixture
def categorized(rows):
    df = rows("task_id string, goal string, buggy string, reference_fix string, file_name string, category string",
              ("guard", "it crashes on an empty list", GUARD_BEFORE, GUARD_AFTER, "a.py", ""),
              ("rename", "clearer naming", GUARD_BEFORE, RENAME_AFTER, "a.py", "unclassified"),
              ("docs", "wording", "x = 'old text'\n", "x = 'new text'\n", "a.py", None),
              ("same", "crash", "x = f(1)", " x = f(1) ", "a.py", None),
              ("config", "change the limit", "a: 1\nb: g(2)\n", "a: 1\nb: g(3)\n", "app.yaml", None),
              ("option", "more", "f(\n    a=1,\n)", "f(\n    a=1,\n    limit = 3,\n)", "a.py", None),
              ("kept", "crash", GUARD_BEFORE, GUARD_AFTER, "a.py", "feature_addition"), ("blank", "crash", "", "x", "a.py", None))
    return {r.task_id: r for r in curation.categorize(df).collect()}


def test_categories(categorized):
    got = {k: (r.category, r.category_confidence) for k, r in categorized.items()}
    assert got["guard"] == ("bug_fix", 0.95)
    assert got["rename"] == ("refactor", 0.9)
    assert got["docs"] == ("documentation", 0.85)
    assert got["same"] == ("ambiguous", 0.9) and got["blank"] == ("ambiguous", 0.2)
    assert got["config"] == ("configuration", 0.7)
    assert got["option"] == ("feature_addition", 0.72)
    assert categorized["kept"].category == "feature_addition"


def test_a_moved_line_is_taken_out_and_put_in(rows):
    df = rows("id int, buggy string, reference_fix string, sign string", (1, "a\nb\nc", "b\na\nc", "x"), (2, "same", "same", "x"), (3, None, "new", "x"), (4, "", None, "x"))
    got = sorted(tuple(r) for r in linediff.changed_lines(df, "id").collect())
    assert got == [(1, "+", 1, "b"), (1, "-", 2, "b"), (3, "+", 1, "new"), (3, "-", 1, "")]
    assert linediff.changed_lines(df.where("false"), "id").collect() == []


def test_changes_equal_a_unified_diff_and_rebuild_the_new_text(rows):
    rng = random.Random(6)
    pairs = []
    for i in range(60):
        old = [rng.choice(["x = 1", "y", "", "}", "  return z", f"n{rng.randint(0, 50)}"]) for _ in range(rng.choice([0, 5, 40, 260]))]
        new = list(old)
        for _ in range(rng.randint(0, 5)):
            part = [new.pop(rng.randrange(len(new)))] if new and rng.random() < 0.7 else ["added"]
            at = rng.randint(0, len(new))
            new[at:at] = part * rng.randint(0, 2)
        pairs.append((i, "\n".join(old), "\n".join(new)))
    df = rows("id int, buggy string, reference_fix string", *pairs).repartition(3)
    changes = linediff.changed_lines(df, "id").cache()
    got = {}
    for r in sorted(changes.collect(), key=lambda r: (r.id, r.sign, r.n)):
        got.setdefault((r.id, r.sign), []).append(r.text)
    for i, old, new in pairs:
        lines = list(unified_diff(old.split("\n"), new.split("\n"), lineterm="", n=0))[2:]
        for sign in "-+":
            assert got.get((i, sign), []) == [x[1:] for x in lines if x.startswith(sign)]
    rebuilt = {r.id: r.rebuilt for r in linediff.apply_changes(df, changes, "id").collect()}
    assert all((rebuilt.get(i) or "") == new for i, _, new in pairs)


def test_changed_lines_have_real_positions_and_count_copies(rows):
    df = rows("id string, buggy string, reference_fix string", ("p", "a\nb\na\nc", "a\nx\nc\ny"), ("q", "same", "same"))
    got = sorted((r.sign, r.n, r.text) for r in linediff.changed_lines(df, "id").collect())
    assert got == [("+", 2, "x"), ("+", 4, "y"), ("-", 2, "b"), ("-", 3, "a")]


def test_goal_relevance(rows):
    df = rows("g string, c string", ("fix load_table when empty", "def load_table(path): pass"), ("continue", "def load_table(): pass"),
              ("load_table uses parse_rows", "def load_table(): parse_rows()"), ("", "x"))
    got = [r[0] for r in df.select(curation.goal_relevance(F.col("g"), F.col("c"), F.lit("a.py"))).collect()]
    assert got == [0.75, 0.0, 0.5, 0.0]


def test_dedupe_ignores_names_and_keeps_the_first(rows):
    df = rows("task_id string, buggy string, reference_fix string, ingest_seq long", ("late", "y = y + 1", "z", 9), ("first", "x = x + 1", "w", 2), ("other", "x = y + 1", "w", 3))
    assert {r.task_id for r in curation.dedupe_tasks(df).collect()} == {"first", "other"}


def test_goal_synthesis_keeps_the_old_goal(rows):
    t = rows("task_id string, category string, goal string", ("a", "bug_fix", "continue"), ("b", "refactor", "x"), ("c", "bug_fix", "y"))
    a = rows("task_id string, summary string, defect string, trigger string", ("a", " sums ", "skips last", ""), ("b", "s", "d", ""), ("c", "s", "", ""))
    got = {r.task_id: (r.goal, r.goal_source, r.original_goal) for r in curation.merge_synthesized_goals(t, a).collect()}
    assert got == {"a": ("sums Defect: skips last", "synth", "continue"), "b": ("x", "user", ""), "c": ("y", "user", "")}


def test_episodes_take_first_before_and_last_after(rows):
    df = rows("session_id string, goal_ts long, path string, ts long, ingest_seq long, goal string, buggy string, fixed string, fix_signal long, feat_signal long",
              ("s", 1, "p", 3, 3, "g", "b", "c", 1, 0), ("s", 1, "p", 2, 2, "g", "a", "b", 4, 1), ("s", 5, "p", 6, 6, "g", "same", "same ", 0, 0))
    got = mining.episodes(df).collect()
    assert [(r.buggy, r.fixed, r.n_edits, r.fix_signal, r.ts) for r in got] == [("a", "c", 2, 4, 2)]


def test_hard_sessions(rows):
    events = [("s", i, i, "text", None, None, None, None, None, "still not working, same error") for i in range(4)]
    events += [("s", 10, 10, "tool", "edit", "/p/a.py", "x", "y\nz", None, None), ("s", 11, 11, "tool", "write", "/p/b.py", None, None, None, None),
               ("s", 12, 12, "tool", "bash", None, None, None, "git restore .", None), ("easy", 1, 1, "text", None, None, None, None, None, "fine")]
    df = rows("session_id string, ts long, seq long, part_type string, tool string, path string, old string, new string, command string, text string", *events)
    info = rows("session_id string, title string", ("s", "async lock trouble"), ("easy", ""))
    got = mining.hard_sessions(df, info, min_turns=5).collect()
    assert [(r.session_id, r.turns, r.tool_calls, r.edits, r.fix_file, r.fix_changed_lines) for r in got] == [("s", 7, 3, 2, "/p/a.py", 2)]
    assert got[0].struggle_hits == 4 * 3 + 1 and got[0].categories == ["async_concurrency"] and got[0].struggle_ratio == 1.0


def test_hard_sessions_count_unfinished_calls_and_keep_to_roots(rows):
    tool = lambda name, status, **given: json.dumps({"type": "tool", "tool": name, "state": {"status": status, "input": given}})
    data = [json.dumps({"type": "text", "text": "still not working"}), tool("bash", "error", command="git restore ."), tool("bash", "running", command="git stash"),
            tool("edit", "error", filePath="/r/a.py", oldString="x", newString="y\nz\nw"), tool("write", "completed", filePath="/o/b.py", content="c"), "{broken"]
    parts = rows("id long, session_id string, time_created long, data string", *[(i, "s", i, d) for i, d in enumerate(data)])
    info, events = rows("session_id string, title string", ("s", "t")), transcripts.part_events(parts, finished=False)
    wanted = lambda **more: [(r.turns, r.tool_calls, r.edits, r.struggle_hits, r.fix_file, r.fix_changed_lines, r.symptom)
                             for r in mining.hard_sessions(events, info, 6, 1, 1, **more).collect()]
    hits = wanted()[0][3]
    assert hits >= 3 and wanted() == [(6, 4, 2, hits, "/r/a.py", 3, "still not working")]
    assert wanted(roots=["/r"]) == [(6, 3, 1, hits, "/r/a.py", 3, "still not working")]
    assert wanted(roots=["/other/"]) == []
    assert transcripts.part_events(parts).count() == 2


def test_hard_sessions_query_counts_every_part(spark):
    from gradeloom.plans import catalog, views
    sf = "/root/testdata/sf0.001"
    got = catalog.QUERIES["hard_sessions"](spark, sf)
    assert {"categories", "symptom"} <= set(got.columns)
    turns = {r.session_id: r["count"] for r in views.parts(spark, sf).groupBy("session_id").count().collect()}
    found = got.collect()
    assert found and all(r.turns == turns[r.session_id] for r in found)


def test_read_payloads(rows):
    body = lambda inner, foot="": f"<path>/p</path>\n<type>file</type>\n<content>\n{inner}{foot}\n</content>"
    df = rows("o string", (body("1: a\n2: b"),), (body("1: a\n2: b", "\n(Showing lines 1-2 of 2. End)"),), (body("1: a", "\n(Showing lines 1-50 of 200. More)"),),
              ("nothing",), (body("5: a\n6: b", "\n(Showing lines 5-6 of 6. End)"),))
    assert [r[0] for r in df.select(transcripts.read_body(F.col("o"), "reject")).collect()] == ["a\nb", None, None, None, None]
    assert [r[0] for r in df.select(transcripts.read_body(F.col("o"), "window")).collect()] == [None, "a\nb", None, None, None]


def test_snapshots_refuse_forbidden_paths_and_cut_texts(rows):
    text = "\n".join(["x"] * 20)
    df = rows("part_type string, tool string, path string, content string, output string, ts long, session_id string, seq long",
              ("tool", "write", "/r/a.py", text + "\nf()", None, 1, "s", 1), ("tool", "write", "/r/.env", text + "\nf()", None, 2, "s", 2),
              ("tool", "write", "/r/b.py", text + "\nf(", None, 3, "s", 3), ("tool", "write", "/r/c.py", "f()", None, 4, "s", 4),
              ("tool", "write", "/other/a.py", text + "\nf()", None, 5, "s", 5))
    assert [r.file_path for r in transcripts.snapshots(df, ["/r"]).collect()] == ["/r/a.py"]


def test_commit_triage(rows):
    log = rows("sha string, subject string", ("1", "fix(core): x"), ("2", "Fix: y"), ("3", "feat: z"), ("4", "fix things"), ("5", "hotfix: w"))
    files = rows("sha string, path string", ("1", "src/a.py"), ("1", "tests/test_a.py"), ("2", "tests/test_a.py"), ("5", "src/x.spec.ts"), ("5", "src/x.ts"))
    got = {r.sha: (r.source_files, r.test_files, r.reject_reason) for r in commits.triage(log, files, "o/r").collect()}
    assert set(got) == {"1", "2", "5"}
    assert got["1"] == (1, 1, "") and got["2"][2].startswith("no source") and got["5"] == (1, 1, "")


def test_conventional_tests(rows):
    df = rows("path string", ("pkg/a.py",), ("pkg/tests/test_a.py",), ("tests/a_test.py",), ("pkg/b.py",))
    got = {(r.path, r.test_path) for r in commits.source_test_pairs(df).collect()}
    assert got == {("pkg/a.py", "pkg/tests/test_a.py"), ("pkg/a.py", "tests/a_test.py")}


def test_diagnosis_location_rules(rows):
    t = rows("task_id string, buggy string, reference_fix string", ("t", "a = 1\nb = 2\nc = 3", "a = 1\nif not b:\n    b = 5\nc = 3"))
    p = rows("task_id string, fault_location string, bug_category string, judge_agreement double, id int",
             ("t", "  b = 2", "null_handling", 1.0, 0), ("t", "Line 2", "boundary", 0.7, 1), ("t", "line 3", "x", 0.1, 2), ("t", "", None, None, 3), ("t", "c = 3", "none", 5.0, 4))
    got = {r.id: (r.location_match, r.category_match, r.total) for r in grading.score_diagnoses(t, p).collect()}
    assert got[0] == (1.0, 1.0, 1.0) and got[1] == (1.0, 0.5, 0.81) and got[2] == (0.0, 0.0, 0.03) and got[3] == (0.0, 0.0, 0.0)
    assert got[4] == (1.0, 0.0, 0.8)


def test_repair_scores(rows):
    t = rows("task_id string, buggy string, reference_fix string", ("t", GUARD_BEFORE, GUARD_AFTER))
    a = rows("task_id string, candidate string, judge_agreement double, oracle_score double, id int",
             ("t", GUARD_BEFORE, 1.0, None, 0), ("t", f"```python\n{GUARD_AFTER}```", 1.0, None, 1), ("t", GUARD_AFTER, 0.5, 1.0, 2), ("t", "", 1.0, None, 3))
    got = {r.id: (r.unchanged, r.patch_similarity, r.total, r.rank_score) for r in grading.score_repairs(a, t).collect()}
    assert got[0] == (True, 0.0, 0.0, 0.0) and got[1] == (False, 1.0, 1.0, 1.0)
    assert got[2] == (False, 1.0, 0.75, 0.6) and got[3] == (False, 0.0, 0.5, 1.0)


def test_empty_prediction_never_matches(rows):
    p = rows("task_id string, mode string, model string, predicted_symbol string", ("t", "m", "a", ""), ("t", "m", "b", "LOAD"), ("t", "m", "c", "load_all_rows"), ("t", "m", "d", "x"))
    got = {r.model: r.identified for r in grading.symbol_matches(p, rows("task_id string, symbol string", ("t", "load_all"))).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": False}


def test_touched_symbols_equal_all_pairs_and_never_multiply(spark, rows):
    rng = random.Random(11)
    spans = [(t, f"s{i}", a, a + rng.choice([0, 3, 40, 400])) for t in (1, 2) for i in range(60) for a in [rng.randint(1, 500)]]
    changes = [(t, "-", rng.randint(1, 600), "x") for t in (1, 2, 3) for _ in range(12)]
    df, at = rows("task_id int, symbol string, start_line int, end_line int", *spans), rows("task_id int, sign string, n int, text string", *changes)
    want = {(t, s) for t, s, a, b in spans if any(u == t and a <= n <= b for u, _, n, _ in changes)}
    for width in (7, 1 << 14):
        assert {tuple(r) for r in grading.touched_symbols(at, df, width=width).collect()} == want
    many = spark.range(100_000).selectExpr("1 AS task_id", "concat('s', id) AS symbol", "cast(id AS int) AS start_line", "100000 AS end_line")
    lines = spark.range(100_000).selectExpr("1 AS task_id", "'-' AS sign", "cast(id AS int) AS n", "'x' AS text")
    assert grading.touched_symbols(lines, many).count() == 100_000


def test_changed_lines_hold_few_pairs_in_python(rows):
    """An Arrow batch has ten thousand pairs of whole texts; a row-wise function gets some hundred."""
    df = rows("id int, buggy string, reference_fix string", (1, "a\nb", "a\nc\nd"), (2, None, "x"), (3, "same", "same"))
    changes = linediff.changed_lines(df, "id")
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan and plan.count("_pair_changes(") <= 2
    assert changes.columns == ["id", "sign", "n", "text"]
    assert sorted(map(tuple, changes.collect())) == [(1, "+", 2, "c"), (1, "+", 3, "d"), (1, "-", 2, "b"), (2, "+", 1, "x"), (2, "-", 1, "")]

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import boards, integrity, outcomes
from gradeloom.operators.membership import maybe_in
from gradeloom.plans import boards_queries
from gradeloom.schemas import RESULT
from gradeloom.streaming.live_board import LiveDecisionBoard

CODE = "def f(x):\n    return x + 1  # long enough to be compared with the buggy text"
BUGGY = "def f(x):\n    return x - 1  # the original text of this task, before any repair"


@pytest.fixture
def results(spark):
    def make(*rows):
        base = {f.name: None for f in RESULT}
        out = []
        for i, r in enumerate(rows):
            row = {**base, "model": "m", "task_id": f"t{i}", "ts": 0, **r}
            for stage in ("diagnose", "repair", "repair_given"):
                if row[stage] is not None:
                    row[stage] = {f.name: row[stage].get(f.name) for f in RESULT[stage].dataType}
            out.append(tuple(row[f.name] if not isinstance(row[f.name], dict) else tuple(row[f.name].values()) for f in RESULT))
        return spark.createDataFrame(out, RESULT).withColumn("ingest_seq", F.monotonically_increasing_id())
    return make


def test_transport_errors(rows):
    cases = {"HTTP 429": (True, "rate_limited"), "HTTP 503 busy": (True, "server"), "read timed out": (True, "timeout"),
             "HTTP 400 bad": (False, "bad_request"), "HTTP 401": (False, "auth"), "HTTP 404": (False, "not_found"),
             "quota reached": (False, "quota_exhausted"), "strange": (False, "unknown"), "HTTP 400 after timeout": (False, "bad_request")}
    df = rows("e string", *[(c,) for c in cases], ("",), (None,))
    got = {r.e: r.c for r in df.select("e", outcomes.classify_error(F.col("e")).alias("c")).collect()}
    assert {k: (v.retryable, v.kind) for k, v in got.items() if v} == cases
    assert got[""] is None and got[None] is None


def test_state_precedence(results):
    df = results(
        {"tainted": "x", "repair_error": "timed out"}, {"repair_error": "no filesystem isolation HTTP 429"}, {"diagnose_error": "HTTP 503"},
        {"repair": {"candidate": " "}}, {"repair": {"candidate": "just words"}}, {"empty_reply": True}, {"repair": {"candidate": CODE}}, {})
    got = {r.task_id: r.state for r in outcomes.with_state(df).collect()}
    assert [got[f"t{i}"] for i in range(8)] == ["tainted", "policy_blocked", "infra_error", "invalid_response", "invalid_response",
                                                "invalid_response", "completed", "completed"]


def test_attempt_outcomes(rows):
    df = rows("r string, patch boolean, tools boolean, err string, smuggled boolean",
              ("", False, False, None, False), ("I cannot help with that", True, False, None, False), ("<tool_call>", False, True, None, False),
              ("NO_CHANGES", False, False, None, False), ("hm", False, False, None, False), ("diff", True, False, None, False),
              ("diff", True, False, "http_524", False), ("diff", True, False, "", True))
    c = outcomes.attempt_outcome(F.col("r"), F.col("patch"), F.col("tools"), F.col("err"), F.col("smuggled"))
    assert [r[0] for r in df.select(c).collect()] == ["invalid_response", "refused", "needs_tools", "declined_work", "invalid_response",
                                                     "scored", "transport", "policy_violation"]


def test_reply_parsing(rows):
    df = rows("r string", ('Sure:\n```json\n{"Root Cause": "x", "line": "4", "category": "", "type": "logic"}\n```',),
              ("```diff\n--- a/m.py\n+++ b/m.py\n@@ -1 +1 @@\n-a\n+b\n```",), ("--- a/m.py\n+++ b/other.py\n@@",), (None,))
    got = [r.p for r in df.select(outcomes.parse_reply(F.col("r")).alias("p")).collect()]
    assert (got[0].root_cause, got[0].fault_location, got[0].bug_category) == ("x", "4", "logic")
    assert got[1].has_diff and not got[2].has_diff
    assert got[3].code == "" and not got[3].wants_tools


def test_latest_row_wins_and_ties_go_to_the_later_arrival(results):
    df = results({"task_id": "t", "ts": 5, "combined": 0.1}, {"task_id": "t", "ts": 9, "combined": 0.2},
                 {"task_id": "t", "ts": 9, "combined": 0.3}, {"task_id": "u", "ts": None, "combined": 0.4})
    got = {r.task_id: r.combined for r in boards.latest_per_task(df.coalesce(1)).collect()}
    assert got == {"t": 0.3, "u": 0.4}


def test_utility_and_wilson(rows):
    df = rows("c double, k long, n long", (80.0, 10, 20), (80.0, 0, 0))
    lo, hi = boards.wilson(F.col("k"), F.col("n"))
    got = df.select(boards.utility(F.col("c"), F.col("k"), F.col("n")).alias("u"), lo.alias("lo"), hi.alias("hi")).collect()
    assert got[0].u == 40.0 and got[1].u == 0.0
    assert got[0].lo == pytest.approx(0.2993, abs=1e-4) and got[0].hi == pytest.approx(0.7007, abs=1e-4)
    assert (got[1].lo, got[1].hi) == (0.0, 0.0)


def tasks(rows, n=20):
    return rows("task_id string, buggy string, reference_fix string", *[(f"t{i}", BUGGY, CODE + f" {i}") for i in range(n)])


def test_decision_board_keeps_dead_endpoints_apart(results, rows):
    good = {"repair": {"candidate": CODE, "judge_agreement": 1.0, "latency_ms": 100}, "diagnose": {"location_match": 1.0, "judge_agreement": 0.9}}
    df = results(*[{"model": "ok", "task_id": f"t{i}", "combined": 0.8, **good} for i in range(16)],
                 *[{"model": "few", "task_id": f"t{i}", "combined": 0.9, **good} for i in range(3)],
                 *[{"model": "dead", "task_id": f"t{i}", "repair_error": "HTTP 429"} for i in range(4)],
                 *[{"model": "gone", "task_id": f"t{i}", "repair_error": "HTTP 404"} for i in range(4)])
    lanes = rows("model string, can_read boolean", ("ok", False))
    board = {r.model: r for r in boards.decision_board(df, tasks(rows), lanes, show_exhausted=True).collect()}
    assert board["ok"].status == "ok" and board["ok"].capability == 80.0 and board["ok"].utility == 80.0 and board["ok"].bugs_found == 16
    assert board["few"].status == "insufficient_coverage" and board["few"].reason == "only 3/20 tasks completed"
    assert board["dead"].status == "unavailable" and board["dead"].reason == "rate_limited (retryable)" and board["dead"].capability is None
    assert board["gone"].reason == "not_found (do not retry)"
    assert {r.model for r in boards.decision_board(df, tasks(rows), lanes).collect()} == {"ok", "few"}


def test_live_decision_board_takes_back_what_newer_rows_replace(results, rows, spark, tmp_path):
    good = {"repair": {"candidate": CODE, "judge_agreement": 1.0, "latency_ms": 100}, "diagnose": {"location_match": 1.0, "judge_agreement": 0.9}}
    lanes = rows("model string, can_read boolean", ("a", True), ("b", False))
    df = results(*[{"model": m, "task_id": f"t{i}", "ts": 1, "combined": 0.8, **good} for m in "ab" for i in range(16)],
                 *[{"model": "c", "task_id": "t1", "ts": 1, "combined": 0.5, **good}],
                 # second batch: a worse answer, a stored taint, an error, an older row that changes nothing
                 {"model": "a", "task_id": "t0", "ts": 9, "combined": 0.2, **good}, {"model": "a", "task_id": "t1", "ts": 9, "tainted": "x", **good},
                 {"model": "a", "task_id": "t2", "ts": 9, "repair_error": "HTTP 429"}, {"model": "a", "task_id": "t3", "ts": 0, "combined": 0.1, **good},
                 {"model": "c", "task_id": "t1", "ts": 2, "tainted": "x", **good}).cache()
    first, second = df.filter("ts = 1"), df.filter("ts <> 1")
    live = LiveDecisionBoard(spark, str(tmp_path), tasks(rows), lanes)
    lines = lambda board: sorted(tuple(r.asDict().items()) for r in board.collect())
    live.write_batch(first, 0)
    assert lines(live.board(True)) == lines(boards.decision_board(first, tasks(rows), lanes, show_exhausted=True))
    for _ in range(2):  # a repeated batch overwrites itself
        live.write_batch(second, 1)
        want = lines(boards.decision_board(df, tasks(rows), lanes, show_exhausted=True))
        assert lines(live.board(True)) == lines(live.recount()) == want
    assert {dict(r)["model"] for r in want} == {"a", "b"}  # c has no trusted row left
    assert spark.read.parquet(f"{tmp_path}/boards/batch=1").select("model").distinct().count() == 2  # b is not counted again
    live.compact()
    live.write_batch(df.filter("model = 'b' AND task_id = 't5'").withColumn("ts", F.lit(20)).withColumn("combined", F.lit(0.1)), 2)
    assert lines(live.board(True)) == lines(live.recount())


def test_read_leak_is_quarantined_only_for_lanes_that_can_read(results, rows):
    ref = CODE + " 0"
    df = results(*[{"model": m, "task_id": "t0", "repair": {"candidate": ref}} for m in ("agent", "chat")],
                 {"model": "chat", "task_id": "t1", "tainted": "earlier"}, {"model": "chat", "task_id": "unknown", "repair": {"candidate": ref}})
    lanes = rows("model string, can_read boolean", ("agent", True), ("chat", False))
    good, bad = integrity.split_trusted(outcomes.with_state(df), tasks(rows), lanes)
    assert {(r.model, r.task_id) for r in good.collect()} == {("chat", "t0"), ("chat", "unknown")}
    assert {(r.model, r.task_id, r.taint) for r in bad.collect()} == {("agent", "t0", "file_read_leak"), ("chat", "t1", "stored")}


def test_integrity_signals(results, rows):
    df = results({"task_id": "t0", "repair": {"candidate": BUGGY, "judge_agreement": 1.0}},
                 {"task_id": "t1", "repair": {"candidate": CODE + " 1"}},
                 {"task_id": "t2", "repair": {"candidate": "other(x) = 1", "raw": "I have fixed it, fixed: true"}},
                 {"task_id": "t3", "repair": {"candidate": "other(x) = 1", "raw": "I'm sorry, as an AI"}},
                 {"task_id": "t4", "repair": {"candidate": "genuine(x) = repair(x)"}}, {"task_id": "t5", "repair_error": "HTTP 429"})
    verdicts = integrity.screen(df, tasks(rows), rows("model string, can_read boolean", ("m", True)))
    got = {r.task_id: (r.fired, r.severity) for r in verdicts.collect()}
    assert got["t0"] == (["echo_input", "judge_gaming"], "high")
    assert got["t1"] == (["verbatim_reproduction", "file_read_leak"], "critical")
    assert got["t2"] == (["judge_gaming"], "medium") and got["t3"] == (["degenerate_output"], "medium")
    assert got["t4"] == ([], "none") and "t5" not in got
    summary = integrity.screen_summary(verdicts).first()
    assert (summary.rows, summary.flagged, summary.flag_rate) == (5, 4, 0.8)


def test_unscored_rows_have_no_score(results, rows):
    df = results({"task_id": "t0", "repair_error": "HTTP 429", "combined": 0.0}, {"task_id": "t1", "repair": {"candidate": CODE}, "combined": 0.0})
    got = {r.task_id: r.score_pct for r in boards.marks(df, tasks(rows)).collect()}
    assert got == {"t0": None, "t1": 0.0}


def test_leader_tie(rows):
    schema = "model string, utility double, capability double, ci95_lo double, ci95_hi double, ranking_eligible boolean"
    tie = boards.leader_ties(rows(schema, ("a", 60.0, 60.0, 40.0, 80.0, True), ("b", 50.0, 50.0, 30.0, 70.0, True), ("c", 90.0, 1.0, 0.0, 1.0, False)))
    assert [(r.model, r.is_tie) for r in tie.orderBy("board_rank").collect()] == [("a", True), ("b", True)]
    clear = boards.leader_ties(rows(schema, ("a", 60.0, 60.0, 71.0, 80.0, True), ("b", 50.0, 50.0, 30.0, 70.0, True)))
    assert not any(r.is_tie for r in clear.collect())


def test_replies_of_any_size_and_depth(rows):
    long = "x" * 1_000_000
    df = rows("i int, r string", (0, 'not {json} then {"defect":"d","line":3}'), (1, '{"defect":"' + long + '"}'), (2, '{"defect":"d","type":{"a":{"b":{"c":1}}}}'),
              (3, '```json\n{"cause":"unterminated"}'), (4, "{" * 200_000), (5, '{"defect":"a }"} {"defect":"second"}'), (6, None), (7, "[1]"))
    got = {x.i: x.p for x in df.select("i", outcomes.parse_reply(F.col("r")).alias("p")).collect()}
    assert (got[0].root_cause, got[0].fault_location) == ("d", "3")
    assert got[1].root_cause == long and got[2].bug_category == '{"a":{"b":{"c":1}}}' and got[3].root_cause == "unterminated"
    assert got[4].root_cause is None and got[5].root_cause == "a }" and got[6].root_cause is None and got[7].root_cause is None


def test_live_decision_board_keeps_little_of_the_answers_on_disk(rows, spark, tmp_path, monkeypatch):
    """Forty answers to a task that repeat its text take about the place of one, and arrive in two micro-batches."""
    text = lambda i: " ".join(f"word{(i * 7919 + n * n * 31) % 10007} = f(x)" for n in range(400))
    rows("doc_id long, text string, lang string, source string", *[(i, text(i), "en", "s") for i in range(6)]).write.parquet(f"{tmp_path}/documents.parquet")
    events = [(n, n % 6, "click" if n % 4 else "buy", float(n % 97), f'{{"k": {n % 100}}}') for n in range(480)]
    rows("event_id long, user_id long, event_type string, value double, props string", *events).withColumn(
        "ts", F.timestamp_seconds(F.col("event_id") % 50).cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(boards_queries, "fresh_path", lambda spark, name: f"{tmp_path}/{name}")
    got = boards_queries.live_decision_board(spark, str(tmp_path)).collect()
    assert sorted(got) == sorted(boards_queries.decision_board(spark, str(tmp_path)).collect()) and len(got) == 2
    files = list((tmp_path / "incoming").glob("part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
    arrived = spark.read.json(f"{tmp_path}/incoming")
    assert arrived.count() == 480 and arrived.select("ingest_seq").distinct().count() == 480
    answers = arrived.agg(F.sum(F.octet_length("repair.candidate"))).first()[0]
    assert answers > 20 * sum(f.stat().st_size for f in files)
    assert sorted(p.name for p in (tmp_path / "live-marks" / "boards").iterdir() if p.is_dir()) == ["batch=0", "batch=1"]


def test_marks_of_a_batch_are_those_of_its_newest_rows(results, rows):
    near, rewritten = BUGGY + "!", "def g(y):\n    return y * 3  # another function, though about as long as the former one is"
    answer = lambda text: {"repair": {"candidate": text, "judge_agreement": 1.0, "latency_ms": 7}, "diagnose": {"location_match": 1.0, "judge_agreement": 0.9, "total": 0.5}}
    texts = (CODE + " 0", BUGGY, near, rewritten, "just words", None)
    df = results(*[{"model": m, "task_id": f"t{i}", "ts": ts, "combined": 0.1 * k, **answer(text)}
                   for k, (m, text) in enumerate((m, text) for m in ("a", "b", None) for text in texts) for i, ts in ((k % 3, -k), (k, k))],
                 *[{"model": "a", "task_id": "t0", "ts": ts, **answer(near)} for ts in (None, 50, 50)],
                 {"model": "a", "task_id": None, **answer(near)}, {"model": "a", "task_id": "unknown", **answer(near)},
                 {"model": "a", "task_id": "t19", **answer(CODE + " 19")}, {"model": "c", "task_id": "t0", "ts": 3, "tainted": "x"}, {"model": "c", "task_id": "t1", "repair_error": "HTTP 429"})
    lanes = rows("model string, can_read boolean", ("a", True), ("b", False))
    twice = tasks(rows).unionByName(tasks(rows, 2).drop("reference_fix").withColumn("reference_fix", F.concat(F.lit(CODE), F.lit(" "), F.substring("task_id", 2, 1))))
    asked = []
    got = boards.decision_marks(df, twice, lanes, lambda step, name: asked.append(name) or step.cache())
    want = boards._mark(integrity.with_taint(outcomes.with_state(boards.latest_per_task(df)), twice, lanes), "ts", "first_seen", "error_class", "taint")
    lines = lambda marks: sorted(map(str, marks.collect()))
    assert got.columns == want.columns and lines(got) == lines(want) and asked == ["newest", "digested"]
    assert got.filter("untouched AND task_id = 't0' AND model = 'a'").count() == 4 and got.filter("taint = 'file_read_leak'").count() > 0
    assert lines(boards.decision_marks(df.limit(0), twice, lanes)) == []


def test_maybe_in_keeps_every_row_of_the_keys(spark):
    keys = spark.range(0, 3000, 3).select(F.when(F.col("id") > 0, F.col("id")).alias("a"), F.concat(F.lit("k"), "id").alias("b"))
    found = {r.id for r in maybe_in(spark.range(100_000), [F.when(F.col("id") > 0, F.col("id")), F.concat(F.lit("k"), "id")], keys).collect()}
    assert found >= set(range(0, 3000, 3)) and len(found) < 100_000 / 8
    assert maybe_in(spark.range(1000), ["id"], spark.range(0)).count() == 0


def test_live_decision_board_shuffles_no_answer(rows, spark, tmp_path, monkeypatch):
    """Answers are many times their tasks' texts; the shuffle files at any time are about one copy of the texts at hand."""
    from threading import Event, Thread
    text = lambda i: " ".join(f"{(i * 7919 + n * n * 104729) % 2**31:x} = f(x)" for n in range(1500))
    rows("doc_id long, text string, lang string, source string", *[(i, text(i), "en", "s") for i in range(40)]).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    events = [(n, n % 40, f"m{n // 40}", float(n % 97), f'{{"k": {50 + n % 45}}}') for n in range(1200)]
    rows("event_id long, user_id long, event_type string, value double, props string", *events).withColumn(
        "ts", F.timestamp_seconds("event_id").cast("timestamp_ntz")).repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(boards_queries, "fresh_path", lambda spark, name: f"{tmp_path}/{name}")
    folders = [f.getPath() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    found = lambda: {p: p.stat().st_size for f in folders for p in Path(f).rglob("shuffle_*") if p.exists()}
    before, most, ended = set(found()), [0], Event()

    def watch():
        while not ended.wait(0.02):
            try:
                most.append(sum(size for p, size in found().items() if p not in before))
            except FileNotFoundError:
                pass
    watcher = Thread(target=watch)
    watcher.start()
    try:
        board = boards_queries.live_decision_board(spark, str(tmp_path))
    finally:
        ended.set()
        watcher.join()
    got = board.collect()
    assert sorted(got) == sorted(boards_queries.decision_board(spark, str(tmp_path)).collect()) and len(got) == 30
    texts = sum(len(text(i)) for i in range(40))
    assert max(most) < 4 * texts
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

import hashlib
import random

from pyspark.sql import functions as F

from gradeloom.operators import timeline


def apply(text, old, new):
    return text.replace(old, new, 1) if old and text.count(old) == 1 else None


def brute_states(edits, anchors):
    out = {}
    for path in {e[0] for e in edits}:
        es = sorted((e for e in edits if e[0] == path), key=lambda e: (e[1], e[2]))
        for _, t, seq, old, new in es:
            usable = [a for a in anchors if a[0] == path and a[1] <= t]
            if not usable:
                continue
            a = max(usable, key=lambda x: (x[1], x[3]))
            text, degraded = a[2], False
            for e in es:
                if a[1] <= e[1] < t:
                    nxt = apply(text, e[3], e[4])
                    degraded, text = (True, text) if nxt is None else (degraded, nxt)
            after = apply(text, old, new)
            if after is not None:
                out[(path, t, seq)] = (text, after, degraded)
    return out


def test_forward_replay_matches_brute_force(spark):
    rng = random.Random(5)
    edits, anchors = [], []
    for f in range(6):
        for i in range(40):
            a, b = rng.sample("abcdef", 2)
            edits.append((f"f{f}", rng.randrange(60), f * 1000 + i, a, b * rng.choice((1, 1, 2))))
        for i in range(3):
            anchors.append((f"f{f}", rng.randrange(-5, 60), "".join(rng.sample("abcdef", 5)), i))
    e = spark.createDataFrame(edits, "file_path string, time long, seq long, old string, new string").withColumn("session_id", F.lit("s"))
    a = spark.createDataFrame(anchors, "file_path string, time long, content string, seq long")
    got = {(r.file_path, r.time, r.seq): (r.before, r.after, r.degraded) for r in timeline.replay_states(e, a, width=8).collect()}
    assert got == brute_states(edits, anchors)


def test_content_at_versions(rows):
    edits = rows("file_path string, time long, seq long, session_id string, old string, new string",
                 ("p", 200, 1, "s", "v = 1", "v = 2"), ("p", 300, 2, "s", "v = 2", "v = 3"))
    anchors = rows("file_path string, time long, content string, seq long", ("p", 100, "v = 1\n", 0))
    at = rows("file_path string, time long", ("p", 150), ("p", 250), ("p", 300), ("p", 50))
    got = {r.time: r.content for r in timeline.content_at(edits, anchors, at).collect()}
    assert got == {150: "v = 1\n", 250: "v = 2\n", 300: "v = 3\n", 50: None}


def test_reverse_replay_is_fail_closed(rows):
    edits = rows("file_path string, time long, seq long, old string, new string",
                 ("ok", 1, 1, "a", "b"), ("ok", 2, 2, "b", "c"), ("bad", 1, 1, "a", "zz"), ("bad", 2, 2, "x", "y"))
    finals = rows("file_path string, final_text string", ("ok", "c!"), ("bad", "yy"))
    steps = timeline.reverse_replay(edits, finals)
    got = {(r.file_path, r.time): (r.applied, r.recovered) for r in steps.collect()}
    assert got[("ok", 2)] == (True, "b!") and got[("ok", 1)] == (True, "a!")
    assert got[("bad", 2)] == (False, None)
    verdicts = {r.file_path: (r.ok, r.reason) for r in timeline.replay_verdicts(steps).collect()}
    assert verdicts == {"ok": (True, ""), "bad": (False, "2 hunk(s) did not apply exactly once")}
    digest = {r.file_path: r.order_digest for r in timeline.order_digest(edits).collect()}
    assert digest["ok"] == hashlib.sha256(b"1:1|2:2").hexdigest()


def test_snapshot_pairs_prefer_the_current_text(rows):
    snaps = rows("file_path string, time long, content string, session_id string, seq long",
                 ("p", 1, "a", "s", 1), ("p", 2, "b", "s", 2), ("p", 3, "c", "s", 3), ("q", 1, "same", "s", 4), ("q", 2, "same ", "s", 5),
                 ("one", 1, "x", "s", 6))
    anchored = timeline.snapshot_pairs(snaps, rows("file_path string, content string", ("p", "b\n"))).collect()
    assert [(r.file_path, r.anchored, r.before, r.after) for r in anchored] == [("p", True, "a", "b")]
    assert [(r.before, r.after) for r in timeline.snapshot_pairs(snaps).collect()] == [("b", "c")]


def test_fix_and_test_window(rows):
    src = rows("test_path string, file_path string, time long, seq long, before string, after string",
               ("t", "p", 100, 1, "", "x" * 30), ("t", "p", 200, 2, "", "x" * 5))
    tst = rows("test_path string, time long, before string, after string", ("t", 150, "", "abc"), ("t", 250, "", "abc"), ("t", 160, "abc", ""), ("t", 100 + 1801, "", "a"))
    got = timeline.fix_test_candidates(src, tst, window=1800, min_size=20).collect()
    assert [(r.fix_time, r.test_time) for r in got] == [(100, 150)]  # 250 follows the tiny edit, 160 shrank, 1901 follows it too

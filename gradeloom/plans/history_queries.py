"""File-history, path and commit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import commits, ordered, timeline
from gradeloom.plans.registry import query, read
from gradeloom.plans.views import (code_files, epoch_seconds, order_anchors, order_events, parts, sql_view, with_views)
from gradeloom.sources.transcripts import part_events, snapshots

WIDTH = 1 << 30  # ticks per bucket: about 107 days of the view's clock

# ---------------------------------------------------------------- replay
sql_view("replayed", """
SELECT e.file_path, e.time, e.seq, e.session_id, 'head <' || (m - 1) || '> tail' AS before, 'head <' || m || '> tail' AS after,
  EXISTS (SELECT 1 FROM order_events b WHERE b.cust = e.cust AND (b.n - 1) // 10 = (e.n - 1) // 10 AND b.n < e.n AND b.n % 7 = 0) AS degraded
FROM order_events e WHERE e.n % 7 <> 0""", ("order_events",))


@query("replayed_states", with_views("replayed", body="SELECT * FROM replayed"))
def replayed_states(spark, sf):
    return timeline.replay_states(order_events(spark, sf), order_anchors(spark, sf), WIDTH)


@query("content_at_moment", with_views("order_events", body="""
SELECT file_path, time, 'head <' || m || '> tail' AS content FROM order_events"""))
def content_at_moment(spark, sf):
    e = order_events(spark, sf)
    return timeline.content_at(e, order_anchors(spark, sf), e.select("file_path", "time"), WIDTH).select("file_path", "time", "content")


def reversed_steps(spark, sf):
    e = order_events(spark, sf)
    finals = e.groupBy("file_path").agg(F.concat(F.lit("head <"), F.max("m").cast("string"), F.lit("> tail")).alias("final_text"))
    return timeline.reverse_replay(e, finals)


@query("reverse_replay", with_views("order_events", body="""
SELECT file_path, time, seq, n % 7 <> 0 AS applied, CASE WHEN n % 7 = 0 THEN 'matched 0 times' ELSE '' END AS reason,
  CASE WHEN n % 7 <> 0 THEN 'head <' || (m - 1) || '> tail' END AS recovered FROM order_events"""))
def reverse_replay(spark, sf):
    return reversed_steps(spark, sf)


VERDICTS = """WITH v AS (SELECT file_path, count(*) FILTER (WHERE n % 7 <> 0) AS applied, count(*) FILTER (WHERE n % 7 = 0) AS skipped FROM order_events GROUP BY file_path),
 r AS (SELECT *, skipped = 0 AND applied > 0 AS ok, CASE WHEN skipped = 0 AND applied > 0 THEN '' ELSE skipped || ' hunk(s) did not apply exactly once' END AS reason FROM v)"""


@query("replay_verdicts", with_views("order_events", body=VERDICTS + " SELECT file_path, applied, skipped, ok, reason FROM r"))
def replay_verdicts(spark, sf):
    return timeline.replay_verdicts(reversed_steps(spark, sf))


@query("quarantine_report", with_views("order_events", body=VERDICTS + """
SELECT ok, reason, count(*) AS files, sum(applied)::BIGINT AS applied, sum(skipped)::BIGINT AS skipped FROM r GROUP BY ok, reason"""))
def quarantine_report(spark, sf):
    return timeline.quarantine_report(replay_verdicts(spark, sf))


@query("edit_order_digests", with_views("order_events", body="""
SELECT file_path, sha256(string_agg(time || ':' || seq, '|' ORDER BY time, seq)) AS order_digest FROM order_events GROUP BY file_path"""))
def edit_order_digests(spark, sf):
    return timeline.order_digest(order_events(spark, sf))


# ---------------------------------------------------------------- snapshots
def file_snapshots(spark, sf):
    e = order_events(spark, sf)
    return e.select("file_path", "time", F.concat(F.lit("head\n"), F.repeat(F.lit("x\n"), (F.col("n") % 4).cast("int")), F.lit("<"),
                                                   F.col("m").cast("string"), F.lit(">")).alias("content"), "session_id", "seq", "cust", "n")


def current_files(spark, sf):
    s = file_snapshots(spark, sf)
    last = s.groupBy("cust", "file_path").agg(F.max("n").alias("last"))
    which = F.when(F.col("cust") % 3 == 0, F.col("last")).when(F.col("cust") % 3 == 1, F.col("last") - 2).otherwise(-1)
    return s.join(last, ["cust", "file_path"]).filter(F.col("n") == which).select(
        "file_path", F.concat("content", F.lit("\n")).alias("content"))


SNAP = """WITH s AS (SELECT file_path, cust, time, n, session_id, seq, 'head' || chr(10) || repeat('x' || chr(10), n % 4) || '<' || m || '>' AS content,
   max(n) OVER (PARTITION BY cust) AS last_n FROM order_events),
 cur AS (SELECT file_path, content FROM s WHERE n = CASE cust % 3 WHEN 0 THEN last_n WHEN 1 THEN last_n - 2 ELSE -1 END),
 r AS (SELECT s.*, row_number() OVER (PARTITION BY s.file_path ORDER BY time DESC, session_id DESC, seq DESC) AS back, coalesce(s.content = cur.content, false) AS anchored
   FROM s LEFT JOIN cur USING (file_path)),
 k AS (SELECT *, lag(content) OVER w AS b, lag(time) OVER w AS bt FROM r WINDOW w AS (PARTITION BY file_path ORDER BY back DESC)),
 p AS (SELECT * FROM k WHERE b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY NOT anchored, back) = 1),
 pairs AS (SELECT file_path, anchored, bt AS before_time, time AS after_time, b AS before, content AS after,
   len(str_split(content, chr(10))) - len(str_split(b, chr(10))) AS gap_lines FROM p WHERE b <> content)"""


def pairs(spark, sf):
    return timeline.snapshot_pairs(file_snapshots(spark, sf), current_files(spark, sf))


@query("snapshot_pairs", with_views("order_events", body=SNAP + " SELECT * FROM pairs"))
def snapshot_pairs(spark, sf):
    return pairs(spark, sf)


@query("snapshot_pair_report", with_views("order_events", body=SNAP + """
SELECT (SELECT count(DISTINCT file_path) FROM s) AS files, (SELECT count(DISTINCT file_path) FROM s WHERE last_n > 1) AS multi_snapshot,
  (SELECT count(*) FROM pairs) AS pairs, (SELECT count(*) FILTER (WHERE anchored) FROM pairs) AS anchored"""))
def snapshot_pair_report(spark, sf):
    return timeline.pair_report(file_snapshots(spark, sf), pairs(spark, sf))


for _policy, _reads in (("window", "session_id % 3 = 0"), ("reject", "session_id % 3 = 2")):
    query(f"cleaned_snapshots_{_policy}", with_views("part_events", body=f"""
SELECT path AS file_path, ts AS time, tool AS source, md5(text) AS content_md5, session_id FROM part_events
WHERE (tool = 'write' OR (tool = 'read' AND {_reads})) AND len(str_split(text, chr(10))) >= 3"""))(
        lambda spark, sf, p=_policy: snapshots(part_events(parts(spark, sf), paths_only=True), ["/work"], min_lines=3, policy=p,
                                               check_ending=False).select(
            "file_path", "time", "source", F.md5("content").alias("content_md5"), "session_id"))


# ---------------------------------------------------------------- fixes and tests
def states(spark, sf, side):
    e = order_events(spark, sf).filter(F.col("cust") % 2 == side)
    p = F.floor(F.col("price")).cast("int")
    return e.select(
        F.concat(F.lit("t"), F.floor(F.col("cust") / 2).cast("string")).alias("test_path"), "file_path", "time", "seq",
        F.repeat(F.lit("x"), p % 50).alias("before"), F.repeat(F.lit("x"), (p * 7) % 90).alias("after"))


@query("fix_test_candidates", with_views("order_events", body="""
WITH st AS (SELECT 't' || (cust // 2) AS test_path, cust % 2 AS side, file_path, time, seq, floor(price)::INT % 50 AS b, (floor(price)::INT * 7) % 90 AS a FROM order_events),
 t AS (SELECT test_path, time AS test_time, a - b AS grew FROM st WHERE side = 1 AND a > b),
 f AS (SELECT test_path, file_path, time AS fix_time, abs(a - b) AS fix_size FROM st WHERE side = 0)
SELECT t.test_path, f.file_path, fix_time, test_time, test_time - fix_time AS gap, fix_size, grew FROM t ASOF JOIN f
  ON t.test_path = f.test_path AND t.test_time >= f.fix_time WHERE test_time - fix_time <= 600000000 AND fix_size >= 20"""))
def fix_test_candidates(spark, sf):
    return timeline.fix_test_candidates(states(spark, sf, 0), states(spark, sf, 1), window=600000000, width=WIDTH)


# ---------------------------------------------------------------- paths and commits
def roots(spark, sf):
    p = code_files(spark, sf).select(F.split("path", "/").alias("s"))
    host = p.select(F.concat(F.lit("/"), F.col("s")[1]).alias("prefix"), F.lit("host").alias("root"))
    lang = p.filter(F.col("s")[2] == "en").select(F.concat(F.lit("/"), F.col("s")[1], F.lit("/en")).alias("prefix"), F.lit("english").alias("root"))
    return host.unionByName(lang).distinct()


@query("longest_prefix_roots", with_views("code_files", body="""
WITH s AS (SELECT path, str_split(path, '/') AS s FROM code_files),
 roots AS (SELECT DISTINCT '/' || s[2] AS prefix, 'host' AS root FROM s UNION SELECT DISTINCT '/' || s[2] || '/en', 'english' FROM s WHERE s[3] = 'en')
SELECT path, arg_max(root, length(prefix)) AS root, substr(path, max(length(prefix)) + 2) AS relative
FROM s JOIN roots ON starts_with(path, prefix || '/') GROUP BY path"""))
def longest_prefix_roots(spark, sf):
    return ordered.longest_prefix(code_files(spark, sf).select("path"), roots(spark, sf))


SUBJECTS = {"1-URGENT": "fix: urgent", "2-HIGH": "fix(api): high", "3-MEDIUM": "Bugfix: medium", "4-NOT SPECIFIED": "feat: more", "5-LOW": "hotfix(core): low"}


def commit_log(spark, sf):
    o = read(spark, sf, "orders")
    subject = F.lit("chore: none")
    for priority, text in SUBJECTS.items():
        subject = F.when(F.col("o_orderpriority") == priority, text).otherwise(subject)
    return o.select(F.col("o_orderkey").cast("string").alias("sha"), subject.alias("subject"))


def commit_paths(spark, sf):
    l, n = read(spark, sf, "lineitem"), F.col("l_linenumber").cast("string")
    path = (F.when(F.col("l_suppkey") % 5 == 0, "docs/readme.md").when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("tests/test_m"), n, F.lit(".py")))
            .otherwise(F.concat(F.lit("src/m"), n, F.lit(".py"))))
    return l.select(F.col("l_orderkey").cast("string").alias("sha"), path.alias("path"))


sql_view("commit_log", "SELECT o_orderkey::VARCHAR AS sha, CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUBJECTS.items())
         + " ELSE 'chore: none' END AS subject FROM orders")
sql_view("commit_paths", """
SELECT l_orderkey::VARCHAR AS sha, CASE WHEN l_suppkey % 5 = 0 THEN 'docs/readme.md' WHEN l_linenumber % 2 = 0 THEN 'tests/test_m' || l_linenumber || '.py'
  ELSE 'src/m' || l_linenumber || '.py' END AS path FROM lineitem""")
TRIAGED = """SELECT c.sha, c.subject, count(*) FILTER (path LIKE 'src/%') AS source_files, count(*) FILTER (path LIKE 'tests/%') AS test_files,
  CASE WHEN count(*) FILTER (path LIKE 'src/%') < 1 THEN 'no source file changed (test-only or docs commit)'
       WHEN count(*) FILTER (path LIKE 'tests/%') < 1 THEN 'no test file shipped with the fix (no oracle)' ELSE '' END AS reject_reason,
  'org_repo__' || substr(c.sha, 1, 10) AS task_id
FROM commit_log c LEFT JOIN commit_paths p USING (sha) WHERE regexp_matches(c.subject, '(?i)^(fix|bugfix|hotfix)(\\(|:)') GROUP BY c.sha, c.subject"""


@query("commit_triage", with_views("commit_log", "commit_paths", body=TRIAGED))
def commit_triage(spark, sf):
    return commits.triage(commit_log(spark, sf), commit_paths(spark, sf), "org/repo")


@query("commit_file_roles", with_views("commit_log", "commit_paths", body="""
SELECT CASE WHEN path LIKE 'tests/%' THEN 'test' WHEN path LIKE 'src/%' THEN 'source' ELSE 'other' END AS role, count(*) AS n
FROM commit_paths JOIN commit_log USING (sha) WHERE regexp_matches(subject, '(?i)^(fix|bugfix|hotfix)(\\(|:)') GROUP BY ALL"""))
def commit_file_roles(spark, sf):
    return commits.commit_files(commit_log(spark, sf), commit_paths(spark, sf)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("source_test_pairs", with_views("commit_paths", body="""
SELECT DISTINCT s.path, t.path AS test_path FROM commit_paths s JOIN commit_paths t ON t.path = 'tests/test_m' || (regexp_extract(s.path, 'm(\\d+)', 1)::INT + 1) || '.py'
WHERE s.path LIKE 'src/%'"""))
def source_test_pairs(spark, sf):
    """Odd modules pair with the test of the next number, so the paths are shifted by one first."""
    p = commit_paths(spark, sf).select("path").distinct()
    number = F.regexp_extract("path", r"src/m(\d+)", 1)
    shifted = p.withColumn("path", F.when(F.length(number) > 0, F.concat(
        F.lit("src/m"), (F.try_to_number(F.when(F.length(number) > 0, number), F.lit("999")).cast("int") + 1).cast("string"), F.lit(".py"))).otherwise(F.col("path")))
    found = commits.source_test_pairs(shifted)
    back = F.try_to_number(F.regexp_extract("path", r"src/m(\d+)", 1), F.lit("999")).cast("int") - 1
    return found.filter(F.col("path").startswith("src/")).select(F.concat(F.lit("src/m"), back.cast("string"), F.lit(".py")).alias("path"), "test_path")

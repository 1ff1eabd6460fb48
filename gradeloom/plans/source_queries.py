"""Sources, sinks and streams: each query stages data derived from the tables, then reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.plans.history_queries import TRIAGED, commit_log, commit_paths
from gradeloom.plans.registry import query, read
from gradeloom.plans.staging import fresh_path
from gradeloom.plans.views import pool, runs, sql_view, tasks, tests, with_views
from gradeloom.operators import commits
from gradeloom.schemas import RESULT
from gradeloom.sources import files
from gradeloom.streaming import frames as fr
from gradeloom.streaming.live_board import LiveBoard, result_stream


# ---------------------------------------------------------------- tasks
def staged_tasks(spark, sf):
    """Task lines with every seventh missing its goal, every eleventh repeated and every thirteenth cut into bad JSON."""
    t = tasks(spark, sf)
    n = F.col("ingest_seq")
    line = F.to_json(F.struct("task_id", "language", "file_name", F.when(n % 7 == 0, "").otherwise(F.col("goal")).alias("goal"), "buggy", "reference_fix"))
    line = F.when(n % 13 == 0, F.concat(F.lit("{broken "), line)).otherwise(line)
    copies = F.when(n % 11 == 0, F.array(line, line, F.lit(""))).otherwise(F.array(line))
    path = fresh_path(spark, "tasks")
    t.select(F.explode(copies).alias("value")).write.text(path)
    return path


TASK_SQL = """SELECT task_id, ingest_seq AS n, CASE WHEN ingest_seq % 13 = 0 THEN 'invalid JSON' WHEN ingest_seq % 7 = 0 THEN 'missing goal' END AS problem FROM tasks"""


@query("strict_task_file", with_views("tasks", body=f"SELECT task_id, md5(buggy) AS buggy_md5, 'unclassified' AS category FROM tasks JOIN ({TASK_SQL}) USING (task_id) WHERE problem IS NULL"))
def strict_task_file(spark, sf):
    good, _ = files.check_tasks(spark, staged_tasks(spark, sf))
    return good.select("task_id", F.md5("buggy").alias("buggy_md5"), "category")


@query("task_file_violations", with_views("tasks", body=f"""
WITH p AS ({TASK_SQL}) SELECT problem, count(*) AS n FROM (SELECT coalesce(problem, 'duplicate task_id ' || task_id) AS problem FROM p WHERE n % 11 = 0
  UNION ALL SELECT problem FROM p WHERE problem IS NOT NULL) GROUP BY problem"""))
def task_file_violations(spark, sf):
    _, bad = files.check_tasks(spark, staged_tasks(spark, sf))
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("saved_tasks", with_views("tasks", body="SELECT task_id, language, md5(reference_fix) AS fix_md5 FROM tasks"))
def saved_tasks(spark, sf):
    path = fresh_path(spark, "saved")
    files.save_tasks(tasks(spark, sf).select("task_id", "language", "goal", "buggy", "reference_fix"), path)
    return files.load_tasks(spark, path).select("task_id", "language", F.md5("reference_fix").alias("fix_md5"))


# ---------------------------------------------------------------- results
def result_rows(spark, sf):
    keep = [f.name for f in RESULT]
    r = runs(spark, sf)
    return r.select(*[c for c in keep if c in r.columns], "ingest_seq")


@query("tolerant_results", with_views("runs", body="""
SELECT model, count(*) AS n, round(sum(combined), 4) AS combined, max(ts) AS newest FROM runs GROUP BY model"""))
def tolerant_results(spark, sf):
    """Valid lines mixed with blank and broken ones."""
    path = fresh_path(spark, "results")
    r = result_rows(spark, sf).drop("ingest_seq")
    line = F.to_json(F.struct(*r.columns))
    noise = F.when(F.col("ts") % 5 == 0, F.array(line, F.lit(""), F.lit("{not json"))).otherwise(F.array(line))
    r.select(F.explode(noise).alias("value")).write.text(path)
    return files.load_results(spark, path).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("combined"), 4).alias("combined"), F.max("ts").alias("newest"))


@query("appended_results", with_views("runs", body="SELECT model, 2 * count(*) AS n FROM runs GROUP BY model"))
def appended_results(spark, sf):
    path = fresh_path(spark, "appended")
    for _ in range(2):
        files.append_results(result_rows(spark, sf).drop("ingest_seq"), path)
    return files.load_results(spark, path).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("streamed_appends", with_views("runs", body="SELECT model, count(*) AS n, round(sum(combined), 4) AS combined, max(ts) AS newest FROM runs GROUP BY model"))
def streamed_appends(spark, sf):
    """Result files in two lots through the append stream, which stops after the first and starts again."""
    source, sink, check = (fresh_path(spark, n) for n in ("results", "streamed", "streamed-checkpoint"))
    rows = result_rows(spark, sf).drop("ingest_seq")
    for lot in (F.col("ts") % 2 == 0, F.coalesce(F.col("ts") % 2 != 0, F.lit(True))):
        rows.filter(lot).write.mode("append").json(source)
        files.append_stream(spark.readStream.schema(RESULT).json(source), sink, check, availableNow=True).awaitTermination()
    return files.load_results(spark, sink).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("combined"), 4).alias("combined"), F.max("ts").alias("newest"))


# ---------------------------------------------------------------- shards
@query("panel_shards", with_views("pool", body="SELECT task_id::VARCHAR AS task_id, codebase, module, bug_id, line, difficulty FROM pool"))
def panel_shards(spark, sf):
    """Two kinds of shard per partition: a bare array, and an object with `tasks`; a third path does not exist."""
    p = pool(spark, sf).withColumn("task_id", F.col("task_id").cast("string"))
    row = F.struct("task_id", "codebase", "module", "bug_id", "line", "difficulty", "test_node", "depth")
    plain, wrapped = fresh_path(spark, "shard-array"), fresh_path(spark, "shard-object")
    chunks = p.groupBy((F.col("ingest_seq") % 2).alias("kind"), F.floor(F.col("ingest_seq") / 500)).agg(F.collect_list(row).alias("tasks"))
    one_each = lambda kind, value, path: chunks.filter(F.col("kind") == kind).select(F.to_json(value).alias("value")).write.option(
        "maxRecordsPerFile", 1).text(path)
    one_each(0, F.col("tasks"), plain)
    one_each(1, F.struct("tasks"), wrapped)
    return files.load_shards(spark, [plain, wrapped, fresh_path(spark, "absent")]).select(
        "task_id", "codebase", "module", "bug_id", "line", "difficulty")


# ---------------------------------------------------------------- test reports
def staged_reports(spark, sf):
    """One report file per partition, written by the XML sink."""
    child = lambda name: F.when(F.col("outcome") == name, F.struct(F.lit("m").alias("_message"), F.lit("x").alias("_VALUE")))
    path = fresh_path(spark, "junit")
    tests(spark, sf).select(
        F.concat(F.lit("tests.test_o"), F.col("task_id").cast("string")).alias("_classname"), F.col("nodeid").alias("_name"),
        child("failed").alias("failure"), child("error").alias("error")).write.format("xml").option(
        "rootTag", "testsuite").option("rowTag", "testcase").save(path)
    return path


@query("junit_outcomes", with_views("tests", body="""
SELECT 'tests/test_o' || task_id || '.py::' || nodeid AS nodeid, outcome, CASE outcome WHEN 'failed' THEN 'Failure' WHEN 'error' THEN 'Error' END AS exc_type, count(*) AS n
FROM tests GROUP BY ALL UNION ALL SELECT 'tests/test_missing.py', 'error', 'Error', 1"""))
def junit_outcomes(spark, sf):
    expected = spark.createDataFrame([("absent.xml", "tests/test_missing.py")], "report string, test_path string")
    return files.junit_rows(spark, staged_reports(spark, sf), expected).groupBy("nodeid", "outcome", "exc_type").agg(F.count(F.lit(1)).alias("n"))


@query("tap_outcomes", with_views("tests", body="""
SELECT 'case_' || substr(sha256('order ' || task_id || ' ' || nodeid), 1, 8) AS nodeid, CASE WHEN outcome = 'passed' THEN 'passed' ELSE 'failed' END AS outcome, count(*) AS n
FROM tests GROUP BY ALL"""))
def tap_outcomes(spark, sf):
    t = tests(spark, sf)
    line = F.concat(F.when(F.col("outcome") == "passed", "ok ").otherwise("not ok "), F.col("slot").cast("string"), F.lit(" - order "),
                    F.col("task_id").cast("string"), F.lit(" "), "nodeid")
    path = fresh_path(spark, "tap")
    t.select(F.explode(F.array(line, F.lit("  # diagnostic"))).alias("value")).write.text(path)
    return files.tap_rows(spark, path).groupBy("nodeid", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("commit_log_file", with_views("commit_log", "commit_paths", body=TRIAGED))
def commit_log_file(spark, sf):
    log, changed = fresh_path(spark, "log"), fresh_path(spark, "files")
    commit_log(spark, sf).select(F.concat_ws("\t", "sha", "subject").alias("value")).write.text(log)
    commit_paths(spark, sf).select(F.concat_ws("\t", "sha", "path").alias("value")).write.text(changed)
    return commits.triage(files.commit_log(spark, log), files.commit_files(spark, changed), "org/repo")


# ---------------------------------------------------------------- frames
def payloads(spark, sf):
    """conversations as payloads of one connection per conversation: several frames each, some foreign or broken."""
    c = read(spark, sf, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    rid = F.concat(F.lit("r"), conv.cast("string"))
    message = lambda author, text, kind=None: F.struct(F.lit(author).alias("author"), text.alias("text"), (kind if kind is not None else F.lit(None).cast("string")).alias("messageType"),
                                                       F.lit(None).cast("string").alias("contentType"))
    update = lambda m, rid, last: F.to_json(F.struct(F.lit(1).alias("type"), F.lit("update").alias("target"), F.array(F.struct(
        rid.alias("requestId"), last.alias("isLastUpdate"), F.array(m).alias("messages"))).alias("arguments")))
    said = update(message("bot", F.col("text")), rid, turn >= 5)
    closing = F.to_json(F.struct(F.lit(2).alias("type"), F.struct(F.array(message("bot", F.concat(F.col("text"), F.lit(" done")))).alias("messages")).alias("item")))
    own = (F.when((conv % 7 == 0) & (turn == 2), F.lit('{"type": 7}')).when((conv % 5 == 1) & (turn == 2), F.lit('{"type": 5, "error": "binding"}'))
           .when(F.col("role") == "user", update(message("user", F.col("text")), rid, F.lit(False)))
           .when(F.col("role") == "system", update(message("bot", F.lit("Just a moment…")), rid, F.lit(False)))
           .when((conv % 3 == 0) & (turn == 3), closing).otherwise(said))
    foreign = update(message("bot", F.lit("someone else's answer")), F.lit("peer"), F.lit(True))
    grown = F.when((F.col("role") == "assistant") & (turn < 3), update(message("bot", F.concat("text", F.lit(" and more"))), rid, F.lit(False))).otherwise("{broken")
    return c.select(rid.alias("request_id"), turn.alias("seq"),
                    (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=turn)).alias("ts"),
                    F.concat_ws("\u001e", foreign, own, grown, F.lit("")).alias("payload"))


# frames of a request's own that say something or end it, as rows
sql_view("spoken", """
WITH c AS (SELECT 'r' || conv_id AS request_id, turn AS seq, conv_id, role, text,
  CASE WHEN conv_id % 7 = 0 AND turn = 2 THEN 'final' WHEN conv_id % 5 = 1 AND turn = 2 THEN 'binding_failure' WHEN role <> 'assistant' THEN NULL
       WHEN conv_id % 3 = 0 AND turn = 3 THEN 'final' WHEN turn >= 5 THEN 'final' END AS stop,
  (conv_id % 7 = 0 AND turn = 2) OR (conv_id % 5 = 1 AND turn = 2) AS silent FROM conversations)
SELECT request_id, seq, 1 AS pos, CASE WHEN silent OR role <> 'assistant' THEN '' WHEN conv_id % 3 = 0 AND seq = 3 THEN text || ' done' ELSE text END AS text, stop FROM c
UNION ALL SELECT request_id, seq, 2, text || ' and more', NULL FROM c WHERE role = 'assistant' AND seq < 3""")
sql_view("heard", """
SELECT s.* FROM spoken s LEFT JOIN (SELECT request_id, min(seq * 10 + pos) AS fin FROM spoken WHERE stop IS NOT NULL GROUP BY request_id) e USING (request_id)
WHERE fin IS NULL OR seq * 10 + pos <= fin""", ("spoken",))


def texts(spark, sf):
    return fr.frame_texts(fr.parse_frames(payloads(spark, sf)))


@query("frame_texts", with_views("spoken", body="SELECT request_id, seq, pos, md5(text) AS text_md5, stop FROM spoken"))
def frame_texts(spark, sf):
    return texts(spark, sf).select("request_id", "seq", "pos", F.md5("text").alias("text_md5"), "stop")


ASSEMBLED = """SELECT request_id, md5(coalesce(arg_max(text, seq * 10 + pos) FILTER (text <> ''), '')) AS text_md5, coalesce(max(stop), 'open') AS status FROM heard GROUP BY request_id"""


@query("assembled_answers", with_views("heard", body=ASSEMBLED))
def assembled_answers(spark, sf):
    return fr.assemble(texts(spark, sf)).select("request_id", F.md5("text").alias("text_md5"), "status")


DELTAS = """WITH d AS (SELECT request_id, seq, pos, text, coalesce(lag(text) OVER (PARTITION BY request_id ORDER BY seq, pos), '') AS prev FROM heard
  WHERE text <> '' AND (stop IS NULL OR stop = 'final')), e AS (SELECT *, CASE WHEN starts_with(text, prev) THEN substr(text, length(prev) + 1) ELSE text END AS delta FROM d)
SELECT request_id, seq, pos, md5(delta) AS delta_md5 FROM e WHERE delta <> ''"""


@query("answer_deltas", with_views("heard", body=DELTAS))
def answer_deltas(spark, sf):
    return fr.deltas(texts(spark, sf)).select("request_id", "seq", "pos", F.md5("delta").alias("delta_md5"))


def streamed(spark, sf):
    """Run the stateful stream over staged payloads until all input is consumed; returns what its file sink holds."""
    source, sink, check = (fresh_path(spark, n) for n in ("payloads", "answers", "answers-checkpoint"))
    payloads(spark, sf).write.parquet(source)
    stream = spark.readStream.schema("request_id string, seq bigint, ts timestamp, payload string").parquet(source)
    run = (fr.stream_answers(stream).writeStream.format("parquet").option("checkpointLocation", check).outputMode("append")
           .trigger(availableNow=True).start(sink))
    run.awaitTermination()
    return spark.read.schema(fr._STREAMED).parquet(sink)


@query("streamed_answers", with_views("heard", body=f"SELECT * FROM ({ASSEMBLED}) WHERE status <> 'open'"))
def streamed_answers(spark, sf):
    return streamed(spark, sf).filter("text IS NOT NULL AND status <> 'timeout'").select("request_id", F.md5("text").alias("text_md5"), "status")


@query("streamed_deltas", with_views("heard", body=DELTAS))
def streamed_deltas(spark, sf):
    return streamed(spark, sf).filter(F.length("delta") > 0).select("request_id", "seq", "pos", F.md5("delta").alias("delta_md5"))


@query("live_board", with_views("latest", body="SELECT model, count(*) AS tasks, round(sum(combined), 4) AS combined, max(ts) AS newest FROM latest GROUP BY model"))
def live_board(spark, sf):
    """Result files arriving as a stream; the newest row per model and task after all of them."""
    source, state, check = (fresh_path(spark, n) for n in ("incoming", "live", "live-checkpoint"))
    result_rows(spark, sf).write.json(source)
    board = LiveBoard(spark, state)
    board.start(result_stream(spark, source, numbered=True), check, availableNow=True).awaitTermination()
    board.compact()
    return board.rows().groupBy("model").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.sum("combined"), 4).alias("combined"), F.max("ts").alias("newest"))

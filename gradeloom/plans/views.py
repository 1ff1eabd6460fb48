"""Domain views over the star-schema test tables: a Spark builder and the same view as SQL.

The tables hold no code-repair data, so each view renames columns and appends a
few literals to whole rows; no view drops, caps or shortens rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.plans.registry import read

VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def sql_view(name: str, text: str, needs: tuple[str, ...] = ()) -> None:
    VIEW_SQL[name] = (needs, text)


def with_views(*names: str, body: str) -> str:
    """`body` preceded by the named views and the views they need."""
    ordered: list[str] = []

    def add(name):
        for dep in VIEW_SQL[name][0]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ", ".join(f"{n} AS ({VIEW_SQL[n][1]})" for n in ordered)
    text = body.strip()
    if text[:5].upper() == "WITH ":
        return f"WITH {ctes}, {text[5:]}"
    return f"WITH {ctes} {text}"


def epoch_seconds(ts) -> F.Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


# ---------------------------------------------------------------- tasks
GUARD = "\nif not ready(x):\n    return None\n"


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """documents as tasks: the next document is the reference fix. The texts meet by task, as other tables join them, and so move once."""
    named = lambda doc_id: F.concat(F.lit("B"), doc_id.cast("string")).alias("task_id")
    d = read(spark, sf, "documents").select(named(F.col("doc_id")), "doc_id", "text", "lang", "source")
    nxt = read(spark, sf, "documents").select(named(F.col("doc_id") - 1), F.col("text").alias("nxt"))
    goal = (F.when(F.col("doc_id") % 3 == 0, "the loader crashes on empty input")
            .when(F.col("doc_id") % 3 == 1, "add support for naming").otherwise("continue"))
    return d.join(nxt, "task_id", "left").select(
        "task_id", F.col("lang").alias("language"),
        F.col("source").alias("file_name"), goal.alias("goal"), F.col("text").alias("buggy"),
        F.coalesce("nxt", "text").alias("reference_fix"), F.col("doc_id").alias("ingest_seq"))


sql_view("tasks", """
SELECT 'B' || d.doc_id AS task_id, d.lang AS language, d.source AS file_name,
       CASE d.doc_id % 3 WHEN 0 THEN 'the loader crashes on empty input'
            WHEN 1 THEN 'add support for naming' ELSE 'continue' END AS goal,
       d.text AS buggy, coalesce(n.text, d.text) AS reference_fix, d.doc_id AS ingest_seq
FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1""")


# ---------------------------------------------------------------- runs
def runs(spark: SparkSession, sf: str) -> DataFrame:
    """events as result rows; the answer is a short literal chosen by k."""
    e = read(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    k, v, u = F.col("k"), F.col("value"), F.col("user_id")
    pos = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    combined, diag = pos(v / 101), pos(v / 83)
    repair, given = pos(2 * combined - diag), pos(v / 127)
    latency = (k * 25).cast("bigint")
    answer = (F.when(k.between(20, 22), "").when(k.between(33, 35), "just prose without any symbol")
              .otherwise("def pick(x):\n    return x"))
    raw = (F.when(k.between(36, 38), "I'm sorry, as an AI I cannot help with that")
           .when(k == 39, "<tool_call>run</tool_call>")
           .when(k.between(40, 45), "I have fixed the code, fixed: true")
           .when(k.between(46, 55), '{"defect": "missing guard", "Line": "line 3", "type": "boundary", "conf": "0.8"}')
           .when(k.between(56, 60), "--- a/m.py\n+++ b/m.py\n@@ -1 +1 @@\n-x\n+y")
           .when(k.between(61, 63), "no changes")
           .otherwise(F.concat(F.lit("```python\n"), answer, F.lit("\n```"))))
    return e.select(
        F.col("event_type").alias("model"), F.concat(F.lit("B"), u.cast("string")).alias("task_id"), "user_id",
        F.col("event_id").alias("ingest_seq"), epoch_seconds(F.col("ts")).alias("ts"), "k",
        F.when(u % 2 == 0, "python").otherwise("javascript").alias("language"),
        F.concat(F.lit("c"), (u % 6).cast("string")).alias("category"),
        F.concat(F.lit("cb"), (u % 8).cast("string")).alias("codebase"),
        F.struct(diag.alias("total"), F.when(k % 2 == 0, 1.0).otherwise(0.0).alias("location_match"),
                 pos(v / 53).alias("judge_agreement"), F.when(k % 3 == 0, 1.0).otherwise(0.5).alias("category_match"),
                 F.when(k < 5, "HTTP 429 too many requests").otherwise("").alias("error"),
                 latency.alias("latency_ms")).alias("diagnose"),
        F.struct(repair.alias("total"), (((u + k) % 5) / 4.0).alias("judge_agreement"),
                 pos(v / 61).alias("patch_reproduction"), ((k % 3) / 2.0).alias("oracle_score"),
                 F.when(k % 7 == 0, "exec_diff").otherwise("none").alias("oracle"), answer.alias("candidate"),
                 raw.alias("raw"), latency.alias("latency_ms")).alias("repair"),
        F.struct(given.alias("total")).alias("repair_given"),
        combined.alias("combined"), (given - diag).alias("diagnosis_uplift"),
        F.when(k < 5, "HTTP 429 too many requests").when(k < 8, "request timed out").when(k < 10, "odd failure")
         .when(k < 15, "HTTP 400: invalid model name").otherwise("").alias("diagnose_error"),
        F.when(k.between(15, 17), "no filesystem isolation").otherwise("").alias("repair_error"),
        F.when(k.between(18, 19), "operator").alias("tainted"),
        F.when(k == 98, F.lit(None).cast("string")).when(k == 99, "m0").otherwise("m1").alias("manifest_hash"))


sql_view("runs", """
SELECT *, greatest(0.0, least(1.0, 2 * combined - diag_total)) AS repair_total,
       given_total - diag_total AS diagnosis_uplift,
       CASE WHEN k BETWEEN 36 AND 38 THEN 'I''m sorry, as an AI I cannot help with that'
            WHEN k = 39 THEN '<tool_call>run</tool_call>'
            WHEN k BETWEEN 40 AND 45 THEN 'I have fixed the code, fixed: true'
            WHEN k BETWEEN 46 AND 55 THEN '{"defect": "missing guard", "Line": "line 3", "type": "boundary", "conf": "0.8"}'
            WHEN k BETWEEN 56 AND 60 THEN '--- a/m.py' || chr(10) || '+++ b/m.py' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-x' || chr(10) || '+y'
            WHEN k BETWEEN 61 AND 63 THEN 'no changes'
            ELSE '```python' || chr(10) || candidate || chr(10) || '```' END AS raw
FROM (
SELECT event_type AS model, 'B' || user_id AS task_id, user_id, event_id AS ingest_seq,
       date_diff('second', TIMESTAMP '1970-01-01', ts) AS ts, k,
       CASE WHEN user_id % 2 = 0 THEN 'python' ELSE 'javascript' END AS language,
       'c' || (user_id % 6) AS category, 'cb' || (user_id % 8) AS codebase,
       greatest(0.0, least(1.0, value / 83)) AS diag_total,
       CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS diag_location,
       greatest(0.0, least(1.0, value / 53)) AS diag_judge,
       CASE WHEN k % 3 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS diag_category,
       greatest(0.0, least(1.0, value / 101)) AS combined,
       greatest(0.0, least(1.0, value / 127)) AS given_total,
       ((user_id + k) % 5) / 4.0::DOUBLE AS repair_judge,
       greatest(0.0, least(1.0, value / 61)) AS repair_repro,
       (k % 3) / 2.0::DOUBLE AS oracle_score,
       CASE WHEN k % 7 = 0 THEN 'exec_diff' ELSE 'none' END AS oracle,
       CASE WHEN k BETWEEN 20 AND 22 THEN '' WHEN k BETWEEN 33 AND 35 THEN 'just prose without any symbol'
            ELSE 'def pick(x):' || chr(10) || '    return x' END AS candidate,
       (k * 25)::BIGINT AS latency_ms,
       CASE WHEN k < 5 THEN 'HTTP 429 too many requests' ELSE '' END AS stage_error,
       CASE WHEN k < 5 THEN 'HTTP 429 too many requests' WHEN k < 8 THEN 'request timed out'
            WHEN k < 10 THEN 'odd failure' WHEN k < 15 THEN 'HTTP 400: invalid model name' ELSE '' END AS diagnose_error,
       CASE WHEN k BETWEEN 15 AND 17 THEN 'no filesystem isolation' ELSE '' END AS repair_error,
       CASE WHEN k BETWEEN 18 AND 19 THEN 'operator' END AS tainted,
       CASE WHEN k = 98 THEN NULL WHEN k = 99 THEN 'm0' ELSE 'm1' END AS manifest_hash
FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events))""")

# state of a run as SQL, used by several oracles
sql_view("states", """
SELECT *, CASE WHEN coalesce(tainted, '') <> '' THEN 'tainted'
    WHEN regexp_matches(err, 'no filesystem isolation|lane disabled|isolation|policy_blocked', 'i') THEN 'policy_blocked'
    WHEN trim(err) <> '' THEN 'infra_error'
    WHEN NOT regexp_matches(candidate, '[A-Za-z_]\\w*\\s*[({=\\[]') THEN 'invalid_response'
    ELSE 'completed' END AS state,
  CASE WHEN trim(err) = '' THEN NULL
    WHEN regexp_matches(err, 'HTTP\\s*400') THEN 'bad_request'
    WHEN regexp_matches(err, 'HTTP\\s*429') THEN 'rate_limited'
    WHEN regexp_matches(err, 'timed? ?out', 'i') THEN 'timeout' ELSE 'unknown' END AS error_kind
FROM (SELECT *, diagnose_error || ' ' || repair_error AS err FROM runs)""", ("runs",))

sql_view("latest", """
SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY model, task_id ORDER BY ts DESC, ingest_seq DESC) = 1""",
         ("states",))


def lanes(spark: SparkSession, sf: str) -> DataFrame:
    """Model -> can its lane read files."""
    m = read(spark, sf, "events").select(F.col("event_type").alias("model")).distinct()
    return m.withColumn("can_read", F.col("model").isin("click", "view"))


def answered_runs(spark: SparkSession, sf: str, rows: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Runs of known tasks whose answer is built from the task's own texts."""
    r = runs(spark, sf) if rows is None else rows
    t = (tasks(spark, sf) if known is None else known).select("task_id", F.col("buggy").alias("_b"), F.col("reference_fix").alias("_f"))
    k = F.col("k")
    answer = (F.when(k.between(23, 27), F.col("_f")).when(k.between(28, 32), F.col("_b"))
              .when(k.between(20, 22) | k.between(33, 35) | k.between(40, 45), F.col("repair.candidate"))
              .otherwise(F.concat(F.col("_b"), F.lit(GUARD), F.col("_b"))))
    return r.join(t, "task_id").withColumn("repair", F.col("repair").withField("candidate", answer)).drop("_b", "_f")


_GUARD_SQL = "chr(10) || 'if not ready(x):' || chr(10) || '    return None' || chr(10)"
sql_view("answered", f"""
SELECT s.* EXCLUDE (candidate, state), t.buggy, t.reference_fix, c.candidate, c.cn, c.bn, c.rn,
  CASE WHEN s.state IN ('completed', 'invalid_response') THEN
       CASE WHEN regexp_matches(c.candidate, '[A-Za-z_]\\w*\\s*[({{=\\[]') THEN 'completed' ELSE 'invalid_response' END
       ELSE s.state END AS state,
  (c.cn = c.rn AND length(c.rn) > 40) AS verbatim, (c.cn = c.bn AND length(c.bn) > 0) AS echo
FROM latest s JOIN tasks t ON t.task_id = s.task_id, LATERAL (
  SELECT CASE WHEN s.k BETWEEN 23 AND 27 THEN t.reference_fix WHEN s.k BETWEEN 28 AND 32 THEN t.buggy
              WHEN s.k BETWEEN 20 AND 22 OR s.k BETWEEN 33 AND 35 OR s.k BETWEEN 40 AND 45 THEN s.candidate
              ELSE t.buggy || {_GUARD_SQL} || t.buggy END AS candidate) c0, LATERAL (
  SELECT c0.candidate AS candidate, trim(regexp_replace(c0.candidate, '\\s+', ' ', 'g')) AS cn,
         trim(regexp_replace(t.buggy, '\\s+', ' ', 'g')) AS bn,
         trim(regexp_replace(t.reference_fix, '\\s+', ' ', 'g')) AS rn) c""", ("latest", "tasks"))


# ---------------------------------------------------------------- sessions
SUFFIXES = {
    0: "\ndef load(path):\n    data = read(path)\n    if not data:\n        return None\n    return data",
    1: "\n```python\nvalue = compute(x)\n```\n",
    2: "\nstill not working, same error",
    4: "\nplease fix the crash in load, try another path instead",
}
EXTENSIONS = ("py", "js", "ts", "json", "md")


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as session messages; one literal suffix per message gives the prose some code."""
    c = read(spark, sf, "conversations")
    slot = (F.col("conv_id") + F.col("turn")) % 6
    suffix = F.lit("")
    for value, text in SUFFIXES.items():
        suffix = F.when(slot == value, text).otherwise(suffix)
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ts"), "role",
                    F.concat("text", suffix).alias("text"), slot.alias("slot"),
                    (F.col("conv_id") * 100000 + F.col("turn")).alias("ingest_seq"))


sql_view("sessions", "SELECT conv_id AS session_id, turn AS ts, role, text || CASE (conv_id + turn) % 6 "
         + " ".join(f"WHEN {v} THEN {literal(t)}" for v, t in SUFFIXES.items())
         + " ELSE '' END AS text, (conv_id + turn) % 6 AS slot, conv_id * 100000 + turn AS ingest_seq FROM conversations")


def session_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as edits: the previous turn's text becomes this turn's text."""
    s = sessions(spark, sf)
    prev = s.select("session_id", (F.col("ts") + 1).alias("ts"), F.col("text").alias("buggy"))
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("session_id") % 5).cast("int"))
    path = F.concat(F.when(F.col("ts") % 4 == 1, "src/mod").otherwise("tests/test_mod"),
                    (F.col("session_id") % 7).cast("string"), F.lit("."), ext)
    return s.filter("role = 'assistant'").join(prev, ["session_id", "ts"]).select(
        "session_id", "ts", "ingest_seq", path.alias("path"), "buggy", F.col("text").alias("fixed"))


sql_view("session_edits", f"""
SELECT s.session_id, s.ts, s.ingest_seq, CASE WHEN s.ts % 4 = 1 THEN 'src/mod' ELSE 'tests/test_mod' END || (s.session_id % 7) || '.'
  || {list(EXTENSIONS)}[(s.session_id % 5)::INT + 1] AS path, p.text AS buggy, s.text AS fixed
FROM sessions s JOIN sessions p ON p.session_id = s.session_id AND p.ts = s.ts - 1 WHERE s.role = 'assistant'""", ("sessions",))
sql_view("goals", """
SELECT e.*, coalesce(m.text, '') AS goal, coalesce(m.ts, 0) AS goal_ts FROM session_edits e ASOF LEFT JOIN
  (SELECT * FROM sessions WHERE role = 'user' AND length(text) > 0) m ON m.session_id = e.session_id AND m.ts <= e.ts""",
         ("session_edits",))


def session_info(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select(F.col("conv_id").alias("session_id")).distinct().select(
        "session_id", F.concat(F.lit("session "), F.col("session_id").cast("string"), F.lit(" async lock")).alias("title"),
        F.concat(F.lit("/work/p"), (F.col("session_id") % 3).cast("string")).alias("directory"),
        F.when(F.col("session_id") % 4 < 3, F.concat(F.lit("p"), (F.col("session_id") % 4).cast("string"))).alias("project_id"))


sql_view("session_info", """
SELECT DISTINCT conv_id AS session_id, 'session ' || conv_id || ' async lock' AS title, '/work/p' || (conv_id % 3) AS directory,
  CASE WHEN conv_id % 4 < 3 THEN 'p' || (conv_id % 4) END AS project_id FROM conversations""")


# ---------------------------------------------------------------- transcript parts
def parts(spark: SparkSession, sf: str) -> DataFrame:
    """sessions wrapped as transcript JSON: text parts and read, write, edit and bash tool calls."""
    s = sessions(spark, sf)
    prev = s.select("session_id", (F.col("ts") + 1).alias("ts"), F.col("text").alias("prev"))
    s = s.join(prev, ["session_id", "ts"], "left")
    tool = F.get(F.array(*[F.lit(t) for t in ("read", "write", "edit", "bash")]), (F.col("slot") % 4).cast("int"))
    path = F.concat(F.lit("/work/src/mod"), (F.col("session_id") % 7).cast("string"), F.lit(".py"))
    body = F.split("text", "\n", -1)
    numbered = F.array_join(F.transform(body, lambda l, i: F.concat((i + 1).cast("string"), F.lit(": "), l)), "\n")
    total = F.size(body).cast("string")
    footer = (F.when(F.col("session_id") % 3 == 0, F.concat(F.lit("\n(Showing lines 1-"), total, F.lit(" of "), total, F.lit(". End)")))
              .when(F.col("session_id") % 3 == 1, F.concat(F.lit("\n(Showing lines 1-2 of "), total, F.lit("0. More)"))).otherwise(""))
    output = F.concat(F.lit("<path>"), path, F.lit("</path>\n<type>file</type>\n<content>\n"), numbered, footer, F.lit("\n</content>"))
    is_text = F.col("role") != "assistant"
    use = lambda name, col: F.when(~is_text & (tool == name), col)
    status = F.when(F.col("ts") % 5 == 4, "error").when(F.col("ts") % 5 != 3, "completed")
    data = F.to_json(F.struct(
        F.when(is_text, "text").otherwise("tool").alias("type"), F.when(~is_text, tool).alias("tool"),
        F.when(is_text, F.col("text")).alias("text"),
        F.when(~is_text, F.struct(status.alias("status"), use("read", output).alias("output"), F.struct(
            F.when(~is_text & (tool != "bash"), path).alias("filePath"), use("write", F.col("text")).alias("content"),
            use("edit", F.col("prev")).alias("oldString"), use("edit", F.col("text")).alias("newString"),
            use("bash", F.lit("git restore .")).alias("command")).alias("input"))).alias("state")))
    return s.select(F.col("ingest_seq").alias("id"), "session_id", F.col("ts").alias("time_created"), data.alias("data"))


sql_view("part_rows", """
SELECT s.*, CASE WHEN s.role <> 'assistant' THEN 'text' ELSE 'tool' END AS part_type,
  CASE WHEN s.role = 'assistant' THEN ['read', 'write', 'edit', 'bash'][(s.slot % 4)::INT + 1] END AS tool,
  CASE WHEN s.role = 'assistant' AND s.slot % 4 <> 3 THEN '/work/src/mod' || (s.session_id % 7) || '.py' END AS path,
  CASE WHEN s.role <> 'assistant' THEN NULL WHEN s.ts % 5 = 4 THEN 'error' WHEN s.ts % 5 <> 3 THEN 'completed' END AS status,
  p.text AS prev FROM sessions s LEFT JOIN sessions p ON p.session_id = s.session_id AND p.ts = s.ts - 1""", ("sessions",))
sql_view("part_events", "SELECT * FROM part_rows WHERE part_type = 'text' OR status IS NULL OR status = 'completed'", ("part_rows",))


# ---------------------------------------------------------------- diffs
FUNCTION = "\ndef pick(items, key):\n    total = 0\n    name = 'alpha'\n    return items[key]\n"
FIXED_FUNCTIONS = {
    0: FUNCTION.replace("    total", "    if not items:\n        return None\n    total"),
    1: FUNCTION.replace("pick", "choose").replace("key", "slot"),
    2: FUNCTION.replace("'alpha'", "'beta text'"),
    3: FUNCTION.replace("    return", "    timeout = 30,\n    return"),
    4: FUNCTION,
    5: FUNCTION.replace("total = 0", "total = 1"),
}


def diffs(spark: SparkSession, sf: str) -> DataFrame:
    """documents with a function appended; the function changes in one of six ways."""
    d = read(spark, sf, "documents")
    kind = F.col("doc_id") % 6
    fixed = F.lit("")
    for value, text in FIXED_FUNCTIONS.items():
        fixed = F.when(kind == value, text).otherwise(fixed)
    return d.select(
        F.col("doc_id").alias("task_id"), F.concat("text", F.lit(FUNCTION)).alias("buggy"),
        F.concat("text", fixed).alias("reference_fix"),
        F.when(F.floor(F.col("doc_id") / 6) % 2 == 0, "the picker crashes on empty input")
         .otherwise("add support for naming").alias("goal"),
        F.when(kind == 5, "app.yaml").otherwise(F.concat("source", F.lit(".py"))).alias("file_name"),
        F.when(F.col("doc_id") % 10 == 9, "bug_fix").otherwise("unclassified").alias("category"),
        F.size(F.split("text", "\n", -1)).alias("text_lines"), F.col("doc_id").alias("ingest_seq"))


sql_view("diffs", f"""
SELECT doc_id AS task_id, text || {literal(FUNCTION)} AS buggy, text || CASE doc_id % 6 """
         + " ".join(f"WHEN {v} THEN {literal(t)}" for v, t in FIXED_FUNCTIONS.items()) + """ END AS reference_fix,
  CASE WHEN (doc_id // 6) % 2 = 0 THEN 'the picker crashes on empty input' ELSE 'add support for naming' END AS goal,
  CASE WHEN doc_id % 6 = 5 THEN 'app.yaml' ELSE source || '.py' END AS file_name,
  CASE WHEN doc_id % 10 = 9 THEN 'bug_fix' ELSE 'unclassified' END AS category,
  len(str_split(text, chr(10))) AS text_lines, doc_id AS ingest_seq FROM documents""")


def changed_sql(name: str, source: str, key: str, before: str, after: str) -> str:
    """CTEs ending in `{name}`: key, sign, n, text of the lines without a counterpart."""
    side = lambda sign, col: (f"SELECT {key}, '{sign}' AS sign, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS text "
                              f"FROM (SELECT {key}, str_split({col}, chr(10)) AS l FROM {source} WHERE {before} <> {after})")
    return f"""{name}_l AS (SELECT *, row_number() OVER (PARTITION BY {key}, sign, text ORDER BY n) AS occ
  FROM ({side('-', before)} UNION ALL {side('+', after)})),
{name} AS (SELECT {key}, sign, n, text FROM {name}_l a WHERE NOT EXISTS (SELECT 1 FROM {name}_l b
  WHERE b.{key} = a.{key} AND b.sign <> a.sign AND b.text = a.text AND b.occ = a.occ))"""


def folded(column: str) -> str:
    """Non-ASCII characters as letters, so ASCII word boundaries agree with Unicode ones."""
    return f"regexp_replace({column}, '[^\\x00-\\x7F]', 'z', 'g')"


# ---------------------------------------------------------------- panel and tests
def pool(spark: SparkSession, sf: str) -> DataFrame:
    """part as swept single-bug tasks."""
    p = read(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("task_id"), F.col("p_brand").alias("codebase"), F.col("p_type").alias("module"),
        F.substring(F.sha2("p_name", 256), 1, 12).alias("bug_id"), F.col("p_size").cast("bigint").alias("line"),
        F.concat(F.lit("n"), (k % 11).cast("string")).alias("test_node"),
        F.when(k % 2 == 0, "function").otherwise("module").alias("depth"),
        F.when(F.col("p_size") <= 10, "trivial").when(F.col("p_size") <= 35, "moderate").otherwise("hard").alias("difficulty"),
        k.alias("ingest_seq"))


sql_view("pool", """
SELECT p_partkey AS task_id, p_brand AS codebase, p_type AS module, substr(sha256(p_name), 1, 12) AS bug_id, p_size::BIGINT AS line,
  'n' || (p_partkey % 11) AS test_node, CASE WHEN p_partkey % 2 = 0 THEN 'function' ELSE 'module' END AS depth,
  CASE WHEN p_size <= 10 THEN 'trivial' WHEN p_size <= 35 THEN 'moderate' ELSE 'hard' END AS difficulty, p_partkey AS ingest_seq FROM part""")
sql_view("pool_once", """SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY codebase, module, bug_id ORDER BY ingest_seq) = 1""", ("pool",))


def bugs(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as bugs on lines of modules."""
    l = read(spark, sf, "lineitem")
    return l.select(
        (F.col("l_suppkey") % 20).alias("codebase"), (F.col("l_suppkey") % 5).alias("module"), (F.col("l_partkey") * 9).alias("line"),
        F.concat(F.lit("b"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("bug_id"),
        F.concat(F.lit("n"), (F.col("l_orderkey") % 5).cast("string")).alias("test_node"),
        F.when(F.col("l_quantity") < 15, "trivial").when(F.col("l_quantity") < 40, "moderate").otherwise("hard").alias("difficulty"))


sql_view("bugs", """
SELECT l_suppkey % 20 AS codebase, l_suppkey % 5 AS module, l_partkey * 9 AS line, 'b' || l_orderkey || '_' || l_linenumber AS bug_id,
  'n' || (l_orderkey % 5) AS test_node,
  CASE WHEN l_quantity < 15 THEN 'trivial' WHEN l_quantity < 40 THEN 'moderate' ELSE 'hard' END AS difficulty FROM lineitem""")
sql_view("clustered", """
SELECT * EXCLUDE (brk), sum(brk) OVER (PARTITION BY codebase, module ORDER BY line)::BIGINT AS cluster FROM (
  SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY codebase, module ORDER BY line) > 40 THEN 1 ELSE 0 END AS brk FROM bugs)""", ("bugs",))


def tests(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as test outcomes of an order's two states."""
    l = read(spark, sf, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("task_id"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("nodeid"),
        F.when(F.col("l_linestatus") == "O", "buggy").otherwise("fixed").alias("state"),
        F.when(F.col("l_returnflag") == "A", "passed").when(F.col("l_returnflag") == "N", "failed").otherwise("error").alias("outcome"),
        (F.col("l_suppkey") % 8).alias("codebase"), (F.col("l_linenumber") % 4).alias("slot"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("ingest_seq"), "l_quantity")


sql_view("tests", """
SELECT l_orderkey AS task_id, 'n' || l_linenumber AS nodeid, CASE WHEN l_linestatus = 'O' THEN 'buggy' ELSE 'fixed' END AS state,
  CASE l_returnflag WHEN 'A' THEN 'passed' WHEN 'N' THEN 'failed' ELSE 'error' END AS outcome, l_suppkey % 8 AS codebase,
  l_linenumber % 4 AS slot, l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS ingest_seq, l_quantity FROM lineitem""")


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as repeated runs; some tasks flaky, some with varying feedback, some with few repeats."""
    l = read(spark, sf, "lineitem")
    p = F.col("l_partkey")
    task = F.when(p % 13 == 0, F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))).otherwise(
        F.concat(F.lit("p"), (p % 300).cast("string")))
    flaky = (p % 300) % 7 == 0
    return l.select(
        task.alias("task_id"), F.when(F.col("l_linestatus") == "O", "buggy").otherwise("fixed").alias("state"),
        F.when(flaky, F.col("l_linenumber") % 3).otherwise((p % 300) % 5).cast("bigint").alias("passed"), F.lit(4).cast("bigint").alias("total"),
        F.when((p % 300) % 11 == 0, F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))).otherwise("same").alias("feedback"))


sql_view("trials", """
SELECT CASE WHEN l_partkey % 13 = 0 THEN 'o' || l_orderkey ELSE 'p' || (l_partkey % 300) END AS task_id,
  CASE WHEN l_linestatus = 'O' THEN 'buggy' ELSE 'fixed' END AS state,
  (CASE WHEN (l_partkey % 300) % 7 = 0 THEN l_linenumber % 3 ELSE (l_partkey % 300) % 5 END)::BIGINT AS passed, 4 AS total,
  CASE WHEN (l_partkey % 300) % 11 = 0 THEN 'f' || l_linenumber ELSE 'same' END AS feedback FROM lineitem""")


def attribution_trials(spark: SparkSession, sf: str) -> DataFrame:
    """orders as combined tasks of three bugs in five states."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"))
    grid = o.withColumn("bug_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)]))).withColumn(
        "state", F.explode(F.array(*[F.lit(s) for s in ("all_present", "all_fixed", "fix_1", "fix_2", "fix_3")])))
    t, b, s = F.col("task_id"), F.col("bug_id"), F.col("state")
    passed = (F.when(s == "all_present", (t % 7 == 0) & (b == 1)).when(s == "all_fixed", F.lit(True))
              .when((s == "fix_1") & (b == 2), t % 5 == 0).when((s == "fix_3") & (b == 3), t % 11 != 0)
              .otherwise(s == F.concat(F.lit("fix_"), b.cast("string"))))
    return grid.withColumn("passed", passed)


sql_view("attribution_trials", """
SELECT *, CASE WHEN state = 'all_present' THEN task_id % 7 = 0 AND bug_id = 1 WHEN state = 'all_fixed' THEN true
  WHEN state = 'fix_1' AND bug_id = 2 THEN task_id % 5 = 0 WHEN state = 'fix_3' AND bug_id = 3 THEN task_id % 11 <> 0
  ELSE state = 'fix_' || bug_id END AS passed
FROM (SELECT o_orderkey AS task_id, unnest([1, 2, 3]) AS bug_id FROM orders),
  (SELECT unnest(['all_present', 'all_fixed', 'fix_1', 'fix_2', 'fix_3']) AS state)""")


def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """labels as known-good and known-bad files."""
    l = read(spark, sf, "labels")
    d = F.col("doc_id")
    total = 1 + d % 3
    good = F.col("quality") == 1
    fixed = F.when(good, total - F.when(d % 50 == 0, 1).otherwise(0)).otherwise(F.when(d % 70 == 0, 1).otherwise(0))
    return l.select(d.alias("task_id"), F.when(good, "good").otherwise("bad").alias("known"),
                    total.cast("bigint").alias("bugs_total"), fixed.cast("bigint").alias("bugs_fixed"))


sql_view("calibration", """
SELECT doc_id AS task_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS known, 1 + doc_id % 3 AS bugs_total,
  CASE WHEN quality = 1 THEN 1 + doc_id % 3 - (doc_id % 50 = 0)::INT ELSE (doc_id % 70 = 0)::INT END AS bugs_fixed FROM labels""")


# ---------------------------------------------------------------- code files
CODE_TAIL = ("\ndef total(xs, limit):\n    out = 0\n    for x in xs:\n        if x > limit and x != 0:\n            out += x * 2\n"
             "        # x < limit\n    return out - 1 if out == limit or None else True")


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """pages as source files: a line per tag, with a literal function at the end."""
    p = read(spark, sf, "pages")
    path = F.concat(F.regexp_replace(F.regexp_replace("url", r"^https?://", "/"), r"[?#].*$", ""), F.lit("/f"),
                    F.col("page_id").cast("string"), F.lit(".py"))
    return p.select("page_id", path.alias("path"), F.concat(F.replace("html", F.lit(">"), F.lit(">\n")), F.lit(CODE_TAIL)).alias("text"))


sql_view("code_files", f"""
SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', '/'), '[?#].*$', '') || '/f' || page_id || '.py' AS path,
  replace(html, '>', '>' || chr(10)) || {literal(CODE_TAIL)} AS text FROM pages""")
sql_view("code_lines", """
SELECT page_id, path, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM (SELECT page_id, path, str_split(text, chr(10)) AS l FROM code_files)""",
         ("code_files",))


# ---------------------------------------------------------------- edit histories
def order_events(spark: SparkSession, sf: str) -> DataFrame:
    """orders as the edits of a file per customer: n-th edit turns <m-1> into <m>; every seventh does not match."""
    from pyspark.sql import Window as W
    o = read(spark, sf, "orders")
    days = F.floor(epoch_seconds(F.col("o_orderdate")) / 86400)
    timed = o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"),
                     (days * 10000000 + F.col("o_orderkey") * 2).alias("time"))
    numbered = timed.withColumn("n", F.row_number().over(W.partitionBy("cust").orderBy("time")))
    m = F.col("n") - F.floor(F.col("n") / 7)
    tag = lambda c: F.concat(F.lit("<"), c.cast("string"), F.lit(">"))
    bad = F.col("n") % 7 == 0
    return numbered.select(
        "cust", F.concat(F.lit("/repo/c"), F.col("cust").cast("string"), F.lit(".py")).alias("file_path"), "time", "seq", "n", "price",
        m.cast("bigint").alias("m"), F.concat(F.lit("s"), (F.col("cust") % 9).cast("string")).alias("session_id"),
        F.when(bad, "<none>").otherwise(tag(m - 1)).alias("old"), F.when(bad, "<bad>").otherwise(tag(m)).alias("new"))


sql_view("order_events", """
SELECT cust, '/repo/c' || cust || '.py' AS file_path, time, seq, n, price, n - n // 7 AS m, 's' || (cust % 9) AS session_id,
  CASE WHEN n % 7 = 0 THEN '<none>' ELSE '<' || (n - n // 7 - 1) || '>' END AS old,
  CASE WHEN n % 7 = 0 THEN '<bad>' ELSE '<' || (n - n // 7) || '>' END AS new
FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY time) AS n FROM (
  SELECT o_custkey AS cust, o_orderkey AS seq, o_totalprice AS price, date_diff('day', TIMESTAMP '1970-01-01', o_orderdate) * 10000000 + o_orderkey * 2 AS time FROM orders))""")


def order_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """A full copy before the first edit, and one right after every tenth."""
    e = order_events(spark, sf)
    text = lambda c: F.concat(F.lit("head <"), c.cast("string"), F.lit("> tail"))
    first = e.filter("n = 1").select("file_path", F.lit(0).cast("bigint").alias("time"), text(F.lit(0)).alias("content"), F.lit(0).cast("bigint").alias("seq"))
    later = e.filter("n % 10 = 0").select("file_path", (F.col("time") + 1).alias("time"), text(F.col("m")).alias("content"), "seq")
    return first.unionByName(later)

"""Mining and curation queries over the `sessions`, `parts` and `diffs` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom import fixed_values as fv
from gradeloom.operators import curation, linediff, mining
from gradeloom.operators.ordered import running_number
from gradeloom.plans.registry import query, quoted, read
from gradeloom.plans.views import (changed_sql, diffs, folded, parts, session_edits, session_info, sessions, sql_view,
                                   with_views)
from gradeloom.sources.transcripts import part_events

q = quoted


def nocase(pattern):
    return quoted("(?i)" + pattern)


def goals(spark, sf):
    return mining.attach_goals(session_edits(spark, sf), sessions(spark, sf), width=4)


@query("edit_goals", with_views("goals", body="SELECT session_id, ts, goal_ts, md5(goal) AS goal_md5 FROM goals"))
def edit_goals(spark, sf):
    return goals(spark, sf).select("session_id", "ts", "goal_ts", F.md5("goal").alias("goal_md5"))


@query("session_metadata", with_views("session_edits", "session_info", body="""
SELECT e.session_id, e.ts, i.title, i.directory, coalesce('/tree/' || i.project_id, '') AS project
FROM session_edits e LEFT JOIN session_info i USING (session_id)"""))
def session_metadata(spark, sf):
    info = session_info(spark, sf)
    projects = info.filter("project_id IS NOT NULL").select(
        F.col("project_id").alias("id"), F.concat(F.lit("/tree/"), "project_id").alias("worktree")).distinct()
    return mining.with_session_info(session_edits(spark, sf), info, projects).select(
        "session_id", "ts", "title", "directory", "project")


CODE_LINES = f"len(list_filter(str_split(%s, chr(10)), lambda l: regexp_matches(l, {q(fv.CODE_LIKE_LINE)})))"
LOOKS = lambda c: f"(len(str_split({c}, chr(10))) >= 3 AND {CODE_LINES % c} >= 2)"
sql_view("extracted", f"""
SELECT *, len(regexp_extract_all({folded("goal || chr(10) || buggy")}, {nocase(fv.EXTRACT_FIX)})) AS fix_signal,
  len(regexp_extract_all({folded("goal || chr(10) || buggy")}, {nocase(fv.EXTRACT_FEATURE)})) AS feat_signal
FROM goals WHERE regexp_extract(path, '[^.]*$') IN ({", ".join(q(e) for e in fv.CODE_EXTENSIONS)}) AND length(fixed) > 0
  AND length(buggy) BETWEEN 120 AND 6000 AND trim(buggy, ' ' || chr(10) || chr(9)) <> trim(fixed, ' ' || chr(10) || chr(9))
  AND ({LOOKS('buggy')} OR {LOOKS('fixed')})""", ("goals",))


def extracted(spark, sf):
    return curation.extraction_gate(goals(spark, sf))


@query("extracted_pairs", with_views("extracted", body="""
SELECT session_id, ts, path, goal_ts, fix_signal, feat_signal FROM extracted"""))
def extracted_pairs(spark, sf):
    return extracted(spark, sf).select("session_id", "ts", "path", "goal_ts", "fix_signal", "feat_signal")


@query("goal_relevance", with_views("goals", body=f"""
WITH t AS (SELECT session_id, ts, lower(goal) AS goal, len(list_filter(list_distinct(regexp_extract_all(
  lower(buggy || chr(10) || path), {q(fv.RELEVANCE_TOKEN)})), lambda x: contains(lower(goal), x)
  AND x NOT IN ({", ".join(q(w) for w in fv.RELEVANCE_STOPWORDS)}))) AS hits FROM goals)
SELECT session_id, ts, CASE WHEN goal = '' THEN 0.0 ELSE round(least(1.0, least(0.5, 0.25 * hits)
  + CASE WHEN regexp_matches({folded('goal')}, {nocase(fv.RELEVANCE_DEFECT)}) THEN 0.5 ELSE 0 END), 2) END::DOUBLE AS relevance FROM t"""))
def goal_relevance(spark, sf):
    return goals(spark, sf).select("session_id", "ts", curation.goal_relevance(
        F.col("goal"), F.col("buggy"), F.col("path")).alias("relevance"))


LANG = "CASE ext " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.LANGUAGE_OF_EXTENSION.items()) + " ELSE ext END"
COUNTS = """SELECT {k}, count(*) AS n_changed, count(*) FILTER (WHERE length(trim(text)) >= 4 AND NOT regexp_matches(trim(text), '^(#|//|[*]|/[*])'))
  AS n_substantive, count(*) FILTER (WHERE sign = '+') AS n_added, count(*) FILTER (WHERE sign = '-') AS n_removed,
  1.0 - count(*) FILTER (WHERE length(rtrim(text)) <= 2) / count(*) AS strength FROM chg GROUP BY {k}"""
sql_view("gated", f"""WITH {changed_sql('chg', 'goals', 'ingest_seq', 'buggy', 'fixed')},
 counts AS ({COUNTS.format(k='ingest_seq')}),
 j AS (SELECT g.*, coalesce(n_changed, 0) AS n_changed, coalesce(n_substantive, 0) AS n_substantive,
   regexp_extract(path, '[^.]*$') AS ext, trim(goal, ' ' || chr(10)) AS tg FROM goals g LEFT JOIN counts USING (ingest_seq)),
 r AS (SELECT *, {LANG} AS lang, CASE WHEN length(buggy) NOT BETWEEN 160 AND 3000 OR length(fixed) NOT BETWEEN 160 AND 3000 THEN 'len'
   WHEN tg <> '' AND regexp_matches({folded('tg')}, {nocase(fv.GATE_GENERIC_GOAL)}) THEN 'generic_goal'
   WHEN n_changed < 2 THEN 'tiny_diff' WHEN n_substantive < 1 THEN 'non_logic_diff'
   WHEN {LANG} NOT IN ('python', 'javascript', 'typescript', 'tsx', 'shell') THEN 'lang' END AS reason FROM j)
SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason, buggy, fixed ORDER BY ingest_seq) > 1 THEN 'dupe'
   ELSE reason END AS skip_reason FROM r""", ("goals",))


@query("task_gate", with_views("gated", body=f"""
SELECT session_id, ts, lang, regexp_matches(path, {nocase(fv.GATE_TEST_PATH)}) AS is_test, n_changed, n_substantive,
  regexp_matches({folded('goal')}, {nocase(fv.GATE_ALTERNATIVES)}) AS goal_had_alternatives, skip_reason FROM gated"""))
def task_gate(spark, sf):
    return curation.task_gate(goals(spark, sf)).select(
        "session_id", "ts", "lang", "is_test", "n_changed", "n_substantive", "goal_had_alternatives", "skip_reason")


@query("skip_reason_counts", with_views("gated", body="""
SELECT coalesce(skip_reason, 'kept') AS reason, count(*) AS n FROM gated GROUP BY ALL"""))
def skip_reason_counts(spark, sf):
    return curation.reason_counts(curation.task_gate(goals(spark, sf)))


sql_view("episodes", """
SELECT session_id, goal_ts, path, arg_min(goal, ingest_seq) AS goal, arg_min(buggy, ingest_seq) AS buggy,
  arg_max(fixed, ingest_seq) AS fixed, count(*) AS n_edits, max(fix_signal) AS fix_signal, max(feat_signal) AS feat_signal,
  min(ts) AS ts FROM extracted GROUP BY session_id, goal_ts, path
HAVING trim(arg_min(buggy, ingest_seq)) <> trim(arg_max(fixed, ingest_seq))""", ("extracted",))


@query("episodes", with_views("episodes", body="""
SELECT session_id, goal_ts, path, ts, n_edits, fix_signal, feat_signal, md5(buggy) AS buggy_md5, md5(fixed) AS fixed_md5 FROM episodes"""))
def episodes(spark, sf):
    return mining.episodes(extracted(spark, sf)).select(
        "session_id", "goal_ts", "path", "ts", "n_edits", "fix_signal", "feat_signal",
        F.md5("buggy").alias("buggy_md5"), F.md5("fixed").alias("fixed_md5"))


def count_sql(column, pattern):
    return f"len(regexp_extract_all({folded(column)}, {q(pattern)}))"


@query("episode_triage", with_views("episodes", body=f"""
WITH e AS (SELECT *, session_id || '|' || goal_ts || '|' || path AS id FROM episodes),
{changed_sql('chg', 'e', 'id', 'buggy', 'fixed')}, counts AS ({COUNTS.format(k='id')}),
j AS (SELECT e.*, coalesce(strength, 0) AS strength, trim(goal, ' ' || chr(10)) AS tg, regexp_extract(path, '[^.]*$') AS ext
  FROM e LEFT JOIN counts USING (id))
SELECT session_id, goal_ts, path, round(strength, 6) AS strength, CASE WHEN length(tg) < 15 THEN 'no_goal'
  WHEN regexp_matches({folded('tg')}, {nocase(fv.TRIAGE_JUNK_GOAL)}) OR regexp_matches({folded('tg')}, {nocase(fv.TRIAGE_GENERIC_GOAL)}) THEN 'junk_goal'
  WHEN length(buggy) < 150 OR length(fixed) < 150 THEN 'tiny' WHEN length(buggy) > 4000 OR length(fixed) > 4000 THEN 'huge'
  WHEN strength < 0.3 THEN 'weak_diff' WHEN {LANG} IN ('json', 'yaml', 'service', 'conf') THEN 'config'
  WHEN strength <= 0.25 AND {" AND ".join(f"{count_sql('buggy', p)} = {count_sql('fixed', p)}" for p in fv.BEHAVIOUR_TOKENS)} THEN 'weak_diff'
  END AS skip_reason FROM j"""))
def episode_triage(spark, sf):
    return curation.episode_triage(mining.episodes(extracted(spark, sf))).select(
        "session_id", "goal_ts", "path", F.round("strength", 6).alias("strength"), "skip_reason")


@query("keyword_tags", with_views("sessions", body="SELECT session_id, ts, array_to_string(list_filter(["
       + ", ".join("CASE WHEN " + " + ".join(f"contains(lower(text), {q(w)})::INT" for w in ws) + f" >= 2 THEN {q(n)} END"
                   for n, ws in fv.STRUGGLE_CATEGORIES.items()) + "], lambda x: x IS NOT NULL), ',') AS tags FROM sessions"))
def keyword_tags(spark, sf):
    return sessions(spark, sf).select("session_id", "ts", F.array_join(mining.keyword_tags(F.col("text")), ",").alias("tags"))


STUCK = " + ".join(f"contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), {q(m)})::INT" for m in fv.STRUGGLE_MARKERS)


WORDS = list(dict.fromkeys(w for ws in fv.STRUGGLE_CATEGORIES.values() for w in ws))
HAS_WORD = ", ".join(f"bool_or(contains(low, {q(w)})) AS w{i}" for i, w in enumerate(WORDS))
CATEGORIES = ", ".join("CASE WHEN " + " + ".join(f"(coalesce(w{WORDS.index(w)}, false) OR contains(lower(coalesce(title, '')), {q(w)}))::INT" for w in ws)
                       + f" >= 2 THEN {q(n)} END" for n, ws in fv.STRUGGLE_CATEGORIES.items())


@query("hard_sessions", with_views("part_rows", "session_info", body=f"""
WITH p AS (SELECT *, CASE WHEN part_type = 'text' THEN {STUCK} WHEN tool = 'bash' THEN 1 ELSE 0 END AS stuck,
  CASE WHEN tool = 'write' THEN 0 WHEN tool = 'edit' THEN greatest(len(str_split(regexp_replace(prev, '\\n$', ''), chr(10))),
    len(str_split(regexp_replace(text, '\\n$', ''), chr(10)))) END AS size,
  CASE WHEN part_type = 'text' THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS said FROM part_rows),
 s AS (SELECT session_id, count(*) AS turns, count(*) FILTER (WHERE part_type = 'tool') AS tool_calls, count(*) FILTER (WHERE tool IN ('edit', 'write')) AS edits,
  sum(stuck)::BIGINT AS struggle_hits, arg_min(said, ts) FILTER (said <> '') AS symptom,
  arg_max(struct_pack(t := ts, n := size, o := length(coalesce(prev, '')) > 0 AND tool = 'edit', p := path), size * 100000 - ts) FILTER (size IS NOT NULL) AS fix
  FROM p GROUP BY session_id),
 w AS (SELECT session_id, {HAS_WORD} FROM (SELECT session_id, lower(text) AS low FROM p WHERE said <> '') GROUP BY session_id)
SELECT s.session_id, i.title, turns, tool_calls, edits, struggle_hits,
  round(least(1.0, struggle_hits / CASE WHEN tool_calls > 0 THEN tool_calls ELSE turns END), 3) AS struggle_ratio, fix.p AS fix_file,
  CASE WHEN fix.o THEN fix.n ELSE 0 END::BIGINT AS fix_changed_lines, fix.t AS fix_time,
  array_to_string(list_filter([{CATEGORIES}], lambda x: x IS NOT NULL), ',') AS categories, symptom
FROM s LEFT JOIN w USING (session_id) LEFT JOIN session_info i USING (session_id) WHERE turns >= 2 AND struggle_hits >= 1 AND edits >= 1"""))
def hard_sessions(spark, sf):
    events = part_events(parts(spark, sf), finished=False)
    return mining.hard_sessions(events, session_info(spark, sf), 2, 1, 1).withColumn("categories", F.array_join("categories", ","))


@query("candidate_messages", with_views("sessions", body=f"""
WITH c AS (SELECT session_id, ts, len(list_filter(str_split(text, chr(10)), lambda l: regexp_matches({folded('l')}, {q(fv.CANDIDATE_CODE_LINE)}))) AS code_lines,
  ((length(text) - length(replace(text, '```', ''))) // 3)::BIGINT AS fenced,
  len(regexp_extract_all({folded('text')}, {nocase(fv.CANDIDATE_DEFECT)})) AS bugs,
  len(regexp_extract_all({folded('text')}, {nocase(fv.CANDIDATE_ALTERNATIVE)})) AS alts FROM sessions)
SELECT *, (least(code_lines, 12) * 2 + fenced * 4 + least(bugs, 6) + least(alts, 4))::BIGINT AS score FROM c
WHERE code_lines >= 3 OR fenced >= 2 ORDER BY score DESC, session_id, ts LIMIT 60"""))
def candidate_messages(spark, sf):
    return mining.candidate_messages(sessions(spark, sf), fv.CANDIDATE_LIMIT).select(
        "session_id", "ts", "code_lines", "fenced", "bugs", "alts", "score")


@query("code_messages", with_views("sessions", "session_info", body="SELECT s.session_id, s.ts, i.title FROM sessions s JOIN session_info i "
       "USING (session_id) WHERE role = 'user' AND (" + " OR ".join(f"contains(text, {q(h)})" for h in fv.CODE_HINTS) + ")"))
def code_messages(spark, sf):
    return mining.with_session_info(mining.code_messages(sessions(spark, sf)), session_info(spark, sf)).select(
        "session_id", "ts", "title")


@query("transcript_tool_events", with_views("part_events", body="""
SELECT session_id, ts, tool, status, path, CASE WHEN tool = 'write' THEN md5(text) END AS content_md5,
  CASE WHEN tool = 'edit' THEN md5(prev) END AS old_md5, CASE WHEN tool = 'edit' THEN md5(text) END AS new_md5
FROM part_events WHERE tool IN ('read', 'write', 'edit')"""))
def transcript_tool_events(spark, sf):
    e = part_events(parts(spark, sf), ("read", "write", "edit"), paths_only=True)
    return e.select("session_id", "ts", "tool", "status", "path", F.md5("content").alias("content_md5"),
                    F.md5("old").alias("old_md5"), F.md5("new").alias("new_md5"))


@query("edited_files", with_views("part_events", body="""
SELECT path, count(*) FILTER (WHERE tool = 'edit') AS edits, count(*) FILTER (WHERE tool = 'write') AS writes FROM part_events
WHERE path LIKE '%.py' GROUP BY path"""))
def edited_files(spark, sf):
    return mining.edited_files(part_events(parts(spark, sf), paths_only=True), "%.py")


# ---------------------------------------------------------------- diffs
sql_view("changes", f"WITH {changed_sql('chg', 'diffs', 'task_id', 'buggy', 'reference_fix')} SELECT * FROM chg", ("diffs",))


@query("changed_lines", with_views("changes", body="SELECT task_id, sign, n, text FROM changes"))
def changed_lines(spark, sf):
    return linediff.changed_lines(diffs(spark, sf), "task_id").select(
        "task_id", "sign", F.col("n").cast("bigint").alias("n"), "text")


ROTATED = """SELECT doc_id AS task_id, coalesce(text, '') AS buggy, array_to_string(list_concat(ls[h + 1:], ls[:h]), chr(10)) AS reference_fix, len(ls) AS n
FROM (SELECT *, len(ls) // 2 AS h FROM (SELECT doc_id, text, str_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"""


@query("rebuilt_from_changes", f"""
SELECT task_id, sha256(reference_fix) AS rebuilt_sha256, buggy <> reference_fix AS changed, 0::BIGINT AS growth FROM ({ROTATED})""")
def rebuilt_from_changes(spark, sf):
    """Every document against itself with its halves swapped: the changes, applied to the old text, make the new one."""
    ls = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    half = (F.size("ls") / 2).cast("int")
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("task_id"), F.coalesce("text", F.lit("")).alias("buggy"), ls.alias("ls"))
    pairs = docs.select("task_id", "buggy", F.array_join(F.concat(F.slice("ls", half + 1, F.size("ls") - half), F.slice("ls", 1, half)), "\n").alias("reference_fix"))
    changes = linediff.changed_lines(pairs, "task_id")
    counts = changes.groupBy("task_id").agg(F.sum(F.when(F.col("sign") == "+", 1).otherwise(-1)).alias("growth"))
    rebuilt = linediff.apply_changes(pairs, changes, "task_id")
    return rebuilt.join(counts, "task_id", "left").select(
        "task_id", F.sha2("rebuilt", 256).alias("rebuilt_sha256"), F.col("growth").isNotNull().alias("changed"), F.coalesce("growth", F.lit(0)).alias("growth"))


@query("diff_counts", with_views("changes", body="WITH chg AS (SELECT * FROM changes) SELECT * EXCLUDE (strength), round(strength, 6) AS strength FROM ("
       + COUNTS.format(k="task_id") + ")"))
def diff_counts(spark, sf):
    return linediff.diff_counts(linediff.changed_lines(diffs(spark, sf), "task_id"), "task_id").withColumn(
        "strength", F.round("strength", 6))


TOKEN_SQL = r"[A-Za-z_][\p{L}\p{M}\p{N}_]*|\d+\.?\d*|\S"


sql_view("identifiers", f"""
WITH toks AS (SELECT task_id, side, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM (
   SELECT task_id, 'b' AS side, regexp_extract_all(buggy, {q(TOKEN_SQL)}) AS t FROM diffs
   UNION ALL SELECT task_id, 'f', regexp_extract_all(reference_fix, {q(TOKEN_SQL)}) FROM diffs)),
 ids AS (SELECT task_id, side, tok, row_number() OVER (PARTITION BY task_id, side ORDER BY min(pos)) - 1 AS id FROM toks
   WHERE regexp_matches(tok, '^[\\p{{L}}_]') GROUP BY task_id, side, tok)
SELECT task_id, side, string_agg(CASE WHEN id IS NULL THEN tok ELSE 'ID' || id END, ' ' ORDER BY pos) AS norm
FROM toks LEFT JOIN ids USING (task_id, side, tok) GROUP BY task_id, side""", ("diffs",))


@query("identifier_fingerprints", with_views("identifiers", body="""
SELECT b.task_id, sha256(b.norm || '||' || f.norm) AS fingerprint FROM identifiers b JOIN identifiers f USING (task_id)
WHERE b.side = 'b' AND f.side = 'f'"""))
def identifier_fingerprints(spark, sf):
    return curation.fingerprint(diffs(spark, sf), "buggy", "reference_fix").select("task_id", "fingerprint")


@query("deduped_tasks", with_views("identifiers", body="""
SELECT min(b.task_id) AS task_id FROM identifiers b JOIN identifiers f USING (task_id)
WHERE b.side = 'b' AND f.side = 'f' GROUP BY b.norm, f.norm"""))
def deduped_tasks(spark, sf):
    return curation.dedupe_tasks(diffs(spark, sf)).select("task_id")


OUTSIDE = """regexp_replace(regexp_replace(t, '''[^'']*''', '', 'g'), '"[^"]*"', '', 'g')"""
QN = lambda ch: f"(length(t) - length(replace(t, {q(ch)}, '')))"
sql_view("categorized", f"""
WITH l AS (SELECT *, trim(text, ' ' || chr(9) || chr(13)) AS t FROM changes),
 m AS (SELECT *, t = '' OR ({QN('"')} + {QN("'")} + {QN('`')} >= 2 AND len(regexp_extract_all(t, '\\p{{L}}')) >= 3
     AND NOT regexp_matches({OUTSIDE}, {q(fv.CALL_ADDED)}) AND NOT regexp_matches({OUTSIDE}, {q(fv.BRANCH_ADDED)})) AS prose,
   sign = '+' AND t <> '' AND NOT regexp_matches(t, '^(#|//|[*])')
     AND NOT (regexp_matches(t, {q(fv.BARE_LITERAL_LINE)}) AND ({QN('"')} >= 2 OR {QN("'")} >= 2)) AS logic FROM l),
 g AS (SELECT task_id, bool_and(prose) AS prose_only, count(*) FILTER (WHERE sign = '+') AS added, count(*) FILTER (WHERE logic) AS logic,
   count(*) FILTER (WHERE logic AND regexp_matches(text, {nocase(fv.DEFENCE_ADDED)})) AS defensive,
   count(*) FILTER (WHERE sign = '+' AND regexp_matches(text, {q(fv.BRANCH_ADDED)})) AS branches,
   count(*) FILTER (WHERE logic AND NOT regexp_matches(t, {q(fv.OPTION_LINE)})) AS not_option,
   count(*) FILTER (WHERE logic AND NOT regexp_matches(t, {q(fv.CALL_ADDED)})) AS not_call FROM m GROUP BY task_id),
 s AS (SELECT d.*, coalesce(prose_only, false) AS prose_only, coalesce(added, 0) AS added, coalesce(logic, 0) AS logic,
   coalesce(defensive, 0) AS defensive, coalesce(branches, 0) AS branches, coalesce(not_option, 0) AS not_option,
   coalesce(not_call, 0) AS not_call, b.norm = f.norm AS renamed, regexp_matches(goal, {nocase(fv.CURATION_DEFECT)}) AS defect,
   regexp_matches(goal, {nocase(fv.CURATION_FEATURE)}) AS feature FROM diffs d LEFT JOIN g USING (task_id)
   JOIN identifiers b ON b.task_id = d.task_id AND b.side = 'b' JOIN identifiers f ON f.task_id = d.task_id AND f.side = 'f'),
 v AS (SELECT *, least(defensive, 3) + least(branches, 2) + CASE WHEN defect THEN 2 ELSE 0 END AS score FROM s)
SELECT *, CASE WHEN category <> 'unclassified' THEN [category, '']
   WHEN buggy = reference_fix THEN ['ambiguous', '0.9'] WHEN prose_only THEN ['documentation', '0.85']
   WHEN renamed THEN ['refactor', CASE WHEN regexp_matches(goal, {nocase(fv.CURATION_RENAME)}) THEN '0.9' ELSE '0.75' END]
   WHEN score >= 3 AND defensive >= 1 THEN ['bug_fix', round(least(0.95, 0.55 + 0.1 * score), 2)::DOUBLE::VARCHAR]
   WHEN defect AND branches >= 1 AND logic > 0 THEN ['bug_fix', '0.62']
   WHEN regexp_matches(file_name, {nocase(fv.CONFIG_SUFFIX)}) THEN ['configuration', '0.7']
   WHEN logic > 0 AND branches = 0 AND defensive = 0 AND not_option = 0 THEN ['feature_addition', '0.72']
   WHEN feature AND NOT defect AND added > 0 AND not_call = 0 THEN ['feature_addition', '0.7']
   WHEN feature AND NOT defect THEN ['feature_addition', '0.6'] WHEN logic = 0 THEN ['refactor', '0.6']
   ELSE ['ambiguous', '0.3'] END AS found FROM v""", ("changes", "identifiers"))


def categorized(spark, sf):
    return curation.categorize(diffs(spark, sf))


@query("categorized_tasks", with_views("categorized", body="""
SELECT task_id, found[1] AS category, nullif(found[2], '')::DOUBLE AS category_confidence FROM categorized"""))
def categorized_tasks(spark, sf):
    kept = diffs(spark, sf).select("task_id", (F.col("category") != "unclassified").alias("_kept"))
    return categorized(spark, sf).join(kept, "task_id").select(
        "task_id", "category", F.when(~F.col("_kept"), F.col("category_confidence")).alias("category_confidence"))


@query("category_counts", with_views("categorized", body="SELECT found[1] AS category, count(*) AS n FROM categorized GROUP BY ALL"))
def category_counts(spark, sf):
    return curation.count_by(categorized(spark, sf), "category")


@query("inferred_defects", with_views("changes", "diffs", body="""
WITH a AS (SELECT task_id, coalesce(string_agg(text, '' ORDER BY n) FILTER (sign = '+'), '') AS added FROM diffs d LEFT JOIN changes c USING (task_id) GROUP BY task_id)
SELECT task_id, CASE """ + " ".join(f"WHEN regexp_matches(added, {q(p)}) THEN {q(v)}" for p, v in fv.ADDED_LINE_CATEGORIES)
       + " ELSE 'other' END AS inferred FROM a"))
def inferred_defects(spark, sf):
    d = diffs(spark, sf).select("task_id")
    texts = linediff.diff_texts(linediff.changed_lines(diffs(spark, sf), "task_id"), "task_id")
    return d.join(texts, "task_id", "left").select("task_id", curation.inferred_defect(F.col("added_text")).alias("inferred"))


CAP_SRC = """WITH c AS (SELECT task_id, file_name, ingest_seq, found[1] AS category, task_id % 3 = 0 AS alt, (task_id % 7) / 10.0 AS conf,
   (task_id % 5) / 10.0 AS rel FROM categorized)"""


def capped_source(spark, sf):
    t = F.col("task_id")
    return diffs(spark, sf).select(
        "task_id", "file_name", "ingest_seq", (t % 3 == 0).alias("goal_had_alternatives"),
        ((t % 7) / 10.0).alias("category_confidence"), ((t % 5) / 10.0).alias("goal_relevance"))


@query("capped_per_file", with_views("categorized", body=CAP_SRC + """
SELECT task_id, file_name FROM c QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY alt DESC, conf DESC, ingest_seq) <= 2"""))
def capped_per_file(spark, sf):
    return curation.cap_per_file(capped_source(spark, sf)).select("task_id", "file_name")


@query("capped_final", with_views("categorized", body=CAP_SRC + """
SELECT task_id, file_name FROM c QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY alt, rel DESC, ingest_seq) <= 3"""))
def capped_final(spark, sf):
    return curation.cap_final(capped_source(spark, sf)).select("task_id", "file_name")


GOAL_ANSWERS = """answers AS (SELECT task_id, 'sums items ' AS summary, CASE WHEN task_id % 4 = 0 THEN '' ELSE ' wrong on empty' END AS defect,
   CASE WHEN task_id % 3 = 0 THEN 'empty list' ELSE '' END AS trigger FROM categorized WHERE task_id % 2 = 0),
 m AS (SELECT c.task_id, found[1] AS category, goal AS g, a.*EXCLUDE(task_id), found[1] = 'bug_fix' AND coalesce(a.defect, '') <> '' AS ok
   FROM categorized c LEFT JOIN answers a USING (task_id)),
 r AS (SELECT task_id, category, CASE WHEN ok THEN trim(summary) || ' Defect: ' || trim(defect) || CASE WHEN trigger <> '' THEN ' Trigger: ' || trigger ELSE '' END
   ELSE g END AS goal, CASE WHEN ok THEN 'synth' ELSE 'user' END AS goal_source, CASE WHEN ok THEN g ELSE '' END AS original_goal FROM m)"""


def merged(spark, sf):
    t = F.col("task_id")
    base = categorized(spark, sf)
    answers = base.filter(t % 2 == 0).select(
        "task_id", F.lit("sums items ").alias("summary"), F.when(t % 4 == 0, "").otherwise(" wrong on empty").alias("defect"),
        F.when(t % 3 == 0, "empty list").otherwise("").alias("trigger"))
    return curation.merge_synthesized_goals(base, answers)


@query("synthesized_goals", with_views("categorized", body="WITH " + GOAL_ANSWERS + """
SELECT task_id, goal, goal_source, original_goal FROM r"""))
def synthesized_goals(spark, sf):
    return merged(spark, sf).select("task_id", "goal", "goal_source", "original_goal")


@query("primary_tasks", with_views("categorized", body="WITH " + GOAL_ANSWERS + """
SELECT task_id FROM r WHERE category = 'bug_fix' AND (goal_source = 'synth' OR (task_id % 10) / 10.0 >= 0.6)"""))
def primary_tasks(spark, sf):
    return curation.primary_tasks(merged(spark, sf).withColumn(
        "goal_relevance", (F.col("task_id") % 10) / 10.0)).select("task_id")


@query("numbered_tasks", """SELECT doc_id, 'B' || lpad((row_number() OVER (ORDER BY doc_id))::VARCHAR, 4, '0') AS task_id FROM documents""")
def numbered_tasks(spark, sf):
    """Running ids in file order; padding widens, never cuts, once the count passes four digits."""
    numbered = running_number(read(spark, sf, "documents").select("doc_id"), "doc_id", width=256)
    p = F.col("position").cast("string")
    return numbered.select("doc_id", F.concat(F.lit("B"), F.when(F.length(p) < 4, F.lpad(p, 4, "0")).otherwise(p)).alias("task_id"))


@query("path_traits", with_views("session_edits", body=f"""
SELECT session_id, ts, {LANG} AS lang, regexp_matches(path, {nocase(fv.GATE_TEST_PATH)}) AS is_test,
  ext IN ({", ".join(q(e) for e in fv.CODE_EXTENSIONS)}) AS is_code FROM (SELECT *, regexp_extract(path, '[^.]*$') AS ext FROM session_edits)"""))
def path_traits(spark, sf):
    return curation.path_traits(session_edits(spark, sf)).select("session_id", "ts", "lang", "is_test", "is_code")

"""Grading, replies, code lines and privacy queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gradeloom import fixed_values as fv
from gradeloom.operators import grading, linediff, mutation, outcomes, panel, privacy
from gradeloom.operators.similarity import patch_similarity
from gradeloom.plans.registry import query, quoted as q, read
from gradeloom.plans.staging import fresh_path
from gradeloom.plans.views import code_files, diffs, order_events, runs, sql_view, tasks, with_views
from gradeloom.sources import files

# ---------------------------------------------------------------- diagnoses and repairs


def predictions(spark, sf):
    d, t = diffs(spark, sf), F.col("task_id")
    loc = (F.when(t % 4 == 0, "    total = 0").when(t % 4 == 1, F.concat(F.lit("see Line "), (F.col("text_lines") + 2).cast("string")))
           .when(t % 4 == 2, "= 0").otherwise(""))
    return d.select("task_id", loc.alias("fault_location"),
                    F.when(t % 3 == 0, "null_handling").when(t % 3 == 1, "boundary").otherwise("").alias("bug_category"),
                    ((t % 5) / 4.0).alias("judge_agreement"))


DIAGNOSED = f"""
WITH p AS (SELECT task_id, reference_fix, CASE task_id % 4 WHEN 0 THEN 'total = 0' WHEN 1 THEN 'see Line ' || (text_lines + 2) WHEN 2 THEN '= 0' ELSE '' END AS q,
   CASE WHEN task_id % 4 = 1 THEN text_lines + 2 END AS num, (task_id % 5) / 4.0::DOUBLE AS j,
   CASE task_id % 3 WHEN 0 THEN 'null_handling' WHEN 1 THEN 'boundary' ELSE '' END AS said FROM diffs),
 r AS (SELECT p.task_id, bool_or(sign = '-' AND (trim(text) = q OR contains(text, q) OR contains(q, trim(text)))) AS touch,
   bool_or(sign = '-' AND n = num) AS hit, coalesce(string_agg(text, '' ORDER BY n) FILTER (sign = '+'), '') AS added
   FROM p LEFT JOIN changes c USING (task_id) GROUP BY p.task_id),
 s AS (SELECT p.*, CASE WHEN q <> '' AND (coalesce(touch, false) OR list_contains(list_transform(str_split(reference_fix, chr(10)), lambda l: trim(l)), q))
     OR coalesce(hit, false) THEN 1.0 ELSE 0.0 END AS loc,
   CASE {" ".join(f"WHEN regexp_matches(added, {q(p)}) THEN {q(v)}" for p, v in fv.ADDED_LINE_CATEGORIES)} ELSE 'other' END AS expected FROM p JOIN r USING (task_id))
SELECT task_id, loc::DOUBLE AS location_match, j AS judge_score, expected AS expected_category,
  (CASE WHEN said = '' THEN 0.0 WHEN said = expected THEN 1.0 WHEN j >= 0.6 THEN 0.5 ELSE 0.0 END)::DOUBLE AS category_match,
  round(0.5 * loc + 0.3 * j + 0.2 * CASE WHEN said = '' THEN 0.0 WHEN said = expected THEN 1.0 WHEN j >= 0.6 THEN 0.5 ELSE 0.0 END, 4)::DOUBLE AS total FROM s"""


@query("diagnosis_scores", with_views("changes", body=DIAGNOSED))
def diagnosis_scores(spark, sf):
    return grading.score_diagnoses(diffs(spark, sf), predictions(spark, sf)).select(
        "task_id", "location_match", "judge_score", "category_match", "expected_category", "total")


def answers(spark, sf):
    t = F.col("task_id")
    fixed = F.col("reference_fix")
    return diffs(spark, sf).select(
        "task_id", F.when(t % 3 == 0, F.concat(fixed, F.lit("\n"), fixed)).when(t % 3 == 1, F.col("buggy")).otherwise("").alias("candidate"),
        ((t % 5) / 4.0).alias("judge_agreement"), F.when(t % 2 == 0, (t % 7) / 7.0).alias("oracle_score"))


@query("repair_scores", with_views("diffs", body="""
WITH a AS (SELECT task_id, task_id % 3 AS v, (task_id % 5) / 4.0::DOUBLE AS j, CASE WHEN task_id % 2 = 0 THEN (task_id % 7) / 7.0::DOUBLE END AS o,
  CASE WHEN task_id % 3 = 0 THEN 2.0 / 3 ELSE 0 END AS sim FROM diffs)
SELECT task_id, v = 1 AS unchanged, CASE WHEN v = 1 THEN 0 ELSE round(sim, 4) END::DOUBLE AS patch_similarity,
  CASE WHEN v = 1 THEN 0 WHEN o IS NULL THEN round(0.5 * j + 0.5 * sim, 4) ELSE round(0.5 * j + 0.3 * sim + 0.2 * o, 4) END::DOUBLE AS total,
  CASE WHEN v = 1 THEN 0 WHEN o IS NULL THEN round(j, 4) ELSE round(0.8 * j + 0.2 * o, 4) END::DOUBLE AS rank_score,
  CASE WHEN o IS NULL THEN 'none' ELSE 'exec_diff' END AS oracle FROM a"""))
def repair_scores(spark, sf):
    return grading.score_repairs(answers(spark, sf), diffs(spark, sf)).select(
        "task_id", "unchanged", "patch_similarity", "total", "rank_score", "oracle")


@query("patch_similarities")
def patch_similarities(spark, sf):
    """Whole texts of neighbouring documents, compared token by token."""
    out = patch_similarity(tasks(spark, sf), "buggy", "reference_fix")
    return out.select("task_id", F.round("similarity", 4).alias("similarity"))


@query("regraded_rows", with_views("changes", body=DIAGNOSED.replace("SELECT task_id, loc::DOUBLE", "SELECT task_id, 0.5::DOUBLE AS old_total, loc::DOUBLE", 1)
       .replace("WITH p AS", "WITH g AS (WITH p AS", 1) + """)
SELECT task_id, total, (total <> 0.5)::INT::BIGINT AS n_changed FROM g"""))
def regraded_rows(spark, sf):
    fresh = grading.score_diagnoses(diffs(spark, sf), predictions(spark, sf))
    stored = diffs(spark, sf).select("task_id", F.lit(0.5).alias("total"))
    return grading.regrade(stored, fresh, ["task_id"], ["total"])


# ---------------------------------------------------------------- replies


@query("parsed_replies", with_views("runs", body="""
SELECT ingest_seq, CASE WHEN k BETWEEN 36 AND 63 THEN trim(raw) ELSE trim(candidate, chr(10)) END AS code,
  k BETWEEN 56 AND 60 AS has_diff, k = 39 AS wants_tools, k BETWEEN 36 AND 38 AS refuses, k BETWEEN 61 AND 63 AS declines,
  CASE WHEN k BETWEEN 46 AND 55 THEN 'missing guard' END AS root_cause, CASE WHEN k BETWEEN 46 AND 55 THEN 'line 3' END AS fault_location,
  CASE WHEN k BETWEEN 46 AND 55 THEN 'boundary' END AS bug_category, CASE WHEN k BETWEEN 46 AND 55 THEN '0.8' END AS confidence FROM runs"""))
def parsed_replies(spark, sf):
    return runs(spark, sf).select("ingest_seq", outcomes.parse_reply(F.col("repair.raw")).alias("r")).select("ingest_seq", "r.*")


@query("attempt_outcomes", with_views("runs", body="""
SELECT ingest_seq, CASE WHEN diagnose_error <> '' THEN 'transport' WHEN k = 60 THEN 'policy_violation' WHEN k BETWEEN 36 AND 38 THEN 'refused'
  WHEN k = 39 THEN 'needs_tools' WHEN k BETWEEN 61 AND 63 THEN 'declined_work' WHEN k BETWEEN 56 AND 60 THEN 'scored' ELSE 'invalid_response' END AS outcome,
  k BETWEEN 5 AND 7 AS retryable FROM runs"""))
def attempt_outcomes(spark, sf):
    r = runs(spark, sf).withColumn("r", outcomes.parse_reply(F.col("repair.raw")))
    return r.select("ingest_seq", outcomes.attempt_outcome(
        F.col("repair.raw"), F.col("r.has_diff"), F.col("r.wants_tools"), F.col("diagnose_error"), F.col("k") == 60).alias("outcome"),
        outcomes.transport_retryable(F.col("diagnose_error")).alias("retryable"))


# ---------------------------------------------------------------- judgements


def requests(spark, sf):
    r = runs(spark, sf).filter(F.length("repair.candidate") > 0)
    return r.select("ingest_seq", "task_id", F.col("repair.candidate").alias("candidate")).withColumn(
        "request_key", panel.request_key(F.col("task_id"), F.col("candidate")))


def judgement_cache(spark, sf):
    return requests(spark, sf).filter(F.substring("request_key", 1, 1) < "8").select(
        "request_key", F.lit(0.25).alias("answer")).distinct()


def literal_judge(batch: pd.DataFrame) -> pd.Series:
    return batch["candidate"].str.contains("return", regex=False).astype("float64")


REQ = """WITH r AS (SELECT ingest_seq, task_id, candidate, sha256(task_id || chr(0) || 'CAND' || chr(0) || candidate || chr(0) || 'NOREF' || chr(0)) AS request_key
  FROM runs WHERE candidate <> '')"""


@query("judgement_misses", with_views("runs", body=REQ + " SELECT DISTINCT request_key FROM r WHERE substr(request_key, 1, 1) >= '8'"))
def judgement_misses(spark, sf):
    return grading.judgement_misses(requests(spark, sf), judgement_cache(spark, sf)).select("request_key")


@query("judged_requests", with_views("runs", body=REQ + """
SELECT ingest_seq, CASE WHEN substr(request_key, 1, 1) < '8' THEN 0.25 WHEN contains(candidate, 'return') THEN 1.0 ELSE 0.0 END::DOUBLE AS answer FROM r"""))
def judged_requests(spark, sf):
    req, cache = requests(spark, sf), judgement_cache(spark, sf)
    fresh = grading.judge(grading.judgement_misses(req, cache), literal_judge)
    return grading.answer_requests(req, cache, fresh).select("ingest_seq", "answer")


# ---------------------------------------------------------------- localisation


def spans(spark, sf):
    d = diffs(spark, sf)
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.size(F.split("buggy", "\n", -1)) - 1) / 5).cast("int")))
    return d.select("task_id", blocks.alias("i")).select(
        "task_id", F.concat(F.lit("Sym"), F.col("i").cast("string"), F.lit("_")).alias("symbol"),
        (F.col("i") * 5 + 1).alias("start_line"), (F.col("i") * 5 + 5).alias("end_line"))


sql_view("touched", """
WITH minus AS (SELECT task_id, n FROM changes WHERE sign = '-'),
 plus AS (SELECT task_id, n - row_number() OVER (PARTITION BY task_id ORDER BY n) + 1 AS n FROM changes
   WHERE sign = '+' AND task_id NOT IN (SELECT task_id FROM minus))
SELECT DISTINCT task_id, 'Sym' || ((n - 1) // 5) || '_' AS symbol FROM (SELECT * FROM minus UNION ALL SELECT * FROM plus)""", ("changes",))


def touched(spark, sf):
    changes = linediff.changed_lines(diffs(spark, sf), "task_id")
    return grading.touched_symbols(changes, spans(spark, sf))


@query("touched_symbols", with_views("touched", body="SELECT task_id, symbol FROM touched"))
def touched_symbols(spark, sf):
    return touched(spark, sf)


def symbol_predictions(spark, sf):
    t = F.col("task_id")
    block = F.floor((F.col("text_lines") + 2 - 1) / 5).cast("string")
    return diffs(spark, sf).select(
        "task_id", F.when(t % 3 == 0, F.concat(F.lit("sym"), block)).when(t % 3 == 1, "other").otherwise("").alias("predicted_symbol"),
        F.when(t % 2 == 0, "guided").otherwise("blind").alias("mode"), F.concat(F.lit("m"), (t % 4).cast("string")).alias("model"))


IDENTIFIED = """WITH p AS (SELECT task_id, CASE task_id % 3 WHEN 0 THEN 'sym' || ((text_lines + 1) // 5) WHEN 1 THEN 'other' ELSE '' END AS ps,
   CASE WHEN task_id % 2 = 0 THEN 'guided' ELSE 'blind' END AS mode, 'm' || (task_id % 4) AS model FROM diffs),
 i AS (SELECT p.*, ps <> '' AND EXISTS (SELECT 1 FROM touched t WHERE t.task_id = p.task_id AND (contains(lower(symbol), ps) OR contains(ps, lower(symbol)))) AS identified FROM p)"""


@query("identified_symbols", with_views("touched", body=IDENTIFIED + " SELECT task_id, mode, model, identified FROM i"))
def identified_symbols(spark, sf):
    return grading.symbol_matches(symbol_predictions(spark, sf), touched(spark, sf)).select("task_id", "mode", "model", "identified")


@query("localisation_accuracy", with_views("touched", body=IDENTIFIED + """
SELECT mode, model, count(*) FILTER (WHERE identified) AS k, count(*) AS n, round(avg(identified::INT), 6) AS rate FROM i GROUP BY mode, model"""))
def localisation_accuracy(spark, sf):
    return grading.localisation_accuracy(grading.symbol_matches(symbol_predictions(spark, sf), touched(spark, sf)))


# ---------------------------------------------------------------- code lines


def file_lines(spark, sf):
    return mutation.code_lines(code_files(spark, sf))


@query("text_scan_lines", with_views("code_lines", body="SELECT path, n, md5(line) AS line_md5 FROM code_lines"))
def text_scan_lines(spark, sf):
    return file_lines(spark, sf).select("path", F.col("n").cast("bigint").alias("n"), F.md5("line").alias("line_md5"))


@query("scanned_tree_lines", with_views("code_files", body="""
WITH f AS (SELECT page_id % 16 AS file, string_agg(coalesce(text, ''), chr(10) ORDER BY page_id) AS whole FROM code_files GROUP BY file),
 l AS (SELECT file, str_split(whole, chr(10)) AS l FROM f)
SELECT file, n, md5(line) AS line_md5 FROM (SELECT file, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM l)"""))
def scanned_tree_lines(spark, sf):
    """All sources in 16 large files of a tree, scanned back line by line."""
    root = fresh_path(spark, "tree")
    rows = code_files(spark, sf).select((F.col("page_id") % 16).alias("file"), "page_id", F.coalesce("text", F.lit("")).alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "page_id").select("file", "value").write.partitionBy("file").text(root)
    return files.scan_text(spark, root).select(F.regexp_extract("path", r"file=(\d+)/", 1).cast("bigint").alias("file"), "n", F.md5("line").alias("line_md5"))


@query("focus_windows", with_views("code_files", body="""
WITH f AS (SELECT path, text, str_split(text, chr(10)) AS l, 1 + page_id % 40 AS focus, 1500 // 60 AS per FROM code_files),
 w AS (SELECT *, len(l) AS t, least(focus - 1, len(l) - 1) AS idx FROM f),
 e AS (SELECT *, least(t, greatest(0, idx - per // 2) + per) AS fin FROM w), s AS (SELECT *, greatest(0, fin - per) AS st FROM e)
SELECT path, length(text) > 1500 AS truncated, md5(CASE WHEN length(text) > 1500 THEN array_to_string(l[st + 1 : fin], chr(10)) ELSE text END) AS window_md5,
  CASE WHEN length(text) > 1500 THEN st ELSE 0 END AS lines_before, CASE WHEN length(text) > 1500 THEN t - fin ELSE 0 END AS lines_after FROM s"""))
def focus_windows(spark, sf):
    f = code_files(spark, sf).withColumn("focus_line", (1 + F.col("page_id") % 40).cast("int"))
    return mutation.focus_window(f, 1500).select("path", "truncated", F.md5("window").alias("window_md5"), "lines_before", "lines_after")


@query("search_replace_answers", with_views("order_events", body="""
SELECT seq, CASE WHEN n % 3 = 0 THEN 'x = <' || m || '>' || chr(10) || 'y = <' || m || '>' || chr(10) || 'done' ELSE
  'x = <' || (m + 1) || '>' || chr(10) || 'y = <' || m || '>' || chr(10) || CASE WHEN n % 3 = 1 THEN 'ended' ELSE 'done' END END AS after FROM order_events"""))
def search_replace_answers(spark, sf):
    e = order_events(spark, sf)
    tag = lambda c: F.concat(F.lit("<"), c.cast("string"), F.lit(">"))
    before = F.concat(F.lit("x = "), tag(F.col("m")), F.lit("\ny = "), tag(F.col("m")), F.lit("\ndone"))
    block = lambda s, r: F.concat(F.lit("<<<<<<< SEARCH\n"), s, F.lit("\n=======\n"), r, F.lit("\n>>>>>>> REPLACE\n"))
    reply = F.when(F.col("n") % 3 == 0, "no block here").otherwise(F.concat(
        block(tag(F.col("m")), tag(F.col("m") + 1)),
        F.when(F.col("n") % 3 == 1, block(F.lit("  done "), F.lit(" ended "))).otherwise(block(F.lit("absent"), F.lit("z")))))
    return e.select("seq", mutation.apply_search_replace(before, reply).alias("after"))


SWAPS_SQL = "[" + ", ".join(f"struct_pack(o := {q(n)}, a := {q(a)}, b := {q(b)})" for n, a, b in fv.OPERATOR_SWAPS) + "]"
sql_view("mutants", f"""
WITH s AS (SELECT path, n, line, coalesce(last_value(CASE WHEN d <> '' THEN d END IGNORE NULLS) OVER (PARTITION BY path ORDER BY n), '<module>') AS symbol
   FROM (SELECT *, regexp_extract(line, '^\\s*(?:def|class|function)\\s+(\\w+)', 1) AS d FROM code_lines)),
 h AS (SELECT *, unnest(list_filter({SWAPS_SQL}, lambda x: contains(line, x.a))) AS op FROM s WHERE NOT ltrim(line) LIKE '#%'),
 m AS (SELECT path, n, symbol, op.o AS operator, line AS original, left(line, instr(line, op.a) - 1) || op.b || substr(line, instr(line, op.a) + length(op.a)) AS mutated FROM h)
SELECT *, 'mut_' || substr(sha256(path || '|' || symbol || '|' || operator || '|' || n), 1, 12) AS bug_id FROM m WHERE original <> mutated""", ("code_lines",))


@query("line_mutants", with_views("mutants", body="SELECT path, n, symbol, operator, md5(mutated) AS mutated_md5, bug_id FROM mutants"))
def line_mutants(spark, sf):
    return mutation.mutants(file_lines(spark, sf)).select(
        "path", F.col("n").cast("bigint").alias("n"), "symbol", "operator", F.md5("mutated").alias("mutated_md5"), "bug_id")


@query("mutated_files", with_views("mutants", body="""
WITH one AS (SELECT * FROM mutants QUALIFY row_number() OVER (PARTITION BY path, n ORDER BY operator) = 1)
SELECT l.path, md5(string_agg(coalesce(o.mutated, l.line), chr(10) ORDER BY l.n)) AS text_md5, count(o.mutated) AS applied
FROM code_lines l LEFT JOIN one o ON o.path = l.path AND o.n = l.n GROUP BY l.path"""))
def mutated_files(spark, sf):
    code = file_lines(spark, sf)
    chosen = mutation.mutants(code).groupBy("path", "n").agg(F.min("operator").alias("operator"))
    return mutation.apply_mutants(code, chosen).select("path", F.md5("text").alias("text_md5"), "applied")


# ---------------------------------------------------------------- privacy


def documents(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text", "source", "lang")


@query("redacted_documents")
def redacted_documents(spark, sf):
    return privacy.redact(documents(spark, sf), ["text"]).select("doc_id", F.md5("text").alias("text_md5"), "replacements")


IP = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
ASSIGNED = dict(fv.SECRET_PATTERNS)["assigned_secret"]


@query("redaction_counts", f"""
SELECT doc_id, len(regexp_extract_all(text, {q(IP)})) AS ips, len(list_filter(regexp_extract_all(text, {q(EMAIL)}),
  lambda e: NOT regexp_matches(e, '@example[.](com|org)'))) AS emails, len(regexp_extract_all(text, {q(ASSIGNED)})) AS secrets FROM documents""")
def redaction_counts(spark, sf):
    """How often each stand-in occurs in the redacted text."""
    red = privacy.redact(documents(spark, sf), ["text"])
    count = lambda tag: F.regexp_count("text", F.lit(f"<{tag}:[0-9a-f]{{8}}>")).cast("bigint")
    return red.select("doc_id", count("IP").alias("ips"), count("EMAIL").alias("emails"), count("ASSIGNED_SECRET").alias("secrets"))


CONTEXT = ((r"the[\s_-]?the", "ACME"), ("and", "the operator"), ("ing", "NOUN"))


@query("anonymised_documents", """
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'the[\\s_-]?the', 'ACME', 'gi'), 'and', 'the operator', 'gi'), 'ing', 'NOUN', 'gi')) AS text_md5,
  CASE source WHEN 'src1' THEN 'project-a' WHEN 'src2' THEN 'project-b' ELSE 'project-x' END AS project, '' AS source_session FROM documents""")
def anonymised_documents(spark, sf):
    d = documents(spark, sf).withColumn("project", F.col("source")).withColumn("source_session", F.col("lang"))
    projects = d.select("project").distinct().select(
        "project", F.when(F.col("project") == "src1", "project-a").when(F.col("project") == "src2", "project-b").alias("alias"))
    return privacy.anonymise(d, ["text"], CONTEXT, projects, ["source_session"]).select(
        "doc_id", F.md5("text").alias("text_md5"), "project", "source_session")


def document_lines(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)


def _sweep_sql() -> str:
    """Every pattern of the public tier; the look-around of two of them is said by filters instead."""
    counts = {name: f"len(regexp_extract_all(line, {q(p)}))" for name, p in privacy.active_patterns("public")}
    counts["email"] = (f"len(list_filter(regexp_extract_all(line, {q(EMAIL)}), lambda e: NOT regexp_matches(e, '@example[.](com|org)')))")
    digits = r"(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}"
    counts["phone"] = f"len(regexp_extract_all(line, {q('(?:^|[^0-9])' + digits + '(?:$|[^0-9])')}))"
    union = " UNION ALL ".join(f"SELECT doc_id, n, {q(name)} AS pattern, {count} AS matches FROM l" for name, count in counts.items())
    return f"""
WITH l AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS n, unnest(t) AS line FROM (SELECT doc_id, str_split(text, chr(10)) AS t FROM documents)),
 f AS ({union})
SELECT doc_id, n, pattern, matches FROM f WHERE matches > 0"""


@query("sweep_findings", _sweep_sql())
def sweep_findings(spark, sf):
    found = privacy.findings(document_lines(spark, sf), keep=("doc_id", "n"))
    return found.select("doc_id", F.col("n").cast("bigint").alias("n"), "pattern", "matches")


@query("publish_gate", f"""
SELECT sum(len(regexp_extract_all(text, {q(ASSIGNED)})))::BIGINT AS findings, sum(len(regexp_extract_all(text, {q(ASSIGNED)}))) = 0 AS publishable FROM documents""")
def publish_gate(spark, sf):
    """Private tier over the whole corpus: credentials only."""
    return privacy.publish_verdict(privacy.findings(document_lines(spark, sf), "private", keep=("doc_id", "n")))


@query("publish_drift", """
SELECT count(*) FILTER (WHERE doc_id % 70 = 0) AS missing, count(*) FILTER (WHERE doc_id % 90 = 0) AS added, count(*) FILTER (WHERE doc_id % 70 <> 0 AND doc_id % 50 = 0) AS drifted,
  count(*) FILTER (WHERE doc_id % 70 = 0 OR doc_id % 90 = 0 OR doc_id % 50 = 0) = 0 AS same FROM documents""")
def publish_drift(spark, sf):
    d = documents(spark, sf)
    public = d.filter("doc_id % 70 <> 0").withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    extra = d.filter("doc_id % 90 = 0").withColumn("doc_id", -F.col("doc_id") - 1)
    return privacy.publish_drift(d, public.unionByName(extra), "doc_id", "text")

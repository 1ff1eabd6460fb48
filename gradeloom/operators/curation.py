"""From mined edits to curated tasks: gates, categories, relevance, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import fixed_values as fv
from gradeloom.functions.similarity import normalize_identifiers
from gradeloom.functions.text import (count_matches, extension, first_match, language_of, looks_like_code, matches, strip)
from gradeloom.operators.linediff import changed_lines, diff_counts
from gradeloom.operators.ordered import keep_first, top_per_group


def goal_relevance(goal: Column, code: Column, file_name: Column) -> Column:
    """0..1: half for symbols of the snippet named in the goal, half for describing a defect."""
    low_goal = F.lower(F.coalesce(goal, F.lit("")))
    source = F.lower(F.concat(F.coalesce(code, F.lit("")), F.lit("\n"), F.coalesce(file_name, F.lit(""))))
    tokens = F.array_except(F.regexp_extract_all(source, F.lit(fv.RELEVANCE_TOKEN), F.lit(0)),
                            F.array(*[F.lit(w) for w in fv.RELEVANCE_STOPWORDS]))
    hits = F.size(F.filter(tokens, lambda t: low_goal.contains(t)))
    score = F.least(F.lit(0.5), 0.25 * hits) + F.when(matches(low_goal, fv.RELEVANCE_DEFECT, True), 0.5).otherwise(0.0)
    return F.when(F.length(low_goal) == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), score), 2))


def extraction_gate(edits: DataFrame) -> DataFrame:
    """Edits worth keeping, with fix and feature hit counts. Cheap tests run before the regexes."""
    old, new = F.col("buggy"), F.col("fixed")
    kept = edits.filter(
        extension(F.col("path")).isin(*fv.CODE_EXTENSIONS) & (F.length(new) > 0)
        & F.length(old).between(fv.EXTRACT_MIN_CHARS, fv.EXTRACT_MAX_CHARS)
        & (strip(old) != strip(new)) & (looks_like_code(old) | looks_like_code(new)))
    blob = F.concat(F.coalesce("goal", F.lit("")), F.lit("\n"), old)
    return kept.withColumn("fix_signal", count_matches(blob, fv.EXTRACT_FIX, True)).withColumn(
        "feat_signal", count_matches(blob, fv.EXTRACT_FEATURE, True))


def path_traits(df: DataFrame, path: str = "path") -> DataFrame:
    p = F.col(path)
    return df.withColumn("lang", language_of(p)).withColumn("is_test", matches(p, fv.GATE_TEST_PATH, True)).withColumn(
        "is_code", p.contains(".") & extension(p).isin(*fv.CODE_EXTENSIONS))


def _with_diff(df: DataFrame, key: str) -> DataFrame:
    counts = diff_counts(changed_lines(df, key, "buggy", "fixed"), key)
    return df.join(counts, key, "left").fillna(0, ["n_changed", "n_substantive"]).fillna(0.0, ["strength"])


def task_gate(pairs: DataFrame, key: str = "ingest_seq") -> DataFrame:
    """All pairs with `skip_reason` (NULL = a task), language and flags. The first failing gate is the reason.

    The earliest of identical pairs stays; the others become "dupe". Duplicates
    are found by a partial aggregation and matched on the unique key.
    """
    df = path_traits(_with_diff(pairs, key))
    goal = strip(F.col("goal"))
    fits = lambda c: F.length(c).between(fv.GATE_MIN_LEN, fv.GATE_MAX_LEN)
    reason = (F.when(~fits(F.col("buggy")) | ~fits(F.col("fixed")), "len")
              .when((F.length(goal) > 0) & matches(goal, fv.GATE_GENERIC_GOAL, True), "generic_goal")
              .when(F.col("n_changed") < fv.GATE_MIN_CHANGED, "tiny_diff")
              .when(F.col("n_substantive") < 1, "non_logic_diff")
              .when(~F.col("lang").isin(*fv.GATE_LANGUAGES), "lang"))
    gated = df.withColumn("skip_reason", reason)
    firsts = (gated.filter("skip_reason IS NULL")
              .groupBy(F.sha2("buggy", 256), F.sha2("fixed", 256)).agg(F.min(key).alias(key))
              .select(key, F.lit(True).alias("_first")))
    return gated.join(firsts, key, "left").withColumn(
        "skip_reason", F.when(F.col("skip_reason").isNull() & F.col("_first").isNull(), "dupe")
        .otherwise(F.col("skip_reason"))).drop("_first").withColumn(
        "goal_had_alternatives", matches(goal, fv.GATE_ALTERNATIVES, True))


def behaviour_changed(before: Column, after: Column) -> Column:
    """Some logic-bearing token occurs a different number of times on the two sides."""
    test = F.lit(False)
    for pattern in dict.fromkeys(fv.BEHAVIOUR_TOKENS):
        test = test | (count_matches(before, pattern) != count_matches(after, pattern))
    return test


def episode_triage(episodes: DataFrame, key: str = "episode_id") -> DataFrame:
    """All episodes with `skip_reason` (NULL = a task), language and diff strength."""
    df = _with_diff(episodes, key).withColumn("language", language_of(F.col("path")))
    goal = strip(F.col("goal"))
    short = lambda c: F.length(c) < fv.TRIAGE_MIN_LEN
    long = lambda c: F.length(c) > fv.TRIAGE_MAX_LEN
    reason = (F.when(F.length(goal) < fv.TRIAGE_MIN_GOAL, "no_goal")
              .when(matches(goal, fv.TRIAGE_JUNK_GOAL, True) | matches(goal, fv.TRIAGE_GENERIC_GOAL, True), "junk_goal")
              .when(short(F.col("buggy")) | short(F.col("fixed")), "tiny")
              .when(long(F.col("buggy")) | long(F.col("fixed")), "huge")
              .when(F.col("strength") < fv.TRIAGE_MIN_STRENGTH, "weak_diff")
              .when(F.col("language").isin(*fv.TRIAGE_CONFIG_LANGUAGES), "config")
              .when(~(behaviour_changed(F.col("buggy"), F.col("fixed"))
                      | (F.col("strength") > fv.TRIAGE_WEAK_STRENGTH)), "weak_diff"))
    return df.withColumn("skip_reason", reason)


def reason_counts(df: DataFrame, reason: str = "skip_reason") -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "reason")


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def _line_signals(changes: DataFrame, key: str) -> DataFrame:
    """Per pair: what its changed lines consist of."""
    t = strip(F.col("text"))
    added = F.col("sign") == "+"
    q2 = lambda ch: F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit(""))) >= 2
    quotes = sum(F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit(""))) for ch in "\"'`")
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    outside = F.regexp_replace(t, r"""(['"]).*?\1""", "")
    prose = ((F.length(t) == 0) | ((quotes >= 2) & (letters >= 3)
             & ~matches(outside, fv.CALL_ADDED) & ~matches(outside, fv.BRANCH_ADDED)))
    bare = matches(t, fv.BARE_LITERAL_LINE) & (q2('"') | q2("'"))
    comment = t.startswith("#") | t.startswith("//") | t.startswith("*")
    logic = added & (F.length(t) > 0) & ~comment & ~bare
    return changes.groupBy(key).agg(
        F.bool_and(prose).alias("prose_only"), F.count_if(added).alias("added"), F.count_if(logic).alias("logic"),
        F.count_if(logic & matches(F.col("text"), fv.DEFENCE_ADDED, True)).alias("defensive"),
        F.count_if(added & matches(F.col("text"), fv.BRANCH_ADDED)).alias("branches"),
        F.count_if(logic & ~matches(t, fv.OPTION_LINE)).alias("not_option"),
        F.count_if(logic & ~matches(t, fv.CALL_ADDED)).alias("not_call"))


def categorize(tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """Add category, category_confidence, category_reason, classifier. A label already there is kept."""
    df = tasks.join(_line_signals(changed_lines(tasks, key), key), key, "left")
    buggy, fixed, goal = F.col("buggy"), F.col("reference_fix"), F.coalesce("goal", F.lit(""))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    defect, feature = matches(goal, fv.CURATION_DEFECT, True), matches(goal, fv.CURATION_FEATURE, True)
    score = F.least(n("defensive"), F.lit(3)) + F.least(n("branches"), F.lit(2)) + F.when(defect, 2).otherwise(0)
    renamed = normalize_identifiers(buggy) == normalize_identifiers(fixed)
    config = matches(F.coalesce("file_name", F.lit("")), fv.CONFIG_SUFFIX, True)
    rules = (
        ((F.length(strip(buggy)) == 0) | (F.length(strip(fixed)) == 0), "ambiguous", F.lit(0.2), "empty snippet"),
        (strip(buggy) == strip(fixed), "ambiguous", F.lit(0.9), "no change"),
        (F.coalesce("prose_only", F.lit(False)), "documentation", F.lit(0.85),
         "every changed line is string-literal text"),
        (renamed, "refactor", F.when(matches(goal, fv.CURATION_RENAME, True), 0.9).otherwise(0.75),
         "token stream identical after identifier normalisation"),
        ((score >= 3) & (n("defensive") >= 1), "bug_fix", F.round(F.least(F.lit(0.95), 0.55 + 0.1 * score), 2),
         "defensive or branching logic added"),
        (defect & (n("branches") >= 1) & (n("logic") > 0), "bug_fix", F.lit(0.62),
         "goal describes a defect and the fix adds a control-flow branch"),
        (config, "configuration", F.lit(0.7), "config file"),
        ((n("logic") > 0) & (n("branches") == 0) & (n("defensive") == 0) & (n("not_option") == 0),
         "feature_addition", F.lit(0.72), "fix only adds option or argument lines"),
        (feature & ~defect & (n("added") > 0) & (n("not_call") == 0), "feature_addition", F.lit(0.7),
         "fix only adds new call arguments"),
        (feature & ~defect, "feature_addition", F.lit(0.6), "goal describes new capability, not a defect"),
        (n("logic") == 0, "refactor", F.lit(0.6), "no logic lines changed"),
        (F.lit(True), "ambiguous", F.lit(0.3), "signals conflict"),
    )

    def cascade(pick):
        chain = None
        for rule in rules:
            chain = F.when(rule[0], pick(rule)) if chain is None else chain.when(rule[0], pick(rule))
        return chain

    found = F.struct(cascade(lambda r: F.lit(r[1])).alias("category"),
                     cascade(lambda r: r[2]).alias("category_confidence"),
                     cascade(lambda r: F.lit(r[3])).alias("category_reason"),
                     F.lit("heuristic").alias("classifier"))
    has = lambda c: c in tasks.columns
    labelled = F.lit(False)
    if has("category"):
        labelled = F.length(F.coalesce("category", F.lit(""))).__gt__(0) & (F.col("category") != "unclassified")
    picked = df.withColumn("_found", found)
    out = [F.when(labelled, F.col(c)).otherwise(F.col(f"_found.{c}")).alias(c) if has(c) else F.col(f"_found.{c}").alias(c)
           for c in ("category", "category_confidence", "category_reason", "classifier")]
    return picked.select(*[c for c in tasks.columns if c not in (
        "category", "category_confidence", "category_reason", "classifier")], *out)


def inferred_defect(added_text: Column) -> Column:
    """Defect category of the lines a fix adds; the first pattern found decides."""
    return first_match(F.coalesce(added_text, F.lit("")), [("(?U)" + p, v) for p, v in fv.ADDED_LINE_CATEGORIES], F.lit("other"))


def fingerprint(df: DataFrame, *columns: str, out: str = "fingerprint") -> DataFrame:
    """sha256 of the identifier-normalised texts."""
    return df.withColumn(out, F.sha2(F.concat_ws("||", *[normalize_identifiers(F.col(c)) for c in columns]), 256))


def dedupe_tasks(tasks: DataFrame, columns=("buggy", "reference_fix"), order: str = "ingest_seq") -> DataFrame:
    """Drop tasks that differ from an earlier one only in identifier names."""
    return keep_first(fingerprint(tasks, *columns), ["fingerprint"], order)


def cap_per_file(tasks: DataFrame, per_file: int = 2) -> DataFrame:
    """At most `per_file` tasks per file: goals with alternatives first, then confidence."""
    return top_per_group(tasks, ["file_name"], [F.desc("goal_had_alternatives"), F.desc("category_confidence"), "ingest_seq"], per_file)


def cap_final(tasks: DataFrame, per_file: int = 3) -> DataFrame:
    """The final cap: goals without alternatives first, then relevance."""
    return top_per_group(tasks, ["file_name"], [F.asc("goal_had_alternatives"), F.desc("goal_relevance"), "ingest_seq"], per_file)


def primary_tasks(tasks: DataFrame, min_relevance: float = fv.MIN_GOAL_RELEVANCE) -> DataFrame:
    return tasks.filter((F.col("category") == "bug_fix")
                        & ((F.col("goal_source") == "synth") | (F.col("goal_relevance") >= min_relevance)))


def merge_synthesized_goals(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """Bug fixes with an answer (task_id, summary, defect, trigger) get the composed goal; the old one is kept aside."""
    joined = tasks.join(answers.select("task_id", "summary", "defect", "trigger"), "task_id", "left")
    filled = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    ok = (F.col("category") == "bug_fix") & filled("summary") & filled("defect")
    text = F.concat(F.trim("summary"), F.lit(" Defect: "), F.trim("defect"),
                    F.when(filled("trigger"), F.concat(F.lit(" Trigger: "), F.trim("trigger"))).otherwise(""))
    return joined.select(
        *[c for c in tasks.columns if c not in ("goal", "goal_source", "original_goal")],
        F.when(ok, text).otherwise(F.col("goal")).alias("goal"),
        F.when(ok, "synth").otherwise("user").alias("goal_source"),
        F.when(ok, F.col("goal")).otherwise("").alias("original_goal"))

"""Mining sessions: goals for edits, episodes, hard sessions, candidate messages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import fixed_values as fv
from gradeloom.functions.text import contains_any, count_contained, count_matches, lines, matches, occurrences, squash
from gradeloom.operators.ordered import TIME_BUCKET, asof_backward, top_per_group


def attach_goals(edits: DataFrame, messages: DataFrame, width: int = TIME_BUCKET) -> DataFrame:
    """Each edit gets the nearest preceding user message of its session as goal and goal_ts; none gives '' and 0."""
    user = messages.filter((F.col("role") == "user") & (F.length("text") > 0)).select(
        "session_id", F.col("ts").alias("goal_ts"), F.col("text").alias("goal"))
    found = asof_backward(edits, user, ["session_id"], "ts", "goal_ts", ["goal"], width=width)
    return found.withColumn("goal", F.coalesce("goal", F.lit(""))).withColumn("goal_ts", F.coalesce("goal_ts", F.lit(0).cast("bigint")))


def with_session_info(df: DataFrame, sessions: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Left join of session title and directory, and the project's worktree or id."""
    out = df.join(sessions, "session_id", "left")
    if projects is not None:
        p = projects.select(F.col("id").alias("project_id"), "worktree")
        out = out.join(p, "project_id", "left").withColumn(
            "project", F.coalesce("worktree", F.col("project_id").cast("string"), F.lit("")))
    return out


def episodes(pairs: DataFrame) -> DataFrame:
    """Edits grouped by (session, goal, file): first before, last after, strongest signals. No-change groups drop."""
    keys = ["session_id", "goal_ts", "path"]
    at = F.struct("ts", "ingest_seq")
    grouped = pairs.groupBy(*keys).agg(
        F.min_by("goal", at).alias("goal"), F.min_by("buggy", at).alias("buggy"), F.max_by("fixed", at).alias("fixed"),
        F.count(F.lit(1)).alias("n_edits"), F.max("fix_signal").alias("fix_signal"),
        F.max("feat_signal").alias("feat_signal"), F.min("ts").alias("ts"))
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return grouped.filter(F.trim("buggy") != F.trim("fixed")).withColumn(
        "episode_id", F.concat(F.lit("EP"), F.substring(F.sha2(key, 256), 1, 12)))


def episode_edits(pairs: DataFrame) -> DataFrame:
    """The edits behind the episodes, one row each: a long episode stays rows, not one array."""
    return pairs.select("session_id", "goal_ts", "path", "ts", "ingest_seq", "buggy", "fixed")


_WORDS = sorted({w for words in fv.STRUGGLE_CATEGORIES.values() for w in words})


def _word_bits(text: Column) -> Column:
    """One bit per category word that occurs in the text."""
    bits = F.lit(0).cast("bigint")
    for i, word in enumerate(_WORDS):
        bits = bits + F.when(text.contains(word), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    return bits


def _tags_of(bits: Column) -> Column:
    named = []
    for name, words in fv.STRUGGLE_CATEGORIES.items():
        mask = sum(1 << _WORDS.index(w) for w in words)
        named.append(F.when(F.bit_count(bits.bitwiseAND(F.lit(mask))) >= 2, F.lit(name)))
    return F.array_compact(F.array(*named))


def keyword_tags(text: Column) -> Column:
    """Categories with at least two of their words in the text."""
    return _tags_of(_word_bits(F.lower(F.coalesce(text, F.lit("")))))


def hard_sessions(parts: DataFrame, sessions: DataFrame, min_turns: int = fv.MINE_MIN_TURNS,
                  min_struggle: int = fv.MINE_MIN_STRUGGLE, min_edits: int = fv.MINE_MIN_EDITS,
                  tag_texts: int | None = None, roots: Iterable[str] | None = None) -> DataFrame:
    """Sessions that struggled and landed an edit, hardest first.

    `parts` are all parts (`part_events(finished=False)`, as failed calls are
    struggle too) with part_type, tool, path, old, new, command, text, ts, seq.
    With `roots`, a call on a path outside them counts as a turn only. Every measure is a map-side aggregate; the largest edit is a
    `max_by`, the tags a bitwise OR over all texts, or over the first
    `tag_texts` of each session where that is given.
    """
    is_text, is_tool = F.col("part_type") == "text", F.col("part_type") == "tool"
    if roots is not None:
        under = F.lit(False)
        for root in roots:
            under = under | F.col("path").startswith(root.rstrip("/") + "/")
        is_tool = is_tool & (under | (F.length(F.coalesce("path", F.lit(""))) == 0))
    is_edit = is_tool & F.col("tool").isin("edit", "write", "multiedit", "patch")
    plain = squash(F.col("text"))
    at = F.struct("ts", "seq")
    said = is_text & (F.length(plain) > 0)
    size_of = lambda c: F.when(F.length(F.coalesce(c, F.lit(""))) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(c, r"\n$", ""), "\n", -1)))
    size = F.greatest(size_of(F.col("old")), size_of(F.col("new")))
    stuck = (F.when(said, count_contained(F.lower(plain), fv.STRUGGLE_MARKERS)).otherwise(0)
             + F.when(is_tool & (F.col("tool") == "bash") & matches(F.col("command"), fv.STRUGGLE_COMMAND), 1).otherwise(0))
    fix = F.struct(F.col("path").alias("fix_file"), size.alias("fix_changed_lines"), F.col("ts").alias("fix_time"),
                   (F.length(F.coalesce("old", F.lit(""))) > 0).alias("has_old"))
    per = parts.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(is_tool).alias("tool_calls"), F.count_if(is_edit).alias("edits"),
        F.sum(stuck).alias("struggle_hits"), F.min_by(F.when(said, plain), F.when(said, at)).alias("symptom"),
        F.max_by(F.when(is_edit, fix), F.when(is_edit, F.struct(size, -F.col("ts"), -F.col("seq")))).alias("fix"))
    first_texts = parts.filter(said).select("session_id", "ts", "seq", F.lower("text").alias("low"))
    if tag_texts is not None:
        first_texts = top_per_group(first_texts, ["session_id"], ["ts", "seq"], tag_texts)
    bits = first_texts.groupBy("session_id").agg(F.bit_or(_word_bits(F.col("low"))).alias("bits"))
    hard = per.filter((F.col("turns") >= min_turns) & (F.col("struggle_hits") >= min_struggle)
                      & (F.col("edits") >= min_edits) & (F.length("fix.fix_file") > 0))
    joined = hard.join(bits, "session_id", "left").join(sessions.select("session_id", "title"), "session_id", "left")
    all_bits = F.coalesce("bits", F.lit(0).cast("bigint")).bitwiseOR(_word_bits(F.lower(F.coalesce("title", F.lit("")))))
    calls = F.when(F.col("tool_calls") > 0, F.col("tool_calls")).otherwise(F.greatest("turns", F.lit(1)))
    return joined.select(
        "session_id", "title", "turns", "tool_calls", "edits", "struggle_hits",
        F.round(F.least(F.lit(1.0), F.col("struggle_hits") / calls), 3).alias("struggle_ratio"),
        "fix.fix_file", F.when(F.col("fix.has_old"), F.col("fix.fix_changed_lines")).otherwise(0).cast("bigint").alias("fix_changed_lines"),
        "fix.fix_time", _tags_of(all_bits).alias("categories"), "symptom").orderBy(F.desc("struggle_hits"), F.desc("edits"), "session_id")


def candidate_messages(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Messages with pasted code, scored by code lines, fences, defect and alternative words; all, best first, or the best `limit`."""
    text = F.col("text")
    codey = F.size(F.filter(lines(text), lambda l: l.rlike("(?U)" + fv.CANDIDATE_CODE_LINE))).cast("bigint")
    scored = messages.withColumn("code_lines", codey).withColumn("fenced", occurrences(text, "```")).filter(
        (F.col("code_lines") >= 3) | (F.col("fenced") >= 2)).withColumn(
        "bugs", count_matches(text, fv.CANDIDATE_DEFECT, True)).withColumn(
        "alts", count_matches(text, fv.CANDIDATE_ALTERNATIVE, True))
    score = (F.least(F.col("code_lines"), F.lit(12)) * 2 + F.col("fenced") * 4 + F.least(F.col("bugs"), F.lit(6))
             + F.least(F.col("alts"), F.lit(4)))
    ranked = scored.withColumn("score", score.cast("bigint")).orderBy(F.desc("score"), "session_id", "ts")
    return ranked if limit is None else ranked.limit(limit)


def code_messages(messages: DataFrame) -> DataFrame:
    """User messages carrying any code hint."""
    return messages.filter((F.col("role") == "user") & contains_any(F.coalesce("text", F.lit("")), fv.CODE_HINTS))


def edited_files(events: DataFrame, pattern: str = "%") -> DataFrame:
    """Edit and write counts per path matching a LIKE pattern."""
    return events.filter(F.col("path").like(pattern)).groupBy("path").agg(
        F.count_if(F.col("tool") == "edit").alias("edits"), F.count_if(F.col("tool") == "write").alias("writes"))

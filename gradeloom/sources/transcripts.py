"""Transcript parts: JSON tool calls to typed events, snapshots and edits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import fixed_values as fv
from gradeloom.functions.text import contains_any
from gradeloom.schemas import TOOL_PART


def part_events(parts: DataFrame, tools: Iterable[str] | None = None, paths_only: bool = False,
                finished: bool = True) -> DataFrame:
    """session_id, ts, seq, part_type, tool, status, path, content, old, new, output, command, text.

    The plain substring filter comes first, so rows without a path are never
    parsed when `paths_only`; the schema names only the fields that are read.
    Unparsable parts and unfinished tool calls drop, unless `finished` is
    False: then every part is a row, an unparsable one without a part_type.
    """
    raw = parts.filter(F.col("data").contains('"filePath"')) if paths_only else parts
    parsed = raw.select("session_id", F.col("time_created").alias("ts"), F.col("id").alias("seq"),
                        F.from_json("data", TOOL_PART).alias("p"))
    status = F.col("p.state.status")
    if finished:
        parsed = parsed.filter("p.type IS NOT NULL").filter((F.col("p.type") != "tool") | status.isNull() | (status == "completed"))
    events = parsed.select(
        "session_id", "ts", "seq", F.col("p.type").alias("part_type"), F.col("p.tool").alias("tool"), status.alias("status"),
        F.coalesce("p.state.input.filePath", "p.state.input.path").alias("path"), F.col("p.state.input.content").alias("content"),
        F.coalesce("p.state.input.oldString", "p.state.input.oldText").alias("old"),
        F.coalesce("p.state.input.newString", "p.state.input.newText").alias("new"),
        F.col("p.state.output").alias("output"), F.col("p.state.input.command").alias("command"), F.col("p.text").alias("text"))
    return events if tools is None else events.filter((F.col("part_type") == "tool") & F.col("tool").isin(*tools))


def read_body(output: Column, policy: str = "reject") -> Column:
    """File text inside a read payload, line-number prefixes removed; NULL when it is not the whole file.

    policy "reject": any capped or paginated payload is refused.
    policy "window": the footer must name lines 1..total.
    """
    body = F.regexp_extract(output, r"(?s)<content>\n?(.*?)\n</content>", 1)
    has_body = output.rlike(r"(?s)<content>\n?.*?\n</content>")
    bare = F.regexp_replace(body, r"(?m)^\d+: ?", "")
    if policy == "reject":
        whole = has_body & ~output.rlike(fv.CAPPED_READ)
        return F.when(whole, F.when(F.length(bare) > 0, bare).otherwise(body))
    footer = r"\(Showing lines (\d+)-(\d+) of (\d+)\.[^)]*\)"
    first, last, total = (F.regexp_extract(body, footer, i) for i in (1, 2, 3))
    clean = F.regexp_replace(bare, r"\n*" + footer + r"\s*\z", "")
    whole = (has_body & ~contains_any(output, fv.PARTIAL_READ_MARKERS) & body.rlike(r"\A\s*1: ?")
             & (first == "1") & (last == total) & (F.length(total) > 0))
    return F.when(whole & (F.length(clean) > 0), clean)


def forbidden(path: Column) -> Column:
    return contains_any(F.lower(F.coalesce(path, F.lit(""))), fv.FORBIDDEN_PATHS)


def snapshots(events: DataFrame, roots: Iterable[str] | None = None, min_lines: int = fv.SNAPSHOT_MIN_LINES,
              max_chars: int = fv.SNAPSHOT_MAX_BYTES, policy: str = "reject", check_ending: bool = True) -> DataFrame:
    """Complete file bodies seen by read or write calls: file_path, time, source, content, session_id, seq."""
    e = events.filter((F.col("part_type") == "tool") & F.col("tool").isin("read", "write") & (F.length("path") > 0)
                      & ~forbidden(F.col("path")))
    if roots is not None:
        under = F.lit(False)
        for root in roots:
            under = under | F.col("path").startswith(root.rstrip("/") + "/")
        e = e.filter(under)
    content = F.when(F.col("tool") == "read", read_body(F.col("output"), policy)).otherwise(F.col("content"))
    out = e.select(F.col("path").alias("file_path"), F.col("ts").alias("time"), F.col("tool").alias("source"),
                   content.alias("content"), "session_id", "seq").filter(F.length(F.trim("content")) > 0)
    out = out.filter((F.length("content") <= max_chars) & (F.size(F.split("content", "\n", -1)) >= min_lines))
    if check_ending:
        tail = F.substring(F.regexp_replace("content", r"\s+\z", ""), -1, 1)
        out = out.filter(tail.isin(*fv.SNAPSHOT_ENDINGS))
    return out


def edits(events: DataFrame) -> DataFrame:
    """Recorded replacements: file_path, time, seq, session_id, old, new."""
    return events.filter((F.col("tool") == "edit") & (F.length("old") > 0) & F.col("new").isNotNull()).select(
        F.col("path").alias("file_path"), F.col("ts").alias("time"), "seq", "session_id", "old", "new")

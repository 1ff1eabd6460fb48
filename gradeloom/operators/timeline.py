"""File histories: replay of recorded edits, forwards from anchors and backwards from a final text.

Replaying is sequential within one chain of edits, so a chain is one sorted run
of rows that streams through a task: rows are partitioned by chain, sorted by
Spark (spilling as needed) and folded batch by batch. Only the current text is
held. Anchors cut a file's history into independent chains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from gradeloom import fixed_values as fv
from gradeloom.functions.text import strip
from gradeloom.operators.ordered import TIME_BUCKET, asof_backward, top_per_group


def swap_once(text: str, old: str, new: str) -> str | None:
    """Replace `old` when it occurs exactly once, else None."""
    return text.replace(old, new, 1) if old and text.count(old) == 1 else None


_CHAIN = ["file_path", "anchor_time", "anchor_seq"]


def _chains(events: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """Events labelled with the newest anchor at or before them, and one row per anchor that opens its chain.

    Only the anchor's label travels through the as-of join; its text enters once,
    as a row. Events without an anchor are dropped.
    """
    label = anchors.select("file_path", F.col("time").alias("anchor_time"), F.col("seq").alias("anchor_seq"))
    placed = asof_backward(events, label, ["file_path"], "time", "anchor_time", ["anchor_seq"], "anchor_seq", width)
    opening = anchors.select(
        "file_path", F.col("time").cast("bigint").alias("time"), F.lit(0).cast("bigint").alias("seq"), F.lit(-1).alias("kind"),
        F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("old"), F.col("content").alias("new"),
        F.col("time").cast("bigint").alias("anchor_time"), F.col("seq").cast("bigint").alias("anchor_seq"))
    return placed.filter("anchor_seq IS NOT NULL").withColumn("anchor_seq", F.col("anchor_seq").cast("bigint")).unionByName(opening)


_REPLAYED = ("file_path string, time bigint, seq bigint, kind int, session_id string, before string, after string, "
             "degraded boolean")


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    text = base = when = None
    degraded = base_degraded = False
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.kind == -1:
                text, degraded, when = r.new, False, None
                continue
            if r.time != when:
                # edits recorded at one moment do not see each other
                base, base_degraded, when = text, degraded, r.time
            if r.kind == 1:
                out.append((r.file_path, r.time, r.seq, 1, r.session_id, None, text, degraded))
                continue
            after = swap_once(base, r.old, r.new)
            if after is not None:
                out.append((r.file_path, r.time, r.seq, 0, r.session_id, base, after, base_degraded))
            moved = swap_once(text, r.old, r.new)
            if moved is None:
                degraded = True
            else:
                text = moved
        yield pd.DataFrame(out, columns=["file_path", "time", "seq", "kind", "session_id", "before", "after", "degraded"])


def _replay(events: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    chains = _chains(events, anchors, width)
    return (chains.repartition(*_CHAIN).sortWithinPartitions(*_CHAIN, F.col("kind") >= 0, "time", "kind", "seq")
            .mapInPandas(_fold, _REPLAYED))


def _as_events(edits: DataFrame) -> DataFrame:
    return edits.select("file_path", F.col("time").cast("bigint").alias("time"), F.col("seq").cast("bigint").alias("seq"),
                        F.lit(0).alias("kind"), "session_id", "old", "new")


def replay_states(edits: DataFrame, anchors: DataFrame, width: int = TIME_BUCKET) -> DataFrame:
    """The text on either side of each edit that applies: file_path, time, seq, session_id, before, after, degraded.

    An edit applies only where its old text occurs exactly once; one that does
    not is skipped and every later state of the chain is flagged degraded.
    """
    return _replay(_as_events(edits), anchors, width).drop("kind")


def content_at(edits: DataFrame, anchors: DataFrame, moments: DataFrame, width: int = TIME_BUCKET) -> DataFrame:
    """The text at each (file_path, time) of `moments`, edits at that time included; NULL without an anchor."""
    probes = moments.select("file_path", F.col("time").cast("bigint").alias("time")).distinct().select(
        "*", F.lit(0).cast("bigint").alias("seq"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("session_id"),
        F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    found = _replay(_as_events(edits).unionByName(probes), anchors, width).filter("kind = 1").select(
        "file_path", "time", F.col("after").alias("content"), "degraded")
    return moments.join(found, ["file_path", "time"], "left")


def _unwind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    path = text = None
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.final:
                path, text = r.file_path, r.new
                continue
            if r.file_path != path:
                path, text = r.file_path, None
            if text is None:
                reason = "no final text"
            elif not r.new:
                reason = "empty text"
            else:
                count = text.count(r.new)
                reason = "" if count == 1 else f"matched {count} times"
                text = text.replace(r.new, r.old, 1) if count == 1 else text
            out.append((r.file_path, r.time, r.seq, reason == "", reason, text if reason == "" else None))
        yield pd.DataFrame(out, columns=["file_path", "time", "seq", "applied", "reason", "recovered"])


def reverse_replay(edits: DataFrame, finals: DataFrame) -> DataFrame:
    """Walk each file's edits from newest to oldest, turning new text back into old.

    One row per edit: applied, reason, and the text recovered before the edit.
    The final text is one more row, at the head of its file.
    """
    steps = edits.select("file_path", F.col("time").cast("bigint").alias("time"), F.col("seq").cast("bigint").alias("seq"), "old", "new",
                         F.lit(False).alias("final"))
    heads = finals.select("file_path", F.lit(None).cast("bigint").alias("time"), F.lit(None).cast("bigint").alias("seq"),
                          F.lit(None).cast("string").alias("old"), F.col("final_text").alias("new"), F.lit(True).alias("final"))
    return (steps.unionByName(heads).repartition("file_path")
            .sortWithinPartitions("file_path", F.desc("final"), F.desc("time"), F.desc("seq"))
            .mapInPandas(_unwind, "file_path string, time bigint, seq bigint, applied boolean, reason string, recovered string"))


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    path = digest = None
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.file_path != path:
                if digest is not None:
                    out.append((path, digest.hexdigest()))
                path, digest = r.file_path, hashlib.sha256()
                digest.update(f"{r.time}:{r.seq}".encode())
            else:
                digest.update(f"|{r.time}:{r.seq}".encode())
        yield pd.DataFrame(out, columns=["file_path", "order_digest"])
    if digest is not None:
        yield pd.DataFrame([(path, digest.hexdigest())], columns=["file_path", "order_digest"])


def order_digest(edits: DataFrame) -> DataFrame:
    """sha256 over `time:seq` of a file's edits in order, streamed without gathering them."""
    return (edits.select("file_path", "time", "seq").repartition("file_path")
            .sortWithinPartitions("file_path", "time", "seq")
            .mapInPandas(_digest, "file_path string, order_digest string"))


def replay_verdicts(steps: DataFrame) -> DataFrame:
    """Per file: ok only when every edit was undone; any miss quarantines the file."""
    return steps.groupBy("file_path").agg(
        F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("skipped")).withColumn(
        "ok", (F.col("skipped") == 0) & (F.col("applied") > 0)).withColumn(
        "reason", F.when(F.col("ok"), "").otherwise(
            F.concat(F.col("skipped").cast("string"), F.lit(" hunk(s) did not apply exactly once"))))


def quarantine_report(verdicts: DataFrame) -> DataFrame:
    """One row per reason (empty = admissible) with the number of files."""
    return verdicts.groupBy("ok", "reason").agg(F.count(F.lit(1)).alias("files"),
                                                F.sum("applied").alias("applied"), F.sum("skipped").alias("skipped"))


def snapshot_pairs(snapshots: DataFrame, current: DataFrame | None = None,
                   keep: int | None = None) -> DataFrame:
    """(before, after) pair per file from its snapshots, or from the last `keep` of them.

    With `current` (file_path, content): the newest snapshot equal to the
    current text, paired with the one before it. Otherwise, or when only the
    oldest one matches, the last two. Equal pairs are dropped.
    """
    newest = [F.desc("time"), F.desc("session_id"), F.desc("seq")]
    if keep is None:
        recent = snapshots.withColumn("back", F.row_number().over(W.partitionBy("file_path").orderBy(*newest)))
    else:
        recent = top_per_group(snapshots, ["file_path"], newest, keep, "back")
    if current is not None:
        now = current.select("file_path", F.sha2(strip(F.col("content")), 256).alias("_now"))
        recent = recent.join(now, "file_path", "left").withColumn(
            "anchored", F.coalesce(F.sha2(strip(F.col("content")), 256) == F.col("_now"), F.lit(False))).drop("_now")
    else:
        recent = recent.withColumn("anchored", F.lit(False))
    order = W.partitionBy("file_path").orderBy(F.desc("back"))
    state = F.struct("time", "content", "back")
    paired = recent.withColumn("before", F.lag(state).over(order)).withColumn("after", state).filter("before IS NOT NULL")
    # anchored pairs first, then the newest
    best = paired.groupBy("file_path").agg(
        F.min_by(F.struct("before", "after", "anchored"), F.struct((~F.col("anchored")).cast("int"), "back")).alias("p"))
    b, a = F.col("p.before.content"), F.col("p.after.content")
    count_lines = lambda c: F.size(F.split(c, "\n", -1))
    return best.filter(strip(b) != strip(a)).select(
        "file_path", F.col("p.anchored").alias("anchored"), F.col("p.before.time").alias("before_time"),
        F.col("p.after.time").alias("after_time"), b.alias("before"), a.alias("after"),
        (count_lines(a) - count_lines(b)).cast("bigint").alias("gap_lines"))


def pair_report(snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """files, files with several snapshots, pairs, anchored pairs: one row."""
    per_file = snapshots.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    found = pairs.groupBy("file_path").agg(F.count(F.lit(1)).alias("p"), F.count_if("anchored").alias("a"))
    return per_file.join(found, "file_path", "left").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("n") > 1).alias("multi_snapshot"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("a"), F.lit(0)).alias("anchored"))


def fix_test_candidates(source_states: DataFrame, test_states: DataFrame, window: int = fv.ORACLE_WINDOW_MS,
                        min_size: int = fv.MIN_DEFECT_SIZE, width: int = TIME_BUCKET) -> DataFrame:
    """Test edits that grew, each with the newest source edit at most `window` before it.

    Both sides carry `test_path` (the source's conventional test file). The fix
    must change at least `min_size` characters. Strongest first: gap, then size.
    """
    grew = test_states.withColumn("grew", F.length("after") - F.length("before")).filter("grew > 0").select(
        "test_path", F.col("time").alias("test_time"), "grew")
    fixes = source_states.select(
        "test_path", F.col("time").alias("fix_time"), "file_path", "seq",
        F.abs(F.length("after") - F.length("before")).alias("fix_size"))
    matched = asof_backward(grew, fixes, ["test_path"], "test_time", "fix_time", ["file_path", "fix_size", "seq"], "seq", width)
    gap = F.col("test_time") - F.col("fix_time")
    return matched.withColumn("gap", gap).filter(
        F.col("fix_time").isNotNull() & (F.col("gap") <= window) & (F.col("fix_size") >= min_size)).select(
        "test_path", "file_path", "fix_time", "test_time", "gap", "fix_size", "grew").orderBy("gap", F.desc("fix_size"), "test_path")

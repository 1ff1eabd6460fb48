"""Message frames to answers: stateless parsing, and per-request assembly as stream and as batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradeloom import fixed_values as fv
from gradeloom.operators.ordered import previous_value
from gradeloom.schemas import FRAME


def is_progress_phrase(text: Column) -> Column:
    """A transient interface phrase that must not become an answer."""
    plain = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), "[.…]+$", ""))
    return plain.isin(*fv.EARLY_PROGRESS_PHRASES)


def parse_frames(payloads: DataFrame) -> DataFrame:
    """Frames of each payload that concern its own request.

    `payloads`: request_id, seq, ts, payload. Bad JSON drops. A frame naming
    request ids is kept only when the payload's own is among them.
    """
    pieces = payloads.select("request_id", "seq", "ts", F.posexplode(F.split("payload", fv.FRAME_SEPARATOR, -1)).alias("pos", "piece"))
    frames = pieces.filter(F.length(F.trim("piece")) > 0).select(
        "request_id", "seq", "ts", "pos", F.from_json("piece", FRAME).alias("frame")).filter("frame.type IS NOT NULL")
    arguments = F.coalesce("frame.arguments", F.array().cast(FRAME["arguments"].dataType))
    claimed = F.filter(F.flatten(F.array(
        F.array(F.col("frame.requestId"), F.col("frame.item.requestId")),
        F.transform(arguments, lambda a: a.getField("requestId")),
        F.flatten(F.transform(arguments, lambda a: F.transform(
            F.coalesce(a.getField("messages"), F.array().cast(FRAME["arguments"].dataType.elementType["messages"].dataType)),
            lambda m: m.getField("requestId")))))), lambda r: F.length(r) > 0)
    return frames.withColumn("_ids", claimed).filter(
        (F.size("_ids") == 0) | F.array_contains("_ids", F.col("request_id"))).drop("_ids")


def _spoken(messages: Column) -> Column:
    """Messages that are neither the user's nor early progress."""
    return F.filter(messages, lambda m: m.isNotNull() & (F.coalesce(m.getField("author"), F.lit("")) != "user")
                    & (F.coalesce(m.getField("contentType"), F.lit("")) != "EarlyProgress"))


def _last_answer(messages: Column) -> Column:
    kept = F.filter(_spoken(messages), lambda m: (F.length(m.getField("text")) > 0) & ~is_progress_phrase(m.getField("text"))
                    & ~F.lower(F.trim(F.coalesce(m.getField("messageType"), F.lit("")))).isin(*fv.NON_ANSWER_TYPES))
    return F.try_element_at(kept, F.lit(-1)).getField("text")


def frame_texts(frames: DataFrame) -> DataFrame:
    """Per frame: text ('' = none), is_final, stop ('final', 'invalid_request', 'binding_failure', 'disengaged' or NULL)."""
    f = F.col("frame")
    kind = F.col("frame.type")
    update = (kind == 1) & (F.col("frame.target") == "update")

    def step(text, a):
        write = F.coalesce(a.getField("writeAtCursor"), F.lit(""))
        grown = F.concat(text, F.when(is_progress_phrase(write), "").otherwise(write))
        return F.coalesce(_last_answer(a.getField("messages")), grown)

    arguments = F.coalesce("frame.arguments", F.array().cast(FRAME["arguments"].dataType))
    update_text = F.aggregate(arguments, F.lit(""), step)
    invalid = (kind == 2) & F.coalesce(F.col("frame.item.result.value") == "InvalidRequest", F.lit(False))
    complaint = F.concat(F.lit("(InvalidRequest: "), F.coalesce("frame.item.result.message", F.lit("unknown")), F.lit(")"))
    text = (F.when(update, update_text).when(invalid, complaint)
            .when(kind == 2, F.coalesce(_last_answer(F.col("frame.item.messages")), F.lit(""))).otherwise(""))
    gone = lambda ms: F.exists(_spoken(ms), lambda m: F.coalesce(m.getField("messageType"), F.lit("")) == "Disengaged")
    disengaged = F.coalesce(F.when(update, F.exists(arguments, lambda a: F.coalesce(gone(a.getField("messages")), F.lit(False))))
                            .when((kind == 2) & ~invalid, gone(F.col("frame.item.messages"))), F.lit(False))
    last_update = update & F.exists(arguments, lambda a: F.coalesce(a.getField("isLastUpdate"), F.lit(False)))
    final = last_update | kind.isin(2, 3, 5, 7)
    stop = (F.when(disengaged, "disengaged").when(invalid, "invalid_request").when(kind == 5, "binding_failure").when(final, "final"))
    return frames.select("request_id", "seq", "ts", "pos", kind.alias("type"), text.alias("text"), final.alias("is_final"), stop.alias("stop"))


def until_stop(texts: DataFrame) -> DataFrame:
    """Frames of each request up to and including the one that ends it."""
    at = F.struct("seq", "pos")
    ends = texts.filter("stop IS NOT NULL").groupBy("request_id").agg(F.min(at).alias("_end"))
    return texts.join(ends, "request_id", "left").filter(F.col("_end").isNull() | (at <= F.col("_end"))).drop("_end")


def assemble(texts: DataFrame) -> DataFrame:
    """Per request: the last non-empty text before it ended, and how it ended ('open' = not yet)."""
    at = F.struct("seq", "pos")
    said = F.length("text") > 0
    return until_stop(texts).groupBy("request_id").agg(
        F.coalesce(F.max_by(F.when(said, F.col("text")), F.when(said, at)), F.lit("")).alias("text"),
        F.coalesce(F.max("stop"), F.lit("open")).alias("status"), F.count(F.lit(1)).alias("frames"))


def deltas(texts: DataFrame, width: int = 1 << 32) -> DataFrame:
    """What a reader of the answer would receive: the new suffix, or the whole text when it changed.

    The text shown before a frame comes from buckets of positions, so one very
    long answer is not one task.
    """
    shown = until_stop(texts).filter((F.length("text") > 0) & (F.col("stop").isNull() | (F.col("stop") == "final")))
    before = previous_value(shown, ["request_id"], F.col("seq") * (1 << 20) + F.col("pos"), "text", "_prev", width)
    before = before.withColumn("_prev", F.coalesce("_prev", F.lit("")))
    delta = F.when(F.startswith("text", "_prev"), F.expr("substring(text, length(_prev) + 1)")).otherwise(F.col("text"))
    return before.select("request_id", "seq", "pos", delta.alias("delta")).filter(F.length("delta") > 0)


_STREAMED = "request_id string, seq bigint, pos int, delta string, text string, status string"
_STATE = "text string, shown string, status string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One request's frames of one micro-batch, in order, on top of what it has said before."""
    text, shown, status = state.get if state.exists else ("", "", "open")
    if state.hasTimedOut:
        state.remove()
        if status == "open":
            yield pd.DataFrame([(key[0], None, None, None, text, "timeout")], columns=["request_id", "seq", "pos", "delta", "text", "status"])
        return
    frames = pd.concat(list(batches)).sort_values(["seq", "pos"])
    out = []
    for f in frames.itertuples(index=False):
        if status != "open":
            break  # later frames of an ended request are ignored
        if f.text:
            text = f.text
        stop = f.stop if isinstance(f.stop, str) else None
        delta = ""
        if stop in (None, "final"):
            delta = text[len(shown):] if text.startswith(shown) else text
            shown = text
        if stop is not None:
            status = stop
        if delta or stop is not None:
            out.append((key[0], f.seq, f.pos, delta, text if stop is not None else None, status))
    state.update((text, shown, status))
    # idle requests, and the tombstones of ended ones, leave the state with the watermark
    state.setTimeoutTimestamp(max(int(frames["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 600_000)
    yield pd.DataFrame(out, columns=["request_id", "seq", "pos", "delta", "text", "status"])


def stream_answers(payloads: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Deltas as they arrive and, on the row that ends a request, its whole text and status."""
    texts = frame_texts(parse_frames(payloads.withWatermark("ts", watermark)))
    return texts.groupBy("request_id").applyInPandasWithState(_advance, _STREAMED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)

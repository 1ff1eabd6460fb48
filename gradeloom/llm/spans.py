"""Cutting byte spans out of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import slices, text_or_empty


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """owner, mark, text of the rows with an id; a text is addressed by its id and the hash `mark`."""
    return (docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("owner"), text_or_empty(text).alias("text"))
            .withColumn("mark", F.xxhash64("text")))


def by_text(spans: DataFrame) -> DataFrame:
    """(owner, mark, start, end) rows -> one row per text with its different spans, so repeated rows of a text don't multiply them."""
    return spans.groupBy("owner", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def joined(spans: list[dict], least: int = 1) -> list[tuple[int, int]]:
    """Maximal runs, of at least `least` bytes, of spans sorted by start; touching ones are one run."""
    runs: list[list[int]] = []
    for s in spans:
        if runs and s["start"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s["end"])
        else:
            runs.append([s["start"], s["end"]])
    return [(a, b) for a, b in runs if b - a >= least]


def cut(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """doc_id, n_bytes, runs (array of start, end), kept (the remaining bytes) of every row; `spans` as `by_text` gives them."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept, runs, sizes = [], [], []
            for raw, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                own = joined(found or [], least)
                ends = [0, *(x for r in own for x in r), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2])))
                runs.append([{"start": a, "end": b} for a, b in own])
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()),
                                              pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                                             ["doc_id", "n_bytes", "runs", "kept"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_or_empty(text).alias("text"))
    matched = rows.join(spans, (rows["doc_id"] == spans["owner"]) & (F.xxhash64("text") == spans["mark"]), "left").select("doc_id", "text", "spans")
    return matched.mapInArrow(run, "doc_id bigint, n_bytes bigint, runs array<struct<start bigint, end bigint>>, kept binary")

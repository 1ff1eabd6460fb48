"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.session import checkpoint_dir

#: bytes of text that a task turns into arrays at once; a longer text is taken alone
SLICE_BYTES = 1 << 21

#: the characters that separate words, and that exact deduplication ignores
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = f"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that the driver and all executors see."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and keeps column pruning."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The pyarrow file system and place of a path of the shared folder, for reading in a task."""
    local = path.startswith(("file:/", "/"))
    return pa.fs.FileSystem.from_uri("file:///" + path.removeprefix("file:").lstrip("/") if local else path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `df` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one slice stay below `limit` bytes (a single longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a string or binary array, n + 1 offsets); null counts as empty."""
    texts = pa.compute.fill_null(values.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]

"""Token counts of the documents in flat token files.

A flat file is nothing but token ids of a fixed width; documents are told
apart by an end-of-document id after each, and there is no index. Files are
listed by Spark and cut into blocks of `BLOCK_BYTES`; a task reads a block's
bytes (through pyarrow's file systems), finds all separators at once by a
vectorised comparison, and gives the documents that lie inside, the tokens
before its first separator (head) and those after its last (tail). Documents
that cross blocks are stitched by a prefix scan over the blocks' sums: within
stretches of `SCAN_BLOCKS` blocks and over the stretches, so a file of any
length is many groups.

`write_flat` makes such files with Spark's text writer: a row's value is the
document's tokens as raw bytes, and the line separator is the end-of-document
id. That works for ids whose bytes are valid UTF-8, such as 0xC480 (50,304)
in big-endian 16-bit files; files with other separators are read all the same.

Defined cases: null text has no tokens and still is a document; an empty
document counts 0; tokens after a file's last separator are a last document
that has no end (`ended` is false); an empty file has no documents; bytes
that don't fill a token at the end of a file are an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gradeloom.llm.bpe import read_ranks
from gradeloom.llm.common import kept_table, parts, slices

BLOCK_BYTES = 1 << 22
SCAN_BLOCKS = 1024
SEPARATOR, WIDTH = 0xC480, ">u2"


def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def write_flat(docs: DataFrame, to: str, path: str, pattern: str, text: str = "text", separator: int = SEPARATOR, kind: str = WIDTH) -> None:
    """Encode `text` with the rank file at `path` and write flat token files below `to`."""
    end = np.array([separator], kind).tobytes().decode()  # must be UTF-8 for the writer

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for batch in slices(batches, "text"):
            made = [np.array(encoding.encode_ordinary(t or ""), kind).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["tokens"])

    docs.select(F.col(text).alias("text")).mapInArrow(run, "tokens binary").select(F.col("tokens").cast("string").alias("value")).write.option("lineSep", end).text(to)


def _opened(path: str):
    store, at = pa.fs.FileSystem.from_uri("file:///" + path.removeprefix("file:/").lstrip("/") if path.startswith("file:/") else path)
    return store.open_input_file(at)


def scan_blocks(spark: SparkSession, path: str, separator: int, kind: str, block_bytes: int) -> DataFrame:
    """file, block, tokens, separators, head, tail, and the lengths of the documents that lie inside the block."""
    width = np.dtype(kind).itemsize
    block_bytes -= block_bytes % width
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block_bytes).cast("bigint"))
    blocks = files.select("path", "length", F.posexplode(starts).alias("block", "start")).repartition(parts(files) * 2)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["length"] % width:
                    raise ValueError(f"{row['path']} has {row['length']} bytes, which {width}-byte tokens don't fill")
                with _opened(row["path"]) as file:
                    tokens = np.frombuffer(file.read_at(min(block_bytes, row["length"] - row["start"]), row["start"]), kind)
                at = np.flatnonzero(tokens == separator)
                inside = np.diff(at) - 1
                head, tail = (int(at[0]), len(tokens) - 1 - int(at[-1])) if len(at) else (len(tokens), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]]), pa.array([row["block"]], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([len(at)], pa.int64()),
                     pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([inside.tolist()], pa.list_(pa.int64()))],
                    ["file", "block", "tokens", "separators", "head", "tail", "inside"])

    return blocks.mapInArrow(run, "file string, block bigint, tokens bigint, separators bigint, head bigint, tail bigint, inside array<bigint>")


def _scanned(blocks: DataFrame) -> DataFrame:
    """Adds `before` (documents ended before the block) and `open` (tokens since the last separator before it): a scan in two levels."""
    # (separators, tokens since the last separator) combine associatively: a piece without separators lengthens, one with them restarts
    staged = blocks.withColumn("stretch", F.floor(F.col("block") / SCAN_BLOCKS))
    earlier = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = (staged.withColumn("seps_in", F.coalesce(F.sum("separators").over(earlier), F.lit(0)))
             .withColumn("sum_in", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
             .withColumn("ends", F.when(F.col("separators") > 0, F.struct(F.col("block").alias("block"), F.col("tail").alias("tail"), (F.col("sum_in") + F.col("tokens")).alias("sum")))))
    local = local.withColumn("last_in", F.max("ends").over(earlier))
    totals = (local.groupBy("file", "stretch").agg(F.sum("separators").alias("seps"), F.max("ends").alias("last"), F.sum("tokens").alias("size"))
              .withColumn("left", F.when(F.col("last").isNull(), F.col("size")).otherwise(F.col("last.tail") + F.col("size") - F.col("last.sum"))))
    over = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = (totals.withColumn("seps_before", F.coalesce(F.sum("seps").over(over), F.lit(0)))
              .withColumn("size_before", F.coalesce(F.sum("size").over(over), F.lit(0)))
              .withColumn("restart", F.when(F.col("seps") > 0, F.struct("stretch", "left", (F.col("size_before") + F.col("size")).alias("sum")))))
    totals = (totals.withColumn("restarted", F.max("restart").over(over))
              .withColumn("open_before", F.when(F.col("restarted").isNull(), F.col("size_before")).otherwise(F.col("restarted.left") + F.col("size_before") - F.col("restarted.sum")))
              .select("file", "stretch", "seps_before", "open_before"))
    inside = F.when(F.col("last_in").isNull(), F.col("open_before") + F.col("sum_in")).otherwise(F.col("last_in.tail") + F.col("sum_in") - F.col("last_in.sum"))
    return (local.join(totals, ["file", "stretch"]).withColumn("before", F.col("seps_before") + F.col("seps_in")).withColumn("open", inside)
            .select("file", "block", "tokens", "separators", "head", "tail", "inside", "before", "open"))


def token_counts(spark: SparkSession, path: str, separator: int = SEPARATOR, kind: str = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, doc_no (from 0, in file order), n_tokens (without the separator), ended."""
    scanned = _scanned(kept_table(scan_blocks(spark, path, separator, kind, block_bytes), "token-blocks"))
    lengths = F.when(F.col("separators") > 0, F.concat(F.array(F.col("open") + F.col("head")), "inside"))
    ended = scanned.select("file", "before", F.posexplode(lengths).alias("n", "n_tokens")).select(
        "file", (F.col("before") + F.col("n")).alias("doc_no"), "n_tokens", F.lit(True).alias("ended"))
    last = scanned.groupBy("file").agg(F.max_by(F.struct("separators", "before", "open", "tokens", "tail"), "block").alias("z"))
    rest = last.select("file", (F.col("z.before") + F.col("z.separators")).alias("doc_no"),
                       F.when(F.col("z.separators") > 0, F.col("z.tail")).otherwise(F.col("z.open") + F.col("z.tokens")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest.where("n_tokens > 0"))

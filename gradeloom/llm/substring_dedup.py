"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of each text; a chunk ends where its top
bits are zero, so cuts move with the content and an insertion changes only
the chunks around it. Chunks have `LEAST` to `MOST` bytes and are addressed
by a 128-bit digest. A chunk repeats if the same digest occurs in a document
with a smaller id. Short chunks meet by chance, so bytes are removed only
where repeating chunks follow each other over at least `RUN_BYTES`.

Repeats within one block of documents are settled by the task that reads
them; each digest then travels once per block, and a chunk that a third of
all documents hold is one row per block.

Defined cases: null text is empty; a null id is neither smaller nor larger
than another, so such a row stays whole; repeats within one document, or
between rows of one id, stay; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.llm.common import flat_bytes, slices
from gradeloom.llm.spans import by_text, cut, marked

LEAST, MOST = 12, 256
#: a cut needs this many top bits of the 16-bit hash to be zero: one place in 16
CUT_BITS = 4
#: the hash forgets a byte after this many steps
REACH = 16
RUN_BYTES = 128
BLOCK_BYTES = 1 << 22
_GEAR = np.random.default_rng(20240503).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i - 1] << 1) + gear[data[i]] in 16 bits, for all places at once: sums over 1, 2, 4, 8 and 16 bytes."""
    h = _GEAR[data]
    reach = 1
    while reach < REACH:
        longer = h.copy()
        longer[reach:] += h[:-reach] << np.uint16(reach)
        h, reach = longer, 2 * reach
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(text number, start, end) of every chunk; places count from the start of `data`."""
    cuts = np.flatnonzero(gear_hashes(data) >> np.uint16(16 - CUT_BITS) == 0) + 1 if len(data) else np.zeros(0, np.int64)
    first = np.searchsorted(cuts, offsets[:-1] + REACH).tolist()  # nearer to the start the hash still holds the text before
    last = np.searchsorted(cuts, offsets[1:]).tolist()
    cuts = cuts.tolist()
    texts, starts, ends = [], [], []
    for t, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        at = begin
        for c in [*cuts[first[t]:last[t]], end]:
            while c - at > MOST:
                texts.append(t), starts.append(at), ends.append(at + MOST)
                at += MOST
            if c - at >= LEAST or c == end and c > at:
                texts.append(t), starts.append(at), ends.append(c)
                at = c
    return texts, starts, ends


def chunks(rows: DataFrame) -> DataFrame:
    """owner, mark, start, end, digest, and `settled` where a smaller id of the same block has the chunk."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK_BYTES):
            data, offsets = flat_bytes(batch.column("text"))
            texts, starts, ends = chunk_ends(data, offsets)
            raw, owner, mark = data.tobytes(), batch.column("owner").to_numpy(), batch.column("mark").to_numpy()
            digests = [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts, ends)]
            text = np.array(texts, np.int64)
            owners = owner[text]
            least: dict[bytes, int] = {}
            for i in np.argsort(owners, kind="stable").tolist():
                least.setdefault(digests[i], i)
            holder = np.fromiter((least[d] for d in digests), np.int64, len(digests))
            start = np.array(starts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners), pa.array(mark[text]), pa.array(start - offsets[text]), pa.array(np.array(ends, np.int64) - offsets[text]),
                 pa.array(digests, pa.binary()), pa.array(owners[holder] < owners)], ["owner", "mark", "start", "end", "digest", "settled"])

    return rows.mapInArrow(run, "owner bigint, mark bigint, start bigint, end bigint, digest binary, settled boolean")


def repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """owner, mark, start, end of chunks that a smaller id has too."""
    # a settled row only passes through: any key spreads it
    keyed = chunks(marked(docs, doc_id, text)).withColumn("key", F.when(F.col("settled"), F.unhex(F.hex(F.xxhash64("owner", "start")))).otherwise(F.col("digest")))
    same = Window.partitionBy("key")
    return (keyed.withColumn("least", F.min("owner").over(same)).where("settled or least < owner").select("owner", "mark", "start", "end"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = RUN_BYTES) -> DataFrame:
    """doc_id, n_bytes, runs (array of start, end in bytes), kept (the remaining bytes) of every row."""
    return cut(docs, by_text(repeated_chunks(docs, doc_id, text)), doc_id, text, least)

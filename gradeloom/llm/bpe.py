"""Byte-level BPE encoding and decoding through a serialised sentencepiece model.

The model file is written here field by field from the rank table: every
token becomes a piece in which each byte is one character, its score is the
negative rank, and normalisation is the identity. A BPE step of sentencepiece
joins the neighbours with the best score first, the leftmost on a tie, which
is the order of the ranks. Each match of the split pattern is encoded on its
own; decoding maps ids back to their bytes.

A task keeps the ids of recent pre-tokens in a table of at most `CACHED_BYTES`;
a full table is emptied and fills again, so memory is bounded and nothing is
left out. `round_trip` encodes and decodes in one pass, so that a task has one
worker with one set of tables.

Defined cases: null text is encoded as the empty text (no ids); null ids are
decoded as empty; every other column passes through untouched, whatever its
name; a column with the output's name is replaced.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import sentencepiece
from pyspark.sql import DataFrame, types as T

from gradeloom.llm.common import slices

#: bytes are mapped to this block of characters, none of which the library treats as white space
FIRST_CHARACTER = 0x100
BYTES_TO_CHARACTERS = {b: FIRST_CHARACTER + b for b in range(256)}
#: of pre-tokens and their ids, with what Python needs for an entry
CACHED_BYTES, ENTRY_BYTES = 16 << 20, 200
NORMAL, UNKNOWN = 1, 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value % 2**64)


def _block(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def _piece(text: str, score: float, kind: int) -> bytes:
    return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(BYTES_TO_CHARACTERS)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model file: pieces in id order (ids are ranks), one unknown piece after them."""
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    pieces = b"".join(_piece(mapped(t), -float(ranks[t]), NORMAL) for t in tokens) + _piece("<unk>", 0.0, UNKNOWN)
    model_type, unk_id, bos_id, eos_id, pad_id = 3, 40, 41, 42, 43
    trainer = _number(model_type, 2) + _number(unk_id, len(tokens)) + b"".join(_number(f, -1) for f in (bos_id, eos_id, pad_id))
    add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = 3, 4, 5
    normaliser = _block(1, b"identity") + b"".join(_number(f, 0) for f in (add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces))
    return pieces + _block(2, trainer) + _block(3, normaliser)


class _Ids(dict):
    """Pre-token -> its ids as little-endian 32-bit integers, encoded when first asked for."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        super().__init__()
        self.model, self.held = model, 0

    def __missing__(self, token: str) -> bytes:
        ids = self.model.encode(mapped(token.encode()))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= 64:
            self.held += ENTRY_BYTES + 2 * len(token) + len(packed)
            if self.held > CACHED_BYTES:
                self.clear()
                self.held = 0
            self[token] = packed
        return packed


def _encoder(ranks: dict[bytes, int], pattern: str):
    """text -> ids as bytes. Made by each task, so that a worker doesn't hold its tables through later stages."""
    split = regex.compile(pattern).findall
    ids = _Ids(sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks)))
    return lambda text: b"".join(map(ids.__getitem__, split(text or "")))


def _decoder(ranks: dict[bytes, int]):
    """ids as bytes -> the bytes they stand for."""
    tokens = sorted(ranks, key=ranks.get)
    return lambda ids: b"".join(map(tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def _with_column(df: DataFrame, source: str, out: str, converter) -> DataFrame:
    df = df.drop(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = converter()
        for batch in slices(batches, source):
            made = pa.array([convert(v.as_py()) for v in batch.column(source)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of `text`, packed as little-endian unsigned 32-bit integers.

    `path` is the rank file's place on every executor.
    """
    return _with_column(df, text, out, lambda: _encoder(read_ranks(path), pattern))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that `ids` stand for."""
    return _with_column(df, ids, out, lambda: _decoder(read_ranks(path)))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", same: str = "same") -> DataFrame:
    """Replace `text` by its ids, the bytes these decode to (unless `decoded` is None) and whether those are the text's."""
    made = [name for name in (ids, decoded, same) if name]
    df = df.drop(*[name for name in made if name != text])
    kept = [f for f in df.schema.fields if f.name != text]
    kinds = {ids: (T.BinaryType(), pa.binary()), decoded: (T.BinaryType(), pa.binary()), same: (T.BooleanType(), pa.bool_())}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        to_ids, to_bytes = _encoder(ranks, pattern), _decoder(ranks)
        for batch in slices(batches, text):
            columns = {name: [] for name in made}
            for value in batch.column(text):
                value = value.as_py() or ""
                columns[ids].append(to_ids(value))
                back = to_bytes(columns[ids][-1])
                columns[same].append(back == value.encode())
                if decoded:
                    columns[decoded].append(back)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(columns[n], kinds[n][1]) for n in made)], [*(f.name for f in kept), *made])

    return df.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, kinds[n][0]) for n in made)]))

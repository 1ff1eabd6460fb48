"""BPE encoding and decoding through a table of distinct words.

A byte-level BPE never merges across the words of its pre-tokenizer, so a word
has the same ids wherever it stands. Documents are therefore split, every
different word is encoded once, and its ids are joined back by position:

1. A task gathers its documents into blocks of at most `block_bytes` of text
   (a longer text is a block of its own) and splits them. In a block every
   different word has a number, the frequent ones the small numbers, and a
   document is the list of its words' numbers, in the order of positions.
2. The different words of a block go out by `bucket`, a hash of the word, as
   one compressed row per (bucket, block). A bucket's group holds each of its
   words once and encodes it once. Its ids are turned into pieces by a join
   with the table of pieces, which gives the bytes they decode to.
3. Each row returns to its block with ids and bytes in place of words, and a
   cogroup by block puts them at their positions in the documents.

A common word travels once per block, not once per occurrence, so no key is
hot; a group is a block, or a bucket, whose number follows from the input's
size (`WORDS_SHARE` of its bytes in groups of `BUCKET_BYTES`).

The split is that of the tokenizer file, vectorised over code points. Texts
made of the characters in `SAME_CLASSES` get their classes from the `regex`
module; texts with any other character, whose class may depend on the Unicode
version, are split by the tokenizer's own pre-tokenizer.

The input is read twice, for words and for documents, which saves a shuffle of
the texts; it must return the same partitions both times, as a table does. A
block is named by its partition, number and content: if the input did change
in between, words are missing and the cogroup raises.

Defined cases: null text is the empty text (no ids, empty bytes); texts may
hold the strings of added tokens, which get the added tokens' ids; repeated
rows stay repeated; an empty table gives an empty table; every other column
passes through untouched, whatever its name, and a column that has an output's
name is replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from gradeloom.llm.common import flat_bytes, slices

BLOCK_BYTES = 24 << 20
BUCKET_BYTES = 16 << 20
#: different words of all blocks, as a share of the input's bytes on disk
WORDS_SHARE = 0.4
#: what the planner says of inputs that it can't estimate is above this
UNKNOWN_SIZE = 1 << 60
#: characters whose classes are the same in every Unicode version the two libraries may have (checked by a test)
SAME_CLASSES = "\u0000-ԯ‐-‧‰-⁞₠-₽ぁ-ゖァ-ヺ㐀-䶵一-龥가-힣\U0001F300-\U0001F64F"
OUTSIDE, LETTER, NUMBER, SPACE, OTHER = range(5)
APOSTROPHE, BLANK = 39, 32
#: endings that a byte-level split takes off after an apostrophe (fixed values)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class Splitter:
    """Cuts texts where the tokenizer's pre-tokenizer and added tokens do."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        split, added = made["pre_tokenizer"], made["added_tokens"]
        if made["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] \
                or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("expected a byte-level tokenizer without a normaliser")
        self.library = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.added = sorted((t["content"] for t in added), key=len, reverse=True)
        self.parted = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split
        self.classes = np.full(0x110000, OUTSIDE, np.uint8)
        same = re.compile(f"[{SAME_CLASSES}]").findall("".join(chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000))
        for kind, pattern in ((OTHER, r"(?s)."), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            self.classes[[ord(c) for c in regex.findall(pattern, "".join(same))]] = kind

    def _by_library(self, text: str) -> list[int]:
        """Positions of code points at which words start."""
        found, done = [], 0
        for i, part in enumerate(self.parted(text) if self.added else [text]):
            found += [done] if i % 2 else [done + a for _, (a, _) in self.library(part)]
            done += len(part)
        return found

    def starts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(byte positions of all word starts in the joined texts, words of each text)."""
        values = texts.to_pylist()
        points = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        ends = np.cumsum(sizes)
        filled = sizes > 0
        first, last = (ends - sizes)[filled], ends[filled] - 1
        kind = self.classes[points]
        before, after = np.concatenate([[0], kind[:-1]]), np.concatenate([kind[1:], [0]])
        before[first] = after[last] = OUTSIDE
        start = kind != before
        start[first] = True
        # the last space of a run belongs to the word that follows; any other white space there stands alone
        edge = (kind == SPACE) & (after != SPACE) & (after != OUTSIDE)
        start |= edge
        start[np.flatnonzero(edge & (points == BLANK)) + 1] = False
        for at in self._endings(points, start, ends):
            start[at[0]], start[at[1]] = False, True
        odd = np.zeros(len(values), bool)
        odd[np.searchsorted(ends, np.flatnonzero(kind == OUTSIDE), side="right")] = True
        for name in self.added:
            odd |= pa.compute.match_substring(texts, name).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd).tolist():
            begin = int(ends[i] - sizes[i])
            start[begin:ends[i]] = False
            start[[begin + at for at in self._by_library(values[i])]] = True
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        counted = np.concatenate([[0], np.cumsum(start)])
        return (np.cumsum(widths) - widths)[start], counted[ends] - counted[ends - sizes]

    def _endings(self, points: np.ndarray, start: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each ending: positions of its first letter, and those after it within the text."""
        marks = np.flatnonzero(start & (points == APOSTROPHE))
        room = ends[np.searchsorted(ends, marks, side="right")]
        for ending in ENDINGS:
            fits = room > marks + len(ending)
            for k, letter in enumerate(ending):
                fits &= points[np.minimum(marks + 1 + k, len(points) - 1)] == ord(letter)
            at = marks[fits]
            after = at + 1 + len(ending)
            yield at + 1, after[after < room[fits]]


def pack(numbers: np.ndarray) -> bytes:
    """Seven bits to a byte, lowest first; the high bit says that more follow."""
    numbers = numbers.astype(np.uint32)
    sizes = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > k)
        out[starts[has] + k] = (numbers[has] >> np.uint32(7 * k)) & 127 | np.where(sizes[has] > k + 1, 128, 0).astype(np.uint32)
    return out.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    data = np.frombuffer(packed, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the joined ranges starts[i] .. starts[i] + sizes[i]."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _binary(sizes: np.ndarray, data: np.ndarray | bytes) -> pa.Array:
    """A binary array of values with these sizes, which lie one after another in `data`."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class _Block:
    """Documents of one block: their texts until it is closed, then the words' numbers."""

    def __init__(self):
        self.size, self.rows, self.texts, self.starts, self.counts = 0, [], [], [], []

    def add(self, rows: pa.Array, texts: pa.Array, splitter: Splitter) -> None:
        data, _ = flat_bytes(texts)
        starts, counts = splitter.starts(texts)
        self.rows.append(rows)
        self.starts.append(starts + self.size)
        self.counts.append(counts)
        self.texts.append(data)
        self.size += len(data)

    def close(self) -> tuple[pa.Array, np.ndarray, bytes]:
        """(different words by number, the number of each word in order, digest of the content)."""
        starts, data = np.concatenate(self.starts), np.concatenate(self.texts)
        self.texts, self.starts = [], []
        coded = _binary(np.diff(np.append(starts, len(data))), data).dictionary_encode()
        codes = coded.indices.to_numpy()
        by_use = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
        number = np.empty(len(by_use), np.int64)
        number[by_use] = np.arange(len(by_use))
        return coded.dictionary.take(pa.array(by_use)), number[codes], hashlib.blake2b(data, digest_size=8).digest()


def _blocks(batches: Iterable[pa.RecordBatch], path: str, block_bytes: int) -> Iterator[tuple[int, _Block]]:
    splitter, block, made = Splitter(path), _Block(), 0
    for batch in slices(batches, "text"):
        size = pa.compute.sum(pa.compute.binary_length(batch.column("text"))).as_py()
        if block.rows and block.size + size > block_bytes:
            yield made, block
            block, made = _Block(), made + 1
        block.add(batch.column("row"), batch.column("text"), splitter)
    if block.rows:
        yield made, block


def _name(made: int, digest: bytes) -> bytes:
    from pyspark import TaskContext

    return TaskContext.get().partitionId().to_bytes(4, "big") + made.to_bytes(4, "big") + digest


def _rows(docs: DataFrame, text: str) -> DataFrame:
    others = [F.col(f"`{name}`") for name in docs.columns if name != text]
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    return docs.select(row.alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def coded_documents(docs: DataFrame, path: str, text: str, block_bytes: int) -> DataFrame:
    """(block, row, codes): the numbers of a document's words in its block; `row` holds the other columns."""
    source = _rows(docs, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3).compress
        for made, block in _blocks(batches, path, block_bytes):
            _, numbers, digest = block.close()
            name, done = _name(made, digest), 0
            for rows, counts in zip(block.rows, block.counts):
                ends = done + np.cumsum(counts)
                codes = [squeeze(pack(numbers[e - c:e])) for e, c in zip(ends.tolist(), counts.tolist())]
                done = int(ends[-1])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.binary()), rows, pa.array(codes, pa.binary())], ["block", "row", "codes"])

    schema = T.StructType([T.StructField("block", T.BinaryType()), T.StructField("row", source.schema["row"].dataType), T.StructField("codes", T.BinaryType())])
    return source.mapInArrow(run, schema)


def block_words(docs: DataFrame, path: str, text: str, block_bytes: int, buckets: int) -> DataFrame:
    """(bucket, block, numbers, words): the different words of a block, by bucket and in order of their bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3).compress
        for made, block in _blocks(batches, path, block_bytes):
            words, _, digest = block.close()
            order = pa.compute.sort_indices(words).to_numpy().astype(np.int64)
            words = words.take(pa.array(order))
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words.to_pylist()), np.int64, len(words))
            by_bucket = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
            out = {"bucket": [], "numbers": [], "words": []}
            for places in np.split(by_bucket, cuts) if len(words) else []:
                data, offsets = flat_bytes(words.take(pa.array(places)))
                out["bucket"].append(int(bucket[places[0]]))
                out["numbers"].append(pack(order[places]))
                lengths = pack(np.diff(offsets))
                out["words"].append(squeeze(len(lengths).to_bytes(4, "little") + lengths + data.tobytes()))
            name = _name(made, digest)
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array([name] * len(out["bucket"]), pa.binary()),
                                              pa.array(out["numbers"], pa.binary()), pa.array(out["words"], pa.binary())],
                                             ["bucket", "block", "numbers", "words"])

    return _rows(docs, text).mapInArrow(run, "bucket int, block binary, numbers binary, words binary")


def _unpack_words(packed: bytes) -> pa.Array:
    data = zstandard.ZstdDecompressor().decompress(packed)
    begin = 4 + int.from_bytes(data[:4], "little")
    return _binary(unpack(data[4:begin]), data[begin:])


class Vocabulary:
    """The tokenizer of one task: loaded at its first use, not sent along."""

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None

    def load(self) -> Tokenizer:
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = (b for b in range(256) if b not in printable)
            self.spelling = {b: chr(b) for b in printable} | {256 + i: chr(b) for i, b in enumerate(hidden)}
        return self.tokenizer

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, ids of each word)."""
        tokenizer = self.load()
        found = [tokenizer.encode(word, add_special_tokens=False).ids for word in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int64, int(sizes.sum())), sizes

    def pieces(self, ids: np.ndarray) -> pa.Table:
        """Rows (id, piece) of the vocabulary: the bytes that each of these ids stands for."""
        name = self.load().id_to_token
        spelled = [self.added.get(i) or name(i).translate(self.spelling).encode("latin-1") for i in ids.tolist()]
        return pa.table({"id": pa.array(ids, pa.int64()), "piece": pa.array(spelled, pa.large_binary())})

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids one after another, bytes of each id), by a join of the ids with the pieces."""
        table = self.pieces(np.unique(ids))
        found = pa.compute.index_in(pa.array(ids, pa.int64()), value_set=table.column("id"))
        data, offsets = flat_bytes(table.column("piece").combine_chunks().take(found))
        return data, np.diff(offsets)


def _encode_bucket(rows: pa.Table, vocabulary: Vocabulary) -> pa.Table:
    """The rows of one bucket with ids and bytes in place of words; each different word is encoded once."""
    squeeze = zstandard.ZstdCompressor(3).compress
    listed = [_unpack_words(packed) for packed in rows.column("words").to_pylist()]
    coded = pa.concat_arrays(listed).dictionary_encode()
    codes, done = coded.indices.to_numpy(), 0
    ids, id_sizes = vocabulary.encode([w.decode() for w in coded.dictionary.to_pylist()])
    data, byte_sizes = vocabulary.decode(ids)
    id_ends = np.cumsum(id_sizes)
    byte_ends = np.concatenate([[0], np.cumsum(byte_sizes)])
    made = []
    for words in listed:
        own = codes[done:done + len(words)]
        done += len(words)
        begins, sizes = (id_ends - id_sizes)[own], id_sizes[own]
        first, length = byte_ends[begins], byte_ends[begins + sizes] - byte_ends[begins]
        parts = [pack(sizes), pack(ids[ragged(begins, sizes)]), pack(length), data[ragged(first, length)].tobytes()]
        made.append(squeeze(b"".join(len(p).to_bytes(8, "little") + p for p in parts)))
    return pa.table({"block": rows.column("block"), "numbers": rows.column("numbers"), "answers": pa.array(made, pa.binary())})


def _parts(packed: bytes) -> list[bytes]:
    data, at, found = zstandard.ZstdDecompressor().decompress(packed), 0, []
    while at < len(data):
        size = int.from_bytes(data[at:at + 8], "little")
        found.append(data[at + 8:at + 8 + size])
        at += 8 + size
    return found


def _place(block_docs: pa.Table, answers: pa.Table, fields: pa.Schema, ids: str, decoded: str) -> pa.Table:
    """The documents of one block with ids and bytes in place of their words' numbers."""
    lost = ValueError("the input gave other rows when it was read again: write it to a table first")
    if not block_docs.num_rows:
        raise lost
    numbers = [unpack(n) for n in answers.column("numbers").to_pylist()]
    parts = [_parts(packed) for packed in answers.column("answers").to_pylist()]
    number = np.concatenate([*numbers, np.zeros(0, np.int64)])
    id_sizes, all_ids, byte_sizes = (np.concatenate([*(unpack(p[k]) for p in parts), np.zeros(0, np.int64)]) for k in range(3))
    all_bytes = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    id_starts, byte_starts = np.cumsum(id_sizes) - id_sizes, np.cumsum(byte_sizes) - byte_sizes
    at = np.full(int(number.max(initial=-1)) + 1, -1, np.int64)
    at[number] = np.arange(len(number))
    made_ids, made_bytes, expand = [], [], zstandard.ZstdDecompressor().decompress
    for packed in block_docs.column("codes"):
        codes = unpack(expand(packed.as_py()))
        if codes.max(initial=-1) >= len(at) or (own := at[codes]).min(initial=0) < 0:
            raise lost
        made_ids.append(all_ids[ragged(id_starts[own], id_sizes[own])].astype("<u4").tobytes())
        made_bytes.append(all_bytes[ragged(byte_starts[own], byte_sizes[own])].tobytes())
    row = block_docs.column("row").combine_chunks()
    columns = {row.type.field(i).name: row.field(i) for i in range(row.type.num_fields)}
    columns |= {ids: pa.array(made_ids, pa.binary()), decoded: pa.array(made_bytes, pa.binary())}
    return pa.table([columns[f.name] for f in fields], schema=fields)


def _buckets(docs: DataFrame) -> int:
    """From the planner's estimate of the input's bytes; eight per shuffle partition where it has none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 8 * shuffles if size >= UNKNOWN_SIZE else max(shuffles, int(size * WORDS_SHARE) // BUCKET_BYTES)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded",
           block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """Replace `text` by its `ids` (packed as little-endian unsigned 32-bit integers) and the bytes they decode to.

    `path` is the tokenizer file's place on every executor.
    """
    docs = docs.drop(*[c for c in (ids, decoded) if c != text])
    words = block_words(docs, path, text, block_bytes, buckets or _buckets(docs))
    vocabulary = Vocabulary(path)
    answers = words.groupBy("bucket").applyInArrow(lambda rows: _encode_bucket(rows, vocabulary), "block binary, numbers binary, answers binary")
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BinaryType())])
    fields = to_arrow_schema(schema)
    return coded_documents(docs, path, text, block_bytes).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda block_docs, found: _place(block_docs, found, fields, ids, decoded), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that packed ids stand for; null ids decode to the empty value."""
    df = df.drop(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for batch in slices(batches, ids):
            data, offsets = flat_bytes(batch.column(ids))
            spelled, sizes = vocabulary.decode(np.frombuffer(data.tobytes(), "<u4").astype(np.int64))
            ends = np.concatenate([[0], np.cumsum(sizes)])[offsets // 4]
            made = _binary(np.diff(ends), spelled).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))

"""Substring deduplication by merging the Burrows-Wheeler transforms of shards.

Removed is every byte covered by a string of `LENGTH` bytes that also starts
in a document with a smaller id.

1. Counting. Each window of `LENGTH` bytes belongs to the smallest (by hash)
   of its `ANCHOR`-byte substrings. Neighbouring windows with one anchor form
   a segment. Texts are kept in blocks; a segment seen before in its block is
   settled there. The others send 5 bytes of their anchor's hash, and learn
   whether it occurs once, several times, or in a crowd.
2. Dealing. A segment whose anchor occurs once has nothing to be compared with
   and stays. Of the others, segments travel by their anchor's hash: equal
   windows meet, each window travels once, and a task sees only the texts it
   must compare. Segments of a crowded anchor (more than `most` of them) would
   fill a task: their windows travel one by one, by their own hash, and once a
   block.
3. Shards. In a task equal segments are one string. A window holds one of
   three stretches of 40 or 41 bytes around its anchor (`STRETCHES`); strings
   that share none with another string have nothing to be merged with: all
   their windows repeat, or none. The others are cut into shards, and each
   shard's transform is built by prefix doubling.
4. Merging. The interleave of all shards' rows starts shard after shard and is
   refined: a stable sort by the transform's symbols, followed by the step to
   the preceding suffix, turns an order by k symbols into one by k + 1; a
   round takes two symbols at once, so `LENGTH / 2` rounds are enough. After
   them the runs between boundaries are the repeated intervals: the
   occurrences of one string of that length.
5. Each interval has a smallest id; windows of other ids are removed. Spans
   return to their documents by a join.

No group is unbounded: their number follows from the bytes of the texts, an
anchor brings at most `most` segments of at most `2 * LENGTH - ANCHOR` bytes,
and a window one row for each block of texts.

Defined cases: null text is empty; a null id is neither smaller nor larger
than another, so such a row stays whole; rows with one id don't match each
other; repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import flat_bytes, kept_table, opened, parts, shared_path, slices
from gradeloom.llm.minhash import mix64, powers
from gradeloom.llm.spans import by_text, cut, marked

LENGTH = 50
ANCHOR = 20
BLOCK_BYTES = 1 << 22
#: a group of anchors is what one call merges: at least so many for each shuffle partition, and one for so many bytes of text
GROUPS_PER_PARTITION = 8
GROUP_BYTES = 16 << 20
SHARD_STRINGS = 256
#: windows whose anchors are found at once: few enough for their arrays to stay in a processor's cache
PIECE = 1 << 16
#: strings whose bytes are compared at once
COMPARED = 1024
#: around an anchor (bytes before it, bytes after it): each window holds one of these stretches
STRETCHES = ((20, 0), (10, 11), (0, 21))
#: bytes of strings that are merged at once
CHUNK_BYTES = 1_000_000
MOST_STRINGS = 20_000
_SYMBOL = np.random.default_rng(20240502).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(6364136223846793005)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = np.uint64(24)


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position on."""
    with np.errstate(over="ignore"):
        h, base, width, out, done = _SYMBOL[data], _BASE, 1, None, 0
        while True:
            if k & width:
                n = len(h) - done
                out, done = (h, width) if out is None else (out[:n] * base + h[done:done + n], done + width)
            if 2 * width > k:
                return mix64(out)
            n = len(h) - width
            h, base, width = h[:n] * base + h[width:width + n], base * base, 2 * width


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for short spans sorted by start, from prefix sums; equal strings have equal hashes."""
    out = np.empty(len(start), np.uint64)
    step = PIECE - 2 * LENGTH
    for base in range(0, len(data), step):
        a, b = np.searchsorted(start, (base, base + step))
        piece = data[base:base + PIECE]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_SYMBOL[piece] * powers(_BASE, len(piece)), out=sums[1:])
        s, e = start[a:b] - base, end[a:b] - base
        out[a:b] = mix64((sums[e] - sums[s]) * powers(_INVERSE, len(piece))[s] + (e - s).astype(np.uint64))
    return out


def _places(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after the other."""
    total = np.cumsum(length)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - (total - length), length)


def _first_equal(data: np.ndarray, start: np.ndarray, length: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each span the first one in `order` that has the same bytes. Hashes find them, bytes decide."""
    same = _digests(data, start, start + length)[order]
    found = np.empty(len(order), np.int64)
    if len(order):
        sort = np.argsort(same)
        head = np.concatenate([[True], same[sort][1:] != same[sort][:-1]])
        found[order[sort]] = order[np.minimum.reduceat(sort, np.flatnonzero(head))][np.cumsum(head) - 1]
    others = np.flatnonzero(found != np.arange(len(found)))
    first = found[others]
    if (length[others] != length[first]).any() or any(
            (data[_places(start[a], length[a])] != data[_places(start[b], length[b])]).any()
            for a, b in ((others[i:i + COMPARED], first[i:i + COMPARED]) for i in range(0, len(others), COMPARED))):
        seen: dict[bytes, int] = {}  # two strings with one hash
        raw = data.tobytes()
        for i in order.tolist():
            found[i] = seen.setdefault(raw[start[i]:start[i] + length[i]], i)
    return found


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        values, reach = np.minimum(values[:-reach], values[reach:]), 2 * reach
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end, anchor's place, anchor's hash) of each segment; places count from the start of `data`."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.astype(np.uint64)
    windows, before, found = len(data) - LENGTH + 1, -1, []
    for base in range(0, windows, PIECE):
        grams = _gram_hashes(data[base:base + PIECE + LENGTH - 1], ANCHOR)
        ranked = grams >> _PLACE << _PLACE | np.arange(len(grams), dtype=np.uint64)
        anchor = _sliding_least(ranked, LENGTH - ANCHOR + 1) & np.uint64((1 << 24) - 1)
        first = np.empty(len(anchor), bool)
        first[0] = int(anchor[0]) + base != before
        np.not_equal(anchor[1:], anchor[:-1], out=first[1:])
        first[offsets[slice(*np.searchsorted(offsets, (base, base + len(anchor))))] - base] = True
        at = np.flatnonzero(first)
        own = anchor[at].astype(np.int64)
        found.append((at + base, own + base, grams[own]))
        before = int(anchor[-1]) + base
    start, anchor, key = (np.concatenate(column) for column in zip(*found))
    text = np.searchsorted(offsets, start, side="right") - 1
    final = offsets[text + 1] - LENGTH  # the text's last window
    last = np.minimum(np.append(start[1:], windows) - 1, final)
    kept = np.flatnonzero(start <= final)
    return text[kept], start[kept], last[kept] + LENGTH, anchor[kept], key[kept]


def _pack(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpack(packed: bytes, kind) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], size, codec="zstd", asbytes=True) if size else b"", kind)


_FIELDS = {"owner": np.int64, "mark": np.int64, "start": np.uint32, "length": np.uint8, "at": np.uint8, "text": np.uint8,
           "done_owner": np.int64, "done_mark": np.int64, "done_start": np.uint32, "done_end": np.uint32}
BLOBS = "part int, " + ", ".join(f"{name} binary" for name in _FIELDS)
SPANS = "owner bigint, mark bigint, start bigint, end bigint"
#: what an anchor's count says: it occurs once; its segments are merged; its windows travel one by one
ONCE, MERGED, CROWDED = 0, 1, 2


def blocks(rows: DataFrame) -> DataFrame:
    """The texts in blocks of `BLOCK_BYTES`, kept in the shared folder, since both passes must see the same ones."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK_BYTES):
            data, offsets = flat_bytes(batch.column("text"))
            values = [_pack(v) for v in (batch.column("owner").to_numpy(), batch.column("mark").to_numpy(), offsets, data)]
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([len(data)], pa.int64()),
                                              *(pa.array([v], pa.binary()) for v in values)], ["block", "bytes", "owner", "mark", "offsets", "text"])

    return kept_table(rows.mapInArrow(run, "block bigint, bytes bigint, owner binary, mark binary, offsets binary, text binary"), "blocks")


class _Block:
    """One block's texts and their segments. `go` numbers those that no smaller id of the block has, group after group."""

    def __init__(self, row: dict, groups: int):
        self.ids, self.marks, self.offsets = (_unpack(row[name], np.int64) for name in ("owner", "mark", "offsets"))
        self.data = _unpack(row["text"], np.uint8)
        self.text, self.start, self.end, self.at, self.key = segments(self.data, self.offsets)
        travels = self.first_owner(self.start, self.end, self.text) == self.ids[self.text]
        self.group = (mix64(self.key) % np.uint64(groups)).astype(np.int64)
        go = np.flatnonzero(travels)
        self.go, self.done = go[np.argsort(self.group[go].astype(np.min_scalar_type(groups)), kind="stable")], np.flatnonzero(~travels)

    def first_owner(self, start: np.ndarray, end: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The smallest id of the block that has the same string."""
        owners = self.ids[text]
        return owners[_first_equal(self.data, start, end - start, np.argsort(owners, kind="stable"))]

    def cuts(self) -> np.ndarray:
        """Where each group's part of `go` begins, and the end."""
        group = self.group[self.go]
        return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, np.int64)

    def rows(self, part: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> Iterator[list]:
        """Strings sorted by part -> a row of arrays for each part."""
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
        own = start - self.offsets[text]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            length = (end - start)[a:b]
            yield [int(part[a]), self.ids[text[a:b]], self.marks[text[a:b]], own[a:b].astype(np.uint32), length.astype(np.uint8),
                   (at - start)[a:b].astype(np.uint8), self.data[_places(start[a:b], length)], *(np.zeros(0, kind) for kind in list(_FIELDS.values())[6:])]

    def settled(self, part: int, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> list:
        """A row of spans to remove."""
        return [part, *(np.zeros(0, kind) for kind in list(_FIELDS.values())[:6]), self.ids[text], self.marks[text],
                (start - self.offsets[text]).astype(np.uint32), (end - self.offsets[text]).astype(np.uint32)]


def _short(key: np.ndarray) -> np.ndarray:
    """Five bytes of each hash. Two anchors with the same ones only travel without need."""
    return np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, 3:]


def anchor_keys(kept: DataFrame, groups: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = _Block(row, groups)
                cuts = block.cuts()
                if len(cuts) > 1:
                    keys = [_short(block.key[block.go[a:b]]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(block.group[block.go[cuts[:-1]]], pa.int32()), pa.array([row["block"]] * len(keys), pa.int64()),
                                                      pa.array(keys, pa.binary())], ["part", "block", "keys"])

    return kept.mapInArrow(run, "part int, block bigint, keys binary")


def anchor_classes(table: pa.Table, most: int) -> pa.Table:
    """Of one group: for each block a byte for each key."""
    found = table.column("keys").to_pylist()
    raw = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 5)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, :5] = raw
    _, number, count = np.unique(keys.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    kind = np.where(count == 1, ONCE, np.where(count <= most, MERGED, CROWDED)).astype(np.uint8)[number]
    ends = np.cumsum([len(k) // 5 for k in found])
    return pa.table({"block": table.column("block"), "part": table.column("part"),
                     "kinds": pa.array([_pack(kind[b - len(k) // 5:b]) for k, b in zip(found, ends.tolist())], pa.binary())})


def kept_classes(kept: DataFrame, groups: int, most: int) -> tuple[str, int]:
    """(folder, buckets): the classes of every block, in a folder for each bucket of blocks."""
    path, buckets = shared_path(kept.sparkSession, "anchors"), max(32, groups // 8)
    found = anchor_keys(kept, groups).groupBy("part").applyInArrow(lambda t: anchor_classes(t, most), "block bigint, part int, kinds binary")
    found.withColumn("bucket", F.col("block") % buckets).repartition(parts(kept), "bucket").write.partitionBy("bucket").parquet(path)
    return path, buckets


def _read_classes(path: str, buckets: int, block: int) -> np.ndarray:
    """One block's classes in the order of its groups."""
    files, place = opened(path)
    found = pa.parquet.read_table(f"{place}/bucket={block % buckets}", filesystem=files, partitioning=None, filters=[("block", "==", block)]).sort_by("part")
    return np.concatenate([_unpack(v, np.uint8) for v in found.column("kinds").to_pylist()])


def _deal(block: _Block, kinds: np.ndarray, groups: int) -> Iterator[list]:
    """The strings of one block that must be compared, a row of arrays for each group; parts from `groups` on hold single windows."""
    if len(block.done):
        yield block.settled(int(block.group[block.done[0]]), block.text[block.done], block.start[block.done], block.end[block.done])
    i = block.go[kinds == MERGED]
    yield from block.rows(block.group[i], block.text[i], block.start[i], block.end[i], block.at[i])
    i = block.go[kinds == CROWDED]
    if len(i):
        windows = (block.end - block.start)[i] - LENGTH + 1
        start, text = _places(block.start[i], windows), np.repeat(block.text[i], windows)
        order = np.argsort(start)
        start, text = start[order], text[order]
        travels = block.first_owner(start, start + LENGTH, text) == block.ids[text]
        done, go = np.flatnonzero(~travels), np.flatnonzero(travels)
        part = groups + (_windows_of(block.data, start[go]) % np.uint64(groups)).astype(np.int64)
        if len(done):
            yield block.settled(groups + int(start[done[0]]) % groups, text[done], start[done], start[done] + LENGTH)
        order = np.argsort(part, kind="stable")
        go = go[order]
        yield from block.rows(part[order], text[go], start[go], start[go] + LENGTH, start[go])


def _windows_of(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the windows at the places `start`, ascending."""
    return mix64(_digests(data, start, start + LENGTH))


def dealt(kept: DataFrame, path: str, buckets: int, groups: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = _Block(row, groups)
                kinds = _read_classes(path, buckets, row["block"]) if len(block.go) else np.zeros(0, np.uint8)
                columns = list(zip(*([r[0], *(_pack(v) for v in r[1:])] for r in _deal(block, kinds, groups))))
                if columns:
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["part", *_FIELDS])

    return kept.mapInArrow(run, BLOBS)


def shard_transform(symbols: np.ndarray, string: np.ndarray, left: np.ndarray, shard: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Rows of every shard in the order of their suffixes (to `depth` symbols, then by place), shard after shard.

    `symbols` are the strings one after the other, each ended by 0; `left`
    counts the symbols from a place to the end of its string. Prefix
    doubling: ranks by 8 symbols, then 16, 32, 64.
    """
    n = len(symbols)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([symbols, np.zeros(8, np.uint8)])
    for j in range(8):
        key = key << np.uint64(8) | np.where(left >= j, padded[j:j + n], 0).astype(np.uint64)
    width = 8
    while True:
        order = np.argsort(key)  # equal keys may take any order: they share `depth` symbols in the end
        if width >= depth:
            break
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]])) + 1
        beyond = np.zeros(n, np.int64)
        reaches = np.flatnonzero(left >= width)
        beyond[reaches] = rank[reaches + width]
        key = rank.astype(np.uint64) << np.uint64(32) | beyond.astype(np.uint64)
        width *= 2
    return order[np.argsort(shard.astype(np.min_scalar_type(int(shard[-1])))[order], kind="stable")]


def merge_transforms(symbols: np.ndarray, before: np.ndarray, rows: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(merged rows, interval numbers): rows of one interval share their first `depth` symbols.

    `rows` are the shards' transforms one after the other as text places,
    `before` the place of the preceding symbol (an end's is its own string's end).
    A round takes two symbols, the transform's and the one before it, as one of 16 bits.
    """
    n = len(rows)
    place = np.empty(n, np.int64)  # row number of each text place in its shard's transform
    place[rows] = np.arange(n)
    one = before[rows]
    two = before[one]
    symbol = symbols[one].astype(np.uint16)  # the transform
    rounds = [(symbol, place[one])] * (depth % 2) + [(symbols[two].astype(np.uint16) << 8 | symbol, place[two])] * (depth // 2)
    # no end equals another
    ends = np.zeros(1 << 16, bool)
    ends[:256] = ends[::256] = True
    single = np.zeros(1 << 16, bool)
    single[0] = True
    interleave = np.arange(n)
    interval = np.zeros(n, np.int32)
    for i, (symbol, step) in enumerate(rounds):
        c = symbol.take(interleave)
        order = np.argsort(c, kind="stable")
        c, interval = c.take(order), interval.take(order)
        interleave = step.take(interleave.take(order))
        bound = np.empty(n, bool)
        bound[:1] = False
        np.not_equal(interval[1:], interval[:-1], out=bound[1:])
        bound[1:] |= c[1:] != c[:-1]
        bound[1:] |= (single if depth % 2 and not i else ends).take(c[1:])
        interval = np.cumsum(bound, dtype=np.int32)
    return rows[interleave], interval


def repeated(strings: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each string in turn: the smallest id of its interval; and each string's first window number."""
    length = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)  # ends become 0: 0xFF is in no UTF-8 text
    starts = np.concatenate([[0], np.cumsum(length + 1)])
    string = np.repeat(np.arange(len(strings)), length + 1)
    left = starts[1:][string] - 1 - np.arange(len(text))
    before = np.arange(-1, len(text) - 1)
    before[starts[:-1]] = starts[1:] - 1
    rows = shard_transform(text, string, left, string // SHARD_STRINGS)
    merged, interval = merge_transforms(text, before.astype(np.int32), rows)
    smallest = np.full(int(interval[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, interval, least[string[merged]])
    by_place = np.empty(len(text), np.int64)
    by_place[merged] = smallest[interval]
    return by_place[left >= LENGTH], np.concatenate([[0], np.cumsum(length - LENGTH + 1)])


def _spans(owner, mark, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (owner, mark, start, end)], ["owner", "mark", "start", "end"])


class _Group:
    """The occurrences of one group of anchors and its different strings."""

    def __init__(self, table: pa.Table):
        got = {name: np.concatenate([_unpack(v, kind) for v in table.column(name).to_pylist()] or [np.zeros(0, kind)]) for name, kind in _FIELDS.items()}
        self.got, self.text, self.length = got, got["text"], got["length"].astype(np.int64)
        self.at = np.cumsum(self.length) - self.length
        first = _first_equal(self.text, self.at, self.length, np.arange(len(self.at)))
        self.heads, self.number = np.unique(first, return_inverse=True)  # of each string: its first occurrence; of each occurrence: its string
        self.least = np.full(len(self.heads), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.number, got["owner"])
        place, grams = self.at[self.heads] + got["at"][self.heads], np.zeros(len(self.heads), np.uint64)
        for k in range(ANCHOR):
            grams = grams * _BASE + _SYMBOL[self.text[place + k]]
        # two anchors with one hash only make one larger group
        _, self.anchor = np.unique(grams, return_inverse=True)
        self.company = self._company(place)

    def _company(self, place: np.ndarray) -> np.ndarray:
        """For each string: how many may share a window with it, itself included. Equal windows hold equal anchors and one equal stretch around them."""
        most, start = np.ones(len(place), np.int64), self.at[self.heads]
        for before, after in STRETCHES:
            i = np.flatnonzero((place - before >= start) & (place + ANCHOR + after <= start + self.length[self.heads]))
            a = place[i] - before
            _, number, count = np.unique(_digests(self.text, a, a + before + ANCHOR + after), return_inverse=True, return_counts=True)
            most[i] = np.maximum(most[i], count[number])
        return most

    def strings(self, numbers: np.ndarray) -> list[bytes]:
        raw, heads = self.text.tobytes(), self.heads[numbers]
        return [raw[a:a + n] for a, n in zip(self.at[heads].tolist(), self.length[heads].tolist())]


def _merged(group: _Group, chunk: np.ndarray) -> pa.RecordBatch | None:
    """The spans to remove from the occurrences of the strings that `chunk` numbers."""
    owner, mark, start = group.got["owner"], group.got["mark"], group.got["start"].astype(np.int64)
    smallest, first = repeated(group.strings(chunk), group.least[chunk])
    place = np.full(len(group.heads), -1)
    place[chunk] = np.arange(len(chunk))
    of = np.flatnonzero(place[group.number] >= 0)
    s = place[group.number[of]]
    count = (first[1:] - first[:-1])[s]
    upto = np.cumsum(count)
    offset = np.arange(int(upto[-1])) - np.repeat(upto - count, count)
    row = np.repeat(np.arange(len(of)), count)
    hit = np.flatnonzero(smallest[first[s][row] + offset] < owner[of][row])
    if not len(hit):
        return None
    row, offset = row[hit], offset[hit]
    opens = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)]))
    closes = np.concatenate([opens[1:], [len(hit)]]) - 1
    i = of[row[opens]]
    return _spans(owner[i], mark[i], start[i] + offset[opens], start[i] + offset[closes] + LENGTH)


def group_spans(table: pa.Table, groups: int, chunk_bytes: int = CHUNK_BYTES) -> pa.Table:
    """Of one group of anchors, or of windows (parts from `groups` on): the spans to remove."""
    group = _Group(table)
    got, number, company = group.got, group.number, group.company
    owner, mark, start = got["owner"], got["mark"], got["start"].astype(np.int64)
    out = [_spans(got["done_owner"], got["done_mark"], got["done_start"], got["done_end"])]
    if not len(number):
        return pa.Table.from_batches(out)
    if table.column("part")[0].as_py() >= groups:  # windows are compared with equal ones only
        company = np.ones_like(company)
    alone = np.flatnonzero((company[number] == 1) & (group.least[number] < owner))
    out.append(_spans(owner[alone], mark[alone], start[alone], start[alone] + group.length[alone]))
    mixed = np.flatnonzero(company > 1)
    mixed = mixed[np.argsort(group.anchor[mixed], kind="stable")]
    filled = np.cumsum(group.length[group.heads[mixed]])
    a = 0
    while a < len(mixed):  # whole anchors, about `chunk_bytes` at once
        b = max(a + 1, int(np.searchsorted(filled, (filled[a - 1] if a else 0) + chunk_bytes, side="right")))
        b += int(np.searchsorted(group.anchor[mixed[b:]], group.anchor[mixed[b - 1]], side="right"))
        found = _merged(group, mixed[a:b])
        if found is not None:
            out.append(found)
        a = b
    return pa.Table.from_batches(out)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_STRINGS) -> DataFrame:
    """(owner, mark, spans): the byte spans to remove, by id and hash of the text."""
    kept = blocks(marked(docs, doc_id, text))
    size = kept.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    groups = max(GROUPS_PER_PARTITION * parts(docs), size // GROUP_BYTES)
    path, buckets = kept_classes(kept, groups, most)
    return by_text(kept_table(dealt(kept, path, buckets, groups).groupBy("part").applyInArrow(lambda t: group_spans(t, groups), SPANS), "spans"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_STRINGS) -> DataFrame:
    """doc_id, n_bytes, runs (array of start, end in bytes), kept (the remaining bytes) of every row."""
    return cut(docs, repeated_spans(docs, doc_id, text, most), doc_id, text)

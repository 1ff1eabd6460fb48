"""Phrase collocation mining with HAT-trie counting.

Texts are lower-cased (A to Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and into
words at spaces and tabs. Per language, phrases of 2 to `longest` words that
occur `least` times are scored by their weakest cut.

Counting (`count_phrases`): a task inserts windows of words into a `HatTrie`,
a shallow trie over word ids whose containers are hash tables that burst into
a node of smaller ones. When a task's tries hold `held` entries, whole subtrees
leave as sorted runs of (window, count) and their memory is free again. Spark
deals the runs by prefix, sorts each partition (a merge of sorted runs, which
spills), and a pass over the sorted rows adds up the windows that begin with
each phrase. A window travels once, not once for each length of phrase; only
its shortest phrase travels on its own, added up, so that a frequent one
doesn't draw all windows that begin with it into one partition.

A phrase can only be frequent if its parts are, so words are counted first.
Most pairs of frequent words are rare, so pairs are counted by hash before any
word of theirs travels (`frequent_pairs`, 2 to 3 bytes for each), and windows of
2 words and more are counted only along pairs whose hash is frequent.
Which words or pairs are frequent reaches the tasks as `Sketch`, a bit table
of fixed size (`SKETCH_BITS`, 8 MB at any input size) that never misses one and
may let a few others through: those are counted and then dropped by their
exact count. No phrase is cut off otherwise, at any size.

Scores are exact: products and quotients are 38-digit decimals.

Defined cases: null text is empty; null language is `und`; repeated rows
count again; an empty table gives an empty table; no columns but the two named
are read, so others may have any name. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.llm.common import flat_bytes, kept_table, slices

LONGEST, LEAST, PERCENT, TOP = 5, 100, 100, 2000
#: entries of a container above which it bursts, and of all containers of a task above which subtrees are spilled
BURST, HELD = 16_384, 800_000
#: bytes of text that enter the tries at once
COUNTED_BYTES = 6 << 20
SKETCH_BITS = 26
#: hashes of pairs that a task holds before they leave
PAIRS_HELD = 4 << 20
#: a group of hashes is what one call adds up: at least so many for each shuffle partition, and one for so many words
GROUPS_PER_PARTITION, GROUP_WORDS = 8, 1 << 20
SEGMENT_BITS = 16
TOP_SALTS = 32
#: what ends a word of a window that travels; it sorts before all others, so words that hold it are escaped
END, ESCAPES = "\0", ((b"\1", b"\1\2"), (b"\0", b"\1\1"))
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: its lower case, whether it ends a word, whether it ends a piece."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    ends_word, ends_piece = np.zeros(256, bool), np.zeros(256, bool)
    ends_word[list(BLANKS + BREAKS)] = True
    ends_piece[list(BREAKS)] = True
    return lower, ends_word, ends_piece


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(all words, number of the piece each is in, number of the text): pieces never cross texts."""
    lower, ends_word, ends_piece = _tables()
    data, offsets = flat_bytes(texts)
    data = lower[data]
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~ends_word[data]
    # a text's first byte begins a word even if the text before it ended in one
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~first[1:]
    sizes = np.flatnonzero(inside & ~after) + 1 - starts
    piece = np.cumsum(ends_piece[data] | first[:-1])[starts]
    kept = data[inside]
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32 if len(kept) < 2**31 else np.int64)
    kind = pa.binary() if places.dtype == np.int32 else pa.large_binary()
    words = pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(places), pa.py_buffer(kept)])
    return words, piece, np.searchsorted(offsets, starts, side="right") - 1


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, which depends on their order."""
    with np.errstate(over="ignore"):
        both = left * np.uint64(0x9E3779B97F4A7C15) ^ (right + np.uint64(0x7F4A7C159E3779B9)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return both ^ both >> np.uint64(29)


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)


class Sketch:
    """The hashes of frequent words or pairs, as a bit table of fixed size."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.size)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    """The hash of (language, words) that tasks compute from word hashes."""
    known = {lang: xxhash.xxh3_64_intdigest(lang.encode()) for lang in set(langs)}
    made = np.fromiter((known[lang] for lang in langs), np.uint64, len(langs))
    split = [phrase.encode().split(b" ") for phrase in phrases]
    for k in range(max(map(len, split), default=0)):
        has = np.flatnonzero(np.fromiter((len(words) > k for words in split), bool, len(split)))
        made[has] = mixed(made[has], word_hashes(split[i][k] for i in has.tolist()))
    return made


def make_sketch(phrases: DataFrame, size: int = SKETCH_BITS) -> Sketch:
    """From rows (lang, phrase), all of one length. What reaches the driver is the table of 2**size bits at most."""

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(phrase_hashes(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()) >> np.uint64(64 - size)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> SEGMENT_BITS, pa.int32()), pa.array(at & (1 << SEGMENT_BITS) - 1, pa.int32())], ["segment", "at"])

    return _sketch(phrases.select("lang", "phrase").mapInArrow(places, "segment int, at int"), size)


def _sketch(places: DataFrame, size: int) -> Sketch:
    """From rows (segment, at): the places of the bits that are set."""
    def filled(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << SEGMENT_BITS, np.uint8)
        bits[rows.column("at").to_numpy()] = 1
        return pa.table({"segment": rows.column("segment").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    table = np.zeros((1 << max(size - SEGMENT_BITS, 0), 1 << SEGMENT_BITS - 3), np.uint8)
    for row in places.distinct().groupBy("segment").applyInArrow(filled, "segment int, bits binary").collect():
        table[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return Sketch(table.ravel(), size)


def pair_hashes(langs: list[str], texts: pa.Array, words: Sketch) -> np.ndarray:
    """The hashes of (language, two neighbouring words of a piece), each occurrence, where both words may be frequent."""
    found, piece, text = words_of(texts)
    coded = found.dictionary_encode()
    codes, own = coded.indices.to_numpy(), word_hashes(coded.dictionary.to_pylist())
    languages, of_text = np.unique(np.array(langs, object), return_inverse=True)
    hashes = mixed(word_hashes(lang.encode() for lang in languages.tolist())[of_text[text]], own[codes])
    frequent = words.has(hashes)
    at = np.flatnonzero((piece[:-1] == piece[1:]) & frequent[:-1] & frequent[1:])
    return mixed(hashes[at], own[codes[at + 1]])


def _tallied(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in order, sum of the counts of each)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begins], np.diff(np.append(begins, len(keys))) if counts is None else np.add.reduceat(counts, begins)


def _zipped(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + (pa.compress(values.tobytes(), codec="zstd", asbytes=True) if len(values) else b"")


def _unzipped(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[:8], "little") * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b"", kind)


def frequent_pairs(rows: DataFrame, words: Sketch, least: int, occurrences: int, size: int = SKETCH_BITS, held: int = PAIRS_HELD) -> Sketch:
    """The hashes of pairs of `words` that occur at least `least` times, or whose hash does. `rows` hold `occurrences` words.

    A hash travels as the distance to the one before it in its group: sorted,
    they are close, the closer the more there are.
    """
    wanted = max(GROUPS_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), occurrences // GROUP_WORDS, 2)
    bits = (wanted - 1).bit_length()  # a group's number is the first bits of its hashes; the next 32 tell them apart
    shared = rows.sparkSession.sparkContext.broadcast((words.bits, words.size))

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = _tallied(np.concatenate(found))
        group = (keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])).tolist()
        short = (keys >> np.uint64(32 - bits)).astype(np.uint32)
        columns = [], [], [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            steps = np.diff(short[a:b], prepend=np.uint32(0))
            columns[0].append(int(group[a]))
            columns[1].append(steps.astype(np.uint16).tobytes())
            columns[2].append(_zipped((steps >> np.uint32(16)).astype(np.uint16)))
            columns[3].append(_zipped(np.minimum(counts[a:b], least).astype(np.uint32)))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["part", "low", "high", "counts"])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, found, n = Sketch(*shared.value), [], 0
        for batch in slices(batches, "text", COUNTED_BYTES):
            found.append(pair_hashes(batch.column("lang").to_pylist(), batch.column("text"), common))
            n += len(found[-1])
            if n > held:
                yield packed(found)
                found, n = [], 0
        if n:
            yield packed(found)

    def often(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for low, high, count in zip(*(table.column(name).to_pylist() for name in ("low", "high", "counts"))):
            steps = _unzipped(high, np.uint16).astype(np.uint32) << np.uint32(16) | np.frombuffer(low, np.uint16)
            keys.append(np.cumsum(steps, dtype=np.uint32))
            counts.append(_unzipped(count, np.uint32).astype(np.int64))
        different, sums = _tallied(np.concatenate(keys), np.concatenate(counts))
        whole = np.uint64(table.column("part")[0].as_py()) << np.uint64(64 - bits) | different[sums >= least].astype(np.uint64) << np.uint64(32 - bits)
        at = np.unique(whole >> np.uint64(64 - size)).astype(np.int64)
        return pa.table({"segment": pa.array(at >> SEGMENT_BITS, pa.int32()), "at": pa.array(at & (1 << SEGMENT_BITS) - 1, pa.int32())})

    dealt = rows.mapInArrow(hashed, "part int, low binary, high binary, counts binary")
    return _sketch(dealt.groupBy("part").applyInArrow(often, "segment int, at int"), size)


class HatTrie:
    """Counts of windows of word ids. Each edge of the trie is a word id.

    A child is a container (a hash table from the ids that are left to their
    count) or, once that has burst, a node of children; the root begins as a
    container. Ids are 4 bytes; a window that ends early is filled up with
    id 0, which no word has.
    """

    def __init__(self, burst: int = BURST):
        self.top, self.burst, self.entries = {0: ({}, None)}, burst, 0

    def add(self, windows: np.ndarray) -> None:
        """Count each row of `windows`, an (n, width) array of ids."""
        if not len(windows):
            return
        windows = windows[np.lexsort(windows.T[::-1])]
        begins = np.flatnonzero(np.concatenate([[True], (windows[1:] != windows[:-1]).any(axis=1)]))
        counts = np.diff(np.append(begins, len(windows))).tolist()
        width, flat = 4 * windows.shape[1], np.ascontiguousarray(windows[begins], "<u4").tobytes()
        self.entries += self._insert(self.top, 0, [flat[i:i + width] for i in range(0, len(flat), width)], counts)

    def _insert(self, node: dict, edge: int, keys: list[bytes], counts: list[int]) -> int:
        child = node.get(edge)
        if child is None:
            child = node[edge] = {}, None
        table, below = child
        if below is not None:
            return self._deal(below, keys, counts)
        had, get = len(table), table.get
        for key, count in zip(keys, counts):
            table[key] = get(key, 0) + count
        made = len(table) - had
        if len(table) > self.burst and len(keys[0]) > 4:
            below = {}
            for key, count in table.items():
                below.setdefault(key[:4], ({}, None))[0][key[4:]] = count
            node[edge] = {}, below
        return made

    def _deal(self, node: dict, keys: list[bytes], counts: list[int]) -> int:
        by_edge: dict[bytes, tuple[list, list]] = {}
        for key, count in zip(keys, counts):
            rest, some = by_edge.setdefault(key[:4], ([], []))
            rest.append(key[4:])
            some.append(count)
        return sum(self._insert(node, edge, rest, some) for edge, (rest, some) in by_edge.items())

    def spill(self, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take subtrees off the trie, largest first, until `most` entries are left: (windows, counts) of each."""
        root = self.top.setdefault(0, ({}, None))
        burst = root[1] is not None
        node = root[1] if burst else self.top
        sizes = {edge: _entries(child) for edge, child in node.items()}
        for edge in sorted(sizes, key=sizes.get, reverse=True):
            if not sizes[edge] or most is not None and self.entries <= most:
                return
            child = node.pop(edge)
            self.entries -= sizes[edge]
            keys, counts = [], []
            for key, count in _walk(child, edge if burst else b""):
                keys.append(key)
                counts.append(count)
            yield np.frombuffer(b"".join(keys), "<u4").reshape(len(keys), -1), np.array(counts, np.int64)


def _entries(child: tuple) -> int:
    table, below = child
    return len(table) if below is None else sum(map(_entries, below.values()))


def _walk(child: tuple, path: bytes) -> Iterator[tuple[bytes, int]]:
    table, below = child
    if below is None:
        for key, count in table.items():
            yield path + key, count
    else:
        for edge, deeper in below.items():
            yield from _walk(deeper, path + edge)


class _Counter:
    """One trie per language and the words that its ids stand for. `words` and `pairs` are what phrases may consist of."""

    def __init__(self, shortest: int, longest: int, words: Sketch | None, pairs: Sketch | None, held: int):
        self.shortest, self.longest, self.words, self.pairs, self.held = shortest, longest, words, pairs, held
        self.forget()

    def forget(self) -> None:
        self.ids, self.names, self.tries = {}, [b""], {}

    def _number(self, word: bytes) -> int:
        number = self.ids.get(word)
        if number is None:
            number = self.ids[word] = len(self.names)
            self.names.append(word)
        return number

    def add(self, langs: list[str], texts: pa.Array) -> None:
        words, piece, text = words_of(texts)
        languages, of_text = np.unique(np.array(langs, object), return_inverse=True)
        of_word = of_text[text]
        for i, lang in enumerate(languages.tolist()):
            own = np.flatnonzero(of_word == i)
            coded = words.take(pa.array(own)).dictionary_encode()
            different, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            known, hashes = np.zeros(len(different), np.int64), np.zeros(len(different), np.uint64)
            frequent = np.arange(len(different))
            if self.words:
                hashes = mixed(np.full(len(different), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64), word_hashes(different))
                frequent = np.flatnonzero(self.words.has(hashes))
            known[frequent] = [self._number(different[k]) for k in frequent.tolist()]
            after = np.fromiter((xxhash.xxh3_64_intdigest(different[k]) for k in frequent.tolist()), np.uint64, len(frequent)) if self.pairs else None
            own_hashes = np.zeros(len(different), np.uint64)
            if after is not None:
                own_hashes[frequent] = after
            self.tries.setdefault(lang, HatTrie()).add(self._windows(known[codes], piece[own], hashes[codes], own_hashes[codes]))

    def _windows(self, ids: np.ndarray, piece: np.ndarray, hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Windows of up to `longest` words from each position, cut where the piece ends or a part can't be frequent.

        `hashes` are those of (language, word), `own` of the words alone.
        """
        if self.longest == 1:
            return ids[:, None]
        # joined[i]: words i and i + 1 may stand in one frequent phrase
        joined = (piece[:-1] == piece[1:]) & (ids[:-1] > 0) & (ids[1:] > 0)
        if self.pairs:
            at = np.flatnonzero(joined)
            joined[at] = self.pairs.has(mixed(hashes[at], own[at + 1]))
        joined = np.concatenate([joined, np.zeros(self.longest, bool)])
        padded = np.concatenate([ids, np.zeros(self.longest, np.int64)])
        at = np.flatnonzero(np.logical_and.reduce([joined[k:k + len(ids)] for k in range(self.shortest - 1)]))
        windows, alive = np.zeros((len(at), self.longest), np.int64), np.ones(len(at), bool)
        for k in range(self.longest):
            if k:
                alive &= joined[at + k - 1]
            windows[:, k] = np.where(alive, padded[at + k], 0)
        return windows

    def full(self) -> bool:
        return sum(trie.entries for trie in self.tries.values()) > self.held or len(self.names) > self.held

    def runs(self, most: int | None) -> Iterator[pa.RecordBatch]:
        """Sorted runs of subtrees: (lang, phrase, count). Longer windows don't count for their first `shortest` words: those have rows of their own."""
        names = _escaped(pa.array(self.names, pa.large_binary()))
        for lang, trie in self.tries.items():
            parts, size = [], 0
            for windows, counts in trie.spill(most and most // len(self.tries)):
                parts.append((windows, counts))
                size += len(counts)
                if size > 100_000:
                    yield from self._run(lang, parts, names)
                    parts, size = [], 0
            if parts:
                yield from self._run(lang, parts, names)

    def _run(self, lang: str, parts: list, names: pa.Array) -> Iterator[pa.RecordBatch]:
        windows, counts = (np.concatenate(list(column)) for column in zip(*parts))
        if self.longest > self.shortest:
            first = windows[:, :self.shortest]
            order = np.lexsort(first.T[::-1])
            begins = np.flatnonzero(np.concatenate([[True], (first[order[1:]] != first[order[:-1]]).any(axis=1)]))
            longer = np.flatnonzero(windows[:, self.shortest] > 0)
            heads = np.zeros((len(begins), self.longest), windows.dtype)
            heads[:, :self.shortest] = first[order[begins]]
            windows, counts = np.concatenate([heads, windows[longer]]), np.concatenate([np.add.reduceat(counts[order], begins), counts[longer]])
        words, end = (windows > 0).sum(axis=1), pa.scalar(END, pa.large_string())
        for length in range(self.shortest, self.longest + 1):
            own = np.flatnonzero(words == length)
            if not len(own):
                continue
            columns = [names.take(pa.array(windows[own, k])).cast(pa.large_string()) for k in range(length)]
            phrase = pa.compute.binary_join_element_wise(*columns, end) if length > 1 else columns[0]
            order = pa.compute.sort_indices(phrase)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), phrase.take(order).cast(pa.string()),
                                              pa.array(counts[own]).take(order)], ["lang", "phrase", "count"])


def _escaped(names: pa.Array) -> pa.Array:
    """Words without `END`, in the same order."""
    for old, new in ESCAPES:
        names = pa.compute.replace_substring(names, old, new)
    return names


def _plain(word: str) -> str:
    for old, new in reversed(ESCAPES):
        word = word.replace(new.decode(), old.decode())
    return word


def _merge(batches: Iterable[pa.RecordBatch], shortest: int, longest: int, least: int) -> Iterator[pa.RecordBatch]:
    """Counts of all phrases that windows begin with, from windows sorted by (lang, phrase).

    Windows that share their first words are neighbours, so each length is a
    run of equal beginnings; the last one of a batch may go on in the next.
    Phrases of `shortest` words are counted by their own rows only.
    """
    names = ["lang", "phrase", "words", "f"]
    held: dict[int, tuple[tuple, int]] = {}

    def out(found: list[tuple[tuple, int]]) -> pa.RecordBatch:
        phrases = [" ".join(map(_plain, words)) for (_, words), _ in found]
        return pa.RecordBatch.from_arrays([pa.array([lang for (lang, _), _ in found], pa.string()), pa.array(phrases, pa.string()),
                                           pa.array([len(words) for (_, words), _ in found], pa.int32()), pa.array([f for _, f in found], pa.int64())], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        lang, split = batch.column("lang"), pa.compute.split_pattern(batch.column("phrase"), END)
        offsets = split.offsets.to_numpy()
        length, offsets = np.diff(offsets), offsets - offsets[0]
        coded = split.flatten().dictionary_encode()
        codes = np.zeros((batch.num_rows, longest), np.int64)  # 0 stands for no word
        codes[np.arange(longest) < length[:, None]] = coded.indices.to_numpy() + 1
        counts = batch.column("count").to_numpy()
        new = np.concatenate([[True], pa.compute.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)])
        found = []

        def named(row: int, size: int) -> tuple:
            return lang[row].as_py(), tuple(coded.dictionary[int(c) - 1].as_py() for c in codes[row, :size])

        for k in range(longest):
            new[1:] |= codes[1:, k] != codes[:-1, k]
            if k + 1 < shortest:
                continue
            begins = np.flatnonzero(new)
            sums = np.add.reduceat(np.where(length == shortest, counts, 0) if k + 1 == shortest else counts, begins)
            whole = codes[begins, k] > 0
            before = held.pop(k, None)
            if before:
                if whole[0] and before[0] == named(0, k + 1):
                    sums[0] += before[1]
                elif before[1] >= least:
                    found.append(before)
            if whole[-1]:
                held[k] = named(int(begins[-1]), k + 1), int(sums[-1])
            found += [(named(int(begins[i]), k + 1), int(sums[i])) for i in np.flatnonzero(whole[:-1] & (sums[:-1] >= least)).tolist()]
        if found:
            yield out(found)
    rest = [one for one in held.values() if one[1] >= least]
    if rest:
        yield out(rest)


def count_phrases(rows: DataFrame, shortest: int, longest: int, least: int, words: Sketch | None = None, pairs: Sketch | None = None,
                  held: int = HELD) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of `shortest` to `longest` words that occur at least `least` times.

    `rows` holds lang and text. Phrases consist of `words` and run along `pairs`, where these are given.
    """
    shared = rows.sparkSession.sparkContext.broadcast([s and (s.bits, s.size) for s in (words, pairs)])

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(shortest, longest, *(s and Sketch(*s) for s in shared.value), held)
        for batch in slices(batches, "text", COUNTED_BYTES):
            counter.add(batch.column("lang").to_pylist(), batch.column("text"))
            if counter.full():
                yield from counter.runs(held // 2)
                if len(counter.names) > held:
                    yield from counter.runs(None)
                    counter.forget()
        yield from counter.runs(None)

    prefix = F.substring_index("phrase", END, min(shortest + 1, longest))
    ordered = rows.mapInArrow(runs, "lang string, phrase string, count bigint").repartition("lang", prefix).sortWithinPartitions("lang", "phrase")
    return ordered.mapInArrow(lambda batches: _merge(batches, shortest, longest, least), "lang string, phrase string, words int, f bigint")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all frequent phrases of 1 to `longest` words, and (lang, n) with all word occurrences."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = kept_table(count_phrases(rows, 1, 1, 1), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = words.where(F.col("f") >= least)
    if longest > 1:
        common = make_sketch(found)
        pairs = frequent_pairs(rows, common, least, totals.agg(F.sum("n")).first()[0] or 0)
        found = found.union(kept_table(count_phrases(rows, 2, longest, least, common, pairs), "phrases"))
    return found, totals


def _part(words: Column, begin: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): frequent phrases by their weakest cut, without those that a longer phrase stands for.

    A phrase goes if a longer one that holds its words has at least `percent` per cent of its count.
    """
    found, totals = frequent_phrases(docs, text, lang, longest, least)
    several = found.where("words > 1").withColumn("w", F.split("phrase", " "))
    longer = several.where("words > 2")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("words") - size + 1), lambda begin: _part(F.col("w"), begin, size))))
    inside = longer.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("f").alias("above"))
    held = inside.groupBy("lang", "phrase").agg(F.max("above").alias("above"))
    left = several.join(held, ["lang", "phrase"], "left").where(F.col("above").isNull() | (100 * F.col("above") < percent * F.col("f"))).drop("above")
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("f"))
    cuts = left.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("head"), _part(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    whole = cuts.join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in "alrn"}
    scored = whole.select("lang", "phrase", "a", "k", "l", "r", "n", (F.lit(1000).cast("decimal(38,0)") * wide["a"] * wide["n"]).alias("over"), (wide["l"] * wide["r"]).alias("under"))
    best = scored.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase").agg(
        F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("best"))
    return best.select("lang", "phrase", "best.*")


def top_collocations(found: DataFrame, top: int = TOP, salts: int = TOP_SALTS) -> DataFrame:
    """The first `top` of each language by score, count and phrase, with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Near-duplicate detection by ProbMinHash.

A document is the multiset of its five-word shingles; a shingle's weight is
how often it occurs. Each shingle sends a Poisson process of arrivals, at a
rate equal to its weight, to random slots of the signature; a slot keeps the
shingle that arrives first, and a process stops as soon as it is later than
every slot of its document. The share of equal slots of two signatures
estimates their probability Jaccard

    J(x, y) = sum over common d of 1 / sum over d' of max(x[d'] / x[d], y[d'] / y[d]),

which is the Jaccard similarity where weights are equal. Slots are banded;
documents that share a band are candidates, and candidates are verified with
the exact measure on their whole texts.

Buckets are not expanded to pairs. Equal texts count once, and buckets with
the same members are one. The members of a bucket are compared with its
centre, the member that meets most others over all buckets: copies of one
text may be less similar to each other than to it. The links found make first
classes. A bucket whose members
are in one class is settled, since more links couldn't change it. In the
others each member outside the bucket's largest class is compared with the
members of other classes, so all similar texts of a bucket end in one class.
Of these pairs only those are verified whose signatures don't rule it out.
Classes are the connected components of the verified links.

Defined cases: a text of one to four words is one shingle; a text of none
(null, empty, white space) is linked only to equal texts; a null id has no
links and takes the class of an equal text, if any; repeated rows share a
class; different texts of one id are classed each for itself; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import flat_bytes, kept_table, slices, text_or_empty, unused
from gradeloom.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_SLOTS = 24, 5
SLOTS = BANDS * BAND_SLOTS
#: bytes of text that a task turns into shingles at once
SLICE = 1 << 20
#: low bits of the slots that are kept as a sketch, one byte each; pairs of the second step are verified only if
#: their sketches agree in at least this share of the slots (at similarity 0.8, fewer than 72 of 120 are more than 5 standard deviations away)
SKETCH_SHARE = 0.6
#: members of a bucket that one group of the second step holds, twice
BLOCK_MEMBERS = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SHINGLE_BITS = np.uint64(48)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown_powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: of the usual bases, filled where it is used: functions travel to workers by value, so each task has its own
_POWERS: dict[int, np.ndarray] = {}


def _kept_powers(base: np.uint64) -> np.ndarray:
    if int(base) not in _POWERS:
        _POWERS[int(base)] = _grown_powers(base, SLICE)
    return _POWERS[int(base)]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1; those that a usual slice needs are kept."""
    return _kept_powers(base)[:n] if n <= SLICE else _grown_powers(base, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the first word of each text and of the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:n] |= word[1:] != word[:-1]
    cuts = np.flatnonzero(edge[:n])
    cuts = cuts[word[cuts]]
    nexts = np.flatnonzero(edge)
    ends = nexts[np.searchsorted(nexts, cuts, side="right")]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, n), out=sums[1:])
    hashes = (sums[ends] - sums[cuts]) * powers(_INVERSE, n)[cuts] + (ends - cuts).astype(np.uint64)
    return mix64(hashes), np.searchsorted(cuts, offsets, side="left")


def shingles(texts: pa.Array, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 48-bit shingle, weight) sorted by text and shingle, and the number of words of each text.

    At most 65,536 texts at once.
    """
    w, first = word_hashes(*flat_bytes(texts))
    count = np.diff(first)
    full = len(w) - words + 1
    made, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(count)), count)
    if full > 0:
        h = np.zeros(full, np.uint64)
        for k in range(words):
            h = h * _STEP + w[k:k + full]
        inside = text_of[:full] == text_of[words - 1:]
        made, owner = mix64(h[inside]), text_of[:full][inside]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        h = np.full(len(short), 77, np.uint64)
        for k in range(words - 1):
            have = count[short] > k
            h[have] = h[have] * _STEP + w[first[short[have]] + k]
        made, owner = np.concatenate([made, mix64(h + count[short].astype(np.uint64))]), np.concatenate([owner, short])
    keys = np.sort(owner.astype(np.uint64) << _SHINGLE_BITS | made >> np.uint64(16))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    weight = np.diff(np.concatenate([new, [len(keys)]]))
    keys = keys[new]
    return (keys >> _SHINGLE_BITS).astype(np.int64), keys & np.uint64((1 << 48) - 1), weight.astype(np.float64), count


def signatures(texts: int, owner: np.ndarray, element: np.ndarray, weight: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash: signature[text, slot] is the shingle that arrives first in the slot (0 where a text has none)."""
    q = np.full(texts * slots, np.inf)
    z = np.zeros(texts * slots, np.uint64)
    stream, time, rate, own = mix64(element + np.uint64(1)), np.zeros(len(element)), weight, owner
    name = element
    while len(stream):
        stream = mix64(stream + _STEP)
        time = time - np.log(((stream >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        at = own * slots + (mix64(stream ^ _BASE) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(q, at, time)
        won = q[at] == time
        z[at[won]] = name[won]
        latest = q.reshape(texts, slots).max(axis=1)
        go = time < latest[own]
        stream, time, rate, own, name = stream[go], time[go], rate[go], own[go], name[go]
    return z.reshape(texts, slots)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(len(signature), bands, -1)
    h = np.broadcast_to(mix64(np.arange(bands, dtype=np.uint64)), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        h = mix64(h * _STEP + rows[:, :, k])
    return h.view(np.int64)


def probability_jaccard(e1: np.ndarray, w1: np.ndarray, e2: np.ndarray, w2: np.ndarray) -> float:
    """Exact, over sorted shingles with their weights."""
    union = np.union1d(e1, e2)
    if not len(union):
        return 0.0
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, e1)] = w1
    y[np.searchsorted(union, e2)] = w2
    with np.errstate(divide="ignore"):
        ratio = y / x
    values, group = np.unique(ratio, return_inverse=True)
    upto = np.cumsum(np.bincount(group, x, len(values)))
    beyond = y.sum() - np.cumsum(np.bincount(group, y, len(values)))
    common = (x > 0) & (y > 0)
    g = group[common]
    return float((1 / (upto[g] / x[common] + beyond[g] / y[common])).sum())


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, copy_key (of the text), bands (empty for a text without words), sketch (a byte of each slot)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            owner, element, weight, words = shingles(batch.column("text"))
            slots = signatures(batch.num_rows, owner, element, weight)
            keys = band_keys(slots)
            has = np.repeat(words > 0, BANDS)
            ends = np.concatenate([[0], np.cumsum(np.where(words > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()[has]))
            sketch = pa.array([row.tobytes() for row in slots.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copy_key"), bands, sketch], ["id", "copy_key", "bands", "sketch"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), text_or_empty(text).alias("text"))
    return (rows.select("id", "text", F.unhex(F.md5("text")).alias("copy_key"))
            .mapInArrow(run, "id bigint, copy_key binary, bands array<bigint>, sketch binary"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of ids by the exact measure on whole texts; `texts` is (id, text), ids unique."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide in slices(batches, "text_a", SLICE):
            for batch in slices([wide], "text_b", SLICE):
                (o1, e1, w1, _), (o2, e2, w2, _) = shingles(batch.column("text_a")), shingles(batch.column("text_b"))
                rows = np.arange(batch.num_rows + 1)
                c1, c2 = np.searchsorted(o1, rows), np.searchsorted(o2, rows)
                found = [probability_jaccard(e1[c1[i]:c1[i + 1]], w1[c1[i]:c1[i + 1]], e2[c2[i]:c2[i + 1]], w2[c2[i]:c2[i + 1]])
                         for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def _different(members: DataFrame) -> DataFrame:
    """(key, id) members of one of the buckets with the same members, for buckets of two and more."""
    sets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s"),
                                      F.bit_xor(F.xxhash64("id", F.lit("again"))).alias("x"))
    one = sets.where("n > 1").groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key")
    return members.join(one, "key")


def _apart(rest: DataFrame, texts: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Verified links (a, b) between members of one bucket that are in different classes; rest: (key, id, root, minor, n).

    Members are dealt to blocks of about `BLOCK_MEMBERS`, and a block meets
    each other block of its bucket in one group, so a group is bounded and
    what is shuffled grows with members times blocks, not with pairs. Pairs
    are compared by sketch first, and only in the first bucket they share.
    """
    count = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = (rest.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(every))
             .select("key", "id", "root", "minor", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block"))
    # the buckets of this step at their places among the bands; elsewhere the id, which no other member has
    places = rest.groupBy("id").agg(F.collect_set("key").alias("open"))
    here = F.transform("bands", lambda b: F.when(F.array_contains("open", b), b).otherwise(F.col("id")))
    known = sketches.join(places, "id").withColumn("bands", here).drop("open").join(texts, "id")
    wide = dealt.join(known, "id")
    least = similarity - 1e-9

    def run(group: pa.Table) -> pa.Table:
        found_a, found_b = [], []
        group = group.sort_by("id")
        key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
        ids, root, block = (group.column(c).to_numpy() for c in ("id", "root", "block"))
        minor = group.column("minor").to_numpy(zero_copy_only=False)
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        bands = np.array(group.column("bands").to_pylist(), np.int64).reshape(len(ids), -1)
        of_key = (bands == key).argmax(axis=1)
        text = group.column("text").combine_chunks()
        sets: dict[int, tuple] = {}

        def shingles_of(r: int) -> tuple:
            if r not in sets:
                _, e, w, _ = shingles(text.slice(r, 1))
                sets[r] = e, w
            return sets[r]

        for r in range(len(ids)):
            likely = (root[r + 1:] != root[r]) & (minor[r] | minor[r + 1:])
            if i != j:
                likely &= block[r + 1:] != block[r]
            others = np.flatnonzero(likely) + r + 1
            others = others[(sketch[others] == sketch[r]).mean(axis=1) >= SKETCH_SHARE]
            # another bucket that both are in earlier compares them
            others = others[~((bands[others] == bands[r])[:, :of_key[r]]).any(axis=1)] if of_key[r] else others
            for o in others.tolist():
                if probability_jaccard(*shingles_of(r), *shingles_of(o)) >= least:
                    found_a.append(ids[r]), found_b.append(ids[o])
        return pa.table([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return wide.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _links(members: DataFrame, texts: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Verified links that connect whatever is similar within a bucket; members: (key, id)."""
    least = similarity - 1e-9
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weights = members.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("weight"))
    centres = members.join(weights, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("centre"))
    star = members.join(centres, "key").where("id != centre").select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()
    first = kept_table(verified(star, texts), "near-similarities")
    roots = components(first.where(F.col("similarity") >= least).select("a", "b"))
    placed = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    shares = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    open_keys = (shares.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max_by("root", F.struct("n", "root")).alias("major"), F.sum("n").alias("n"))
                 .where("classes > 1").select("key", "major", "n"))
    rest = placed.join(open_keys, "key").select("key", "id", "root", (F.col("root") != F.col("major")).alias("minor"), "n")
    second = _apart(rest, texts, sketches, similarity)
    return first.where(F.col("similarity") >= least).select("a", "b").unionByName(second)


def _classed(docs: DataFrame, doc_id: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (id, copy_key) and different texts (copy_key, rep, n_copies, class_id, n_links, first).

    Nodes of the links are numbers of texts, not ids, since one id may have
    several texts. `rep` is the smallest id of a text, `class_id` of its
    class; `first` marks one text of each class, of the class's id.
    """
    marks = signed(docs, doc_id, text)
    signatures_of = marks.groupBy("copy_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"),
                                                  F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    texts_of = kept_table(signatures_of.withColumn("node", F.monotonically_increasing_id()), "near-signatures")
    linkable = texts_of.where("rep is not null")
    members = kept_table(_different(linkable.select(F.col("node").alias("id"), F.explode("bands").alias("key")).distinct()), "near-members")
    wanted = texts_of.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("copy_key", F.col("rep").alias("id"), "node")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), text_or_empty(text).alias("text")).withColumn("copy_key", F.unhex(F.md5("text")))
    # rows of the text's smallest id only, so few copies travel
    texts = kept_table(rows.join(wanted, ["id", "copy_key"]).select(F.col("node").alias("id"), "text").dropDuplicates(["id"]), "near-texts")
    sketches = linkable.select(F.col("node").alias("id"), "sketch", "bands")
    links = kept_table(_links(members, texts, sketches, similarity), "near-links")
    found = components(links)
    roots = kept_table(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "near-roots")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    narrow = texts_of.select("copy_key", "rep", "n_copies", "node")
    smallest = (narrow.select("node", "rep", "copy_key").join(roots, "node").groupBy("root")
                .agg(F.min(F.struct("rep", "copy_key")).alias("least"))
                .select("root", F.col("least.rep").alias("class_id"), F.col("least.copy_key").alias("first_key")))
    placed = roots.join(smallest, "root").select("node", "class_id", "first_key")
    classes = (narrow.join(placed, "node", "left").join(ends, "node", "left")
               .select("copy_key", "rep", "n_copies", F.coalesce("class_id", "rep").alias("class_id"),
                       F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                       (F.coalesce("first_key", "copy_key") == F.col("copy_key")).alias("first")))
    return rows.select("id", "copy_key"), classes


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, class_id (the smallest id of its class), n_copies (rows of equal text), n_links (verified links of its text)."""
    rows, classes = _classed(docs, doc_id, text, similarity)
    return rows.join(classes, "copy_key").select(F.col("id").alias("doc_id"), "class_id", "n_copies", "n_links")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that hold the first text of their class under its smallest id.

    Rows go by id and text, so another text of the same id stays or goes for
    itself. Rows without an id stay where their text has no id at all. Rows
    that repeat id and text stay together (exact deduplication is for them).
    """
    _, classes = _classed(docs, doc_id, text, similarity)
    key, rep = unused(docs, "__key"), unused(docs, "__rep")
    stay = classes.where("first").select(F.col("copy_key").alias(key), F.col("rep").alias(rep))
    same = (F.unhex(F.md5(text_or_empty(text))) == F.col(key)) & F.col(doc_id).cast("bigint").eqNullSafe(F.col(rep))
    return docs.join(stay, same, "left_semi")

"""Exact, near and substring duplicates, language and tokens against brute force on small tables."""

import hashlib
import random
import struct
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gradeloom.llm import bpe, exact_dedup, language_id, minhash, queries, substring_dedup, suffix_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, digest int, key string, owner string, mark int"
PATH = public_tokenizers.path(queries.RANK_FILE)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    a, b, passage = words(1, 120), words(2, 90), words(3, 60)
    near = a.split()
    near[60] = "changed"
    texts = [a, a, a + " \n", " ".join(near), b, "", None, " \t\n", "one two", "one  two", "été", passage, words(4, 50) + " " + passage, passage + words(5, 40),
             words(6, 4000), "x" * 3000, "one two", words(7, 20) + " <|endoftext|> 'll don't 　 12345 \U0001F600"]
    rows = [(i, t, "en", "s", None, "id", 1, "k", "o", 2) for i, t in enumerate(texts)]
    rows += [(None, a, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None),
             (1, a, "en", "s", None, "id", 1, "k", "o", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def raw(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.md5(F.length(c).cast("string"))])
def test_exact_groups(docs, digest):
    got = exact_dedup.assign(docs, digest=digest).collect()
    groups = defaultdict(list)
    for i, t in raw(docs):
        groups["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((-len(t), i is None, i or 0, i))
    assert len(got) == docs.count()
    keep = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[3], len(v)) for k, v in groups.items()}
    assert all((r["keep_id"], r["group_size"]) == keep[r["text_sha256"]] for r in got)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(keep.keys())


def test_exact_dedup_keeps_whole_rows(docs):
    left = exact_dedup.dedup(docs)
    assert left.columns == docs.columns
    assert {"".join((r["text"] or "").split()) for r in left.collect()} == {"".join(t.split()) for _, t in raw(docs)}


def test_names_of_helper_columns_may_be_taken(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g", 1, "x", 2, 3), (1, "a b c d e f g", 1, "x", 2, 3), (2, "other text", 1, "x", 2, 3)],
                                 "doc_id bigint, text string, __ID bigint, __sha string, __key int, __rep int")
    assert sorted(r["doc_id"] for r in exact_dedup.dedup(rows).collect()) == [1, 2]
    left = minhash.dedup(rows.dropDuplicates())
    assert left.columns == rows.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2]


def test_exact_dedup_keeps_one_row_of_repeated_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (1, "b a", "z"), (1, "ba", "z"), (2, "a b ", "w"), (2, "a b ", "w"), (3, "once", "v"),
            (None, "no id", None), (None, "no id", None), (None, None, "u"), (None, "", "t"), (4, "ab", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    left = [tuple(r) for r in exact_dedup.dedup(df).collect()]
    assert set(left) <= set(rows)
    kept = Counter((r["doc_id"], r["points"]) for r in exact_dedup.assign(df).where("kept").collect())
    assert Counter((r[0], len(r[1] or "")) for r in left) == kept == Counter([(2, 4), (1, 3), (3, 4), (None, 5), (None, 0)])


def test_exact_clash_of_both_digests_fails(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    rows = exact_dedup.winners(df, digest=lambda c: F.md5(F.lit("same")))
    assert rows.count() == 2  # marks still tell them apart


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = t.encode().split()
        sets.setdefault((i, t), Counter(b" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4)) if w))
    keys = [k for k in sets if k[0] is not None]
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for m, x in enumerate(keys):
        for y in keys[:m]:
            p, q = sets[x], sets[y]
            u = set(p) | set(q)
            j = sum(1 / sum(max(p[e] / p[d], q[e] / q[d]) for e in u) for d in p if d in q)
            if x[1] == y[1] or j >= 0.8 - 1e-9:
                s, t = sorted((find(x), find(y)))
                root[t] = s
    return {k: min(j[0] for j in keys if find(j) == find(k)) for k in keys}


def test_near_classes(docs):
    want = brute_classes(raw(docs))
    text_of = defaultdict(set)
    for i, t in raw(docs):
        text_of[i].add(t)
    got = minhash.near_classes(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert r["class_id"] in {want[r["doc_id"], t] for t in text_of[r["doc_id"]]}
    assert Counter(r["class_id"] for r in got if r["doc_id"] in (0, 1, 2, 3)) == {0: 5}


def test_near_bucket_with_dissimilar_members_loses_no_link(spark):
    """Texts between two centres: neighbours are similar, ends are not; all are one class."""
    base = words(11, 400).split()
    rows = []
    for k in range(12):
        text = list(base)
        for j in range(8 * k):
            text[j * 4 % 400] = f"new{j}"
        rows.append((k, " ".join(text)))
    rows += [(100 + k, words(50 + k, 100)) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(df).collect()}
    assert got == {k[0]: v for k, v in brute_classes(rows).items()}
    assert sorted(r["doc_id"] for r in minhash.dedup(df).collect()) == sorted(set(got.values()))


def test_near_texts_of_one_id_are_classed_each_for_itself(spark):
    def near(text):
        return " ".join("changed" if i == 60 else w for i, w in enumerate(text.split()))

    a, b = words(21, 120), words(22, 120)
    df = spark.createDataFrame([(1, a), (2, near(a)), (2, b), (3, near(b)), (3, a), (None, b), (None, "alone")], "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["class_id"]) for r in minhash.near_classes(df).collect())
    assert got == Counter([(1, 1), (2, 1), (2, 2), (3, 2), (3, 1), (None, 2), (None, None)])
    assert Counter((r["doc_id"], r["text"]) for r in minhash.dedup(df).collect()) == Counter([(1, a), (2, b), (None, "alone")])


def test_weighted_measure_and_estimate():
    import numpy as np
    import pyarrow as pa
    x, y = words(21, 60), words(21, 60).replace(" ", " ", 1) + " " + words(22, 8)
    for a, b in ((x + " " + x, y), (x, x), (x, words(23, 30)), (x, y)):
        owner, e, w, _ = minhash.shingles(pa.array([a, b]))
        j = minhash.probability_jaccard(e[owner == 0], w[owner == 0], e[owner == 1], w[owner == 1])
        slots = minhash.signatures(2, owner, e, w, 2048)
        assert abs(float(np.mean(slots[0] == slots[1])) - j) < 0.06


def brute_cut(rows, length):
    seen, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = t.encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p:p + length], i)
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and seen[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        out[i, t] = bytes(c for c, g in zip(b, gone) if not g)
    return out


@pytest.mark.parametrize("most", [suffix_dedup.MOST_STRINGS, 1])
def test_merged_transforms_remove_what_brute_force_removes(docs, most):
    want = brute_cut(raw(docs), suffix_dedup.LENGTH)
    got = suffix_dedup.remove_repeats(docs, most=most).collect()
    assert Counter((r["doc_id"], bytes(r["kept"])) for r in got) == Counter((i, want[i, t]) for i, t in raw(docs))
    assert all(r["n_bytes"] - sum(s["end"] - s["start"] for s in r["runs"]) == len(r["kept"]) for r in got)


def test_a_crowded_anchor_and_identical_rows(spark):
    """A phrase in changing contexts, repeated passages around it, and one text in a thousand equal rows."""
    rng, phrase = random.Random(8), "a phrase that everybody uses again"
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    contexts = [letters(40) for _ in range(30)]
    rows = [(i, letters(30) + rng.choice(contexts) + phrase + rng.choice(contexts) + letters(20)) for i in range(600)]
    rows += [(700, rows[0][1] + letters(300))] * 1000
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    want = brute_cut(rows, suffix_dedup.LENGTH)
    for most in (40, suffix_dedup.MOST_STRINGS):
        got = suffix_dedup.remove_repeats(df, most=most).collect()
        assert Counter((r["doc_id"], bytes(r["kept"])) for r in got) == Counter((i, want[i, t]) for i, t in rows)
    spans = suffix_dedup.repeated_spans(df, most=40).where("owner = 700").first()["spans"]
    assert len(spans) <= len(rows[-1][1])


def test_segments_do_not_depend_on_how_many_windows_are_read_at_once(monkeypatch):
    import numpy as np
    rng = np.random.default_rng(3)
    sizes = [0, 49, 50, 0, 700, 51, 3, 0, 1200, 130, 0]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = rng.integers(97, 101, offsets[-1]).astype(np.uint8)
    data[400:600] = 97
    data[900:1000] = data[200:300]
    grams = suffix_dedup._gram_hashes(data, suffix_dedup.ANCHOR) >> np.uint64(24)
    want = []
    for text, size in enumerate(sizes):
        for w in range(offsets[text], offsets[text] + size - suffix_dedup.LENGTH + 1):
            at = w + int(np.argmin(grams[w:w + suffix_dedup.LENGTH - suffix_dedup.ANCHOR + 1]))
            if want and want[-1][0] == text and want[-1][3] == at:
                want[-1][2] += 1
            else:
                want.append([text, w, w + suffix_dedup.LENGTH, at])
    for piece in (1, 7, 50, 1 << 16):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        *places, key = suffix_dedup.segments(data, offsets)
        assert np.stack(places, axis=1).tolist() == want
        assert (key >> np.uint64(24) == grams[places[3]]).all()


def test_strings_that_share_an_anchor_but_no_window_are_not_merged():
    import numpy as np
    import pyarrow as pa
    rng, anchor = random.Random(9), b"the anchor of 20 byt"
    letters = lambda n: bytes(rng.choice(b"abcdefghij") for _ in range(n))
    shared = letters(10) + anchor + letters(20)
    strings = [letters(30) + anchor + letters(30) for _ in range(40)] + [letters(5) + shared + letters(5), letters(20) + shared]
    at = [30] * 40 + [15, 30]
    values = {"owner": np.arange(42), "mark": np.arange(42), "start": np.zeros(42, np.uint32), "length": np.array([len(s) for s in strings], np.uint8),
              "at": np.array(at, np.uint8), "text": np.frombuffer(b"".join(strings), np.uint8)}
    packed = {name: pa.array([suffix_dedup._pack(values.get(name, np.zeros(0, kind)))], pa.binary()) for name, kind in suffix_dedup._FIELDS.items()}
    table = pa.table({"part": pa.array([0], pa.int32()), **packed})
    company = suffix_dedup._Group(table).company
    assert company[:40].tolist() == [1] * 40 and (company[40:] > 1).all()
    assert [tuple(r.values()) for r in suffix_dedup.group_spans(table, 8).to_pylist()] == [(41, 41, 20, 70)]


@pytest.mark.parametrize("depth", [5, 6])
def test_interleave_at_even_and_odd_depths(depth):
    import numpy as np
    rng = np.random.default_rng(depth)
    strings = [bytes(rng.integers(97, 99, rng.integers(1, 12)).astype(np.uint8)) for _ in range(60)]
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    length = np.array([len(s) for s in strings])
    starts = np.concatenate([[0], np.cumsum(length + 1)])
    before = np.arange(-1, len(text) - 1)
    before[starts[:-1]] = starts[1:] - 1
    merged, interval = suffix_dedup.merge_transforms(text, before, rng.permutation(len(text)), depth)
    number = dict(zip(merged.tolist(), interval.tolist()))
    whole = [(p + starts[i], s[p:p + depth]) for i, s in enumerate(strings) for p in range(len(s) - depth + 1)]
    assert sorted(merged.tolist()) == list(range(len(text)))
    assert len({number[p] for p, _ in whole}) == len({s for _, s in whole}) == len({(number[p], s) for p, s in whole})


def test_interleave_equals_sorted_suffixes():
    import numpy as np
    rng = random.Random(5)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 80))).encode() for _ in range(700)]
    least = np.arange(700)
    smallest, first = suffix_dedup.repeated(strings, least)
    want = {}
    for i, s in enumerate(strings):
        for k in range(len(s) - 49):
            want.setdefault(s[k:k + 50], i)
    assert [want[s[k:k + 50]] for s in strings for k in range(len(s) - 49)] == smallest.tolist()


def test_chunks_find_shifted_passages_and_leave_the_rest(docs):
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect() if r["doc_id"] not in (None, 1)}
    assert not got[11]["runs"] and got[12]["runs"] and got[13]["runs"]
    assert not got[0]["runs"] and not got[4]["runs"] and not got[14]["runs"] and not got[6]["runs"]
    by_id = {i: t.encode() for i, t in raw(docs) if i is not None}
    for i, r in got.items():
        for s in r["runs"]:
            assert any(by_id[i][s["start"]:s["end"]][:substring_dedup.LEAST] in by_id[j] for j in by_id if j < i)


def test_gear_hash_rolls():
    import numpy as np
    data = np.frombuffer(words(31, 200).encode(), np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(substring_dedup._GEAR[b])) & 0xFFFF
        want.append(h)
    assert substring_dedup.gear_hashes(data)[16:].tolist() == want[16:]


def test_tokens_equal_the_library_and_decode(docs):
    ranks = bpe.read_ranks(PATH)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    done = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit(1)), PATH, public_tokenizers.PATTERN), PATH)
    for r in done.collect():
        ids = own.encode_ordinary(r["text"] or "")
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    wanted = sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"]), bytes(r["decoded"]), True) for r in done.collect())
    whole = bpe.round_trip(docs.withColumn("same", F.lit(0)).select("doc_id", "text", "same"), PATH, public_tokenizers.PATTERN)
    assert whole.columns == ["doc_id", "ids", "decoded", "same"]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"]), bytes(r["decoded"]), r["same"]) for r in whole.collect()) == wanted
    assert bpe.round_trip(docs.select("text").limit(0), PATH, public_tokenizers.PATTERN, decoded=None).collect() == []


def test_every_token_is_reached_by_merges():
    ranks = bpe.read_ranks(PATH)
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_proto=bpe.serialise(ranks))
    assert [t for t in ranks if model.encode(bpe.mapped(t)) != [ranks[t]]] == []
    with pytest.raises(ValueError):
        bpe.serialise({b"a": 1})
    assert bpe._decoder(ranks)(None) == b""


def test_phrases_equal_a_plain_parse():
    sample = (("a", "the cat sat on the mat. the dog"), ("b", "die katze sitzt auf der matte"))
    parser = language_id.Parser(sample)
    texts = ["the cat sat", "die katze", "zzz the zzz", "q", "the mat the matte auf", "ö"] * 20

    def phrases(text, known):
        n = i = 0
        while i < len(text):
            k = 1
            while i + k <= len(text) and text[i:i + k] in known:
                k += 1
            i += max(1, k - 1)
            n += 1
        return n

    want = [[phrases(t, s) for _, s in sample] for t in texts]
    assert parser.counts(texts).tolist() == want
    assert parser.counts(texts[:3]).tolist() == want[:3]


def test_languages(spark):
    text = {"en": "the quick brown fox jumps over the lazy dog and runs away from the old house ", "de": "der schnelle braune fuchs springt über den faulen hund und rennt davon "}
    rows = [(i, text[k] * (1 + i % 3), k, "x") for i in range(40) for k in text]
    rows += [(900, None, "en", "x"), (901, "123 !!", "en", "x"), (None, "the dog", "en", "x"), (902, "der hund und der fuchs", None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    sample = language_id.learn(df.where(language_id.fold_number() != 0))
    got = language_id.identify(df, sample).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (900, 901):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == (r["lang"] or "de") and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in language_id.identify(df, ()).collect()} == {"und"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert exact_dedup.assign(none).count() == 0
    assert minhash.near_classes(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert language_id.identify(none, language_id.learn(none)).count() == 0
    assert bpe.encode(none, PATH, public_tokenizers.PATTERN).count() == 0


def test_language_sample_holds_different_texts(spark):
    texts = [words(300 + i, 200) for i in range(30)]
    # the hundred copies are of the text that ranks first
    order = F.when(F.col("text") == texts[0], 0).otherwise(F.xxhash64("text").bitwiseAND(F.lit(1 << 40)) + 1)
    df = spark.createDataFrame([(t, "en") for t in [texts[0]] * 100 + texts], "text string, lang string")
    ((_, sample),) = language_id.learn(df, order=order)
    pieces = [sample[i:i + language_id.PIECE_CHARACTERS] for i in range(0, len(sample), language_id.PIECE_CHARACTERS)]
    assert len(pieces) == len(set(pieces)) == 30 and all(any(p in t for t in texts) for p in pieces)


def test_languages_with_many_characters_are_told_apart(spark):
    """Three languages of 600 own characters each: every character of a sample can match."""
    rng = random.Random(5)
    def text(first, n):
        return "".join(chr(first + min(int(rng.expovariate(0.01)), 599)) for _ in range(n))
    firsts = {"aa": 0x4E00, "ja": 0x6000, "ko": 0xAC00}
    sample = tuple((k, text(v, 6000)) for k, v in firsts.items())
    parser = language_id.Parser(sample)
    assert parser.predict([text(v, n) for v in firsts.values() for n in (20, 200)])[0] == [k for k in firsts for _ in range(2)]

    def phrases(t, source):
        n = i = 0
        while i < len(t):
            k = 1
            while i + k < len(t) and t[i:i + k + 1] in source:
                k += 1
            n, i = n + 1, i + k
        return n
    mixed = [text(v, 40) + "\u3042" + text(0x6000, 30) + sample[0][1][100:130] for v in firsts.values()] + ["x", "", "\uac00\u3042\u3042"]
    assert parser.counts(mixed).tolist() == [[phrases(t, source) for _, source in sample] for t in mixed]
    assert parser.counts(mixed * 20).tolist() == parser.counts(mixed).tolist() * 20

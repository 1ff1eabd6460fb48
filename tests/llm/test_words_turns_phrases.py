"""Word table BPE, conversation repair and phrase mining against the library or brute force on small tables."""

import hashlib
import json
import random
import re
import struct
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradeloom.llm import collocations, turn_repair, word_table

WORDS = public_tokenizers.path("byte_bpe_50k.json")
CLASHES = "ids string, block string, row string, codes int, bucket string"


def own_tokens(text):
    tokenizer = Tokenizer.from_file(WORDS)
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids), tokenizer.decode(ids, skip_special_tokens=False).encode()


TEXTS = [None, "", " ", "  \n\t ", "don't we'll I'd've 's 'S ''s  's\t's it's's", "a  <|endoftext|>  b<|endoftext|><|endoftext|>c <|endoftext", "tail   ",
         "\u0558x \u4e00\u4e8c \U0001F600 \U0001fa89 \u00e9t\u00e9 \u00bd12\u0663 \u00a0\u3000x\u2028\u2028 y", "x" * 20000, "word " * 30000, "\x00\x1c\x85 a\r\n\r\nb",
         "don't we'll I'd've 's 'S ''s  's\t's it's's", "1st 2nd!!! (a) --b -- c"]


def test_word_table_equals_the_library(spark):
    rows = [(i, t, "i", "b", "r", 1, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None, None, None, None), (0, None, "i", "b", "r", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + CLASHES).repartition(3).cache()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, *own_tokens(r["text"])) for r in docs.collect())
    for limits in ({}, {"block_bytes": 1, "buckets": 3}, {"buckets": 1}):
        done = word_table.encode(docs, WORDS, **limits)
        assert done.columns == ["doc_id", "block", "row", "codes", "bucket", "ids", "decoded"]
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"]), bytes(r["decoded"])) for r in done.collect()) == want
    again = word_table.decode(word_table.encode(docs.select("text"), WORDS, decoded="was"), WORDS)
    assert all(r["was"] == r["decoded"] for r in again.collect())
    assert word_table.encode(docs.where("false"), WORDS).collect() == []
    assert word_table.decode(spark.createDataFrame([(None,)], "ids binary"), WORDS).first()["decoded"] == b""


def test_split_equals_the_library_on_each_character_of_the_same_classes():
    splitter, by_library = word_table.Splitter(WORDS), Tokenizer.from_file(WORDS).pre_tokenizer.pre_tokenize_str
    same = re.findall(f"[{word_table.SAME_CLASSES}]", "".join(chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000))
    assert len(same) > 30000
    for some in (same[i:i + 2000] for i in range(0, len(same), 2000)):
        text = "\x00".join(f"a{c}1{c}!{c} {c}x  {c}{c} \n{c}'s" for c in some)
        starts, counts = splitter.starts(pa.array([text]))
        assert starts.tolist() == [len(text[:a].encode()) for _, (a, _) in by_library(text)] if len(text) < 3000 else counts[0] == len(by_library(text))


def test_numbers_are_packed_and_unpacked():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**32 - 1])
    assert word_table.unpack(word_table.pack(numbers)).tolist() == numbers.tolist()
    assert word_table.unpack(word_table.pack(numbers[:0])).tolist() == []


def cheapest(turns):
    """Every alignment with every string of the grammar, by plain recursion."""
    best = None
    for size in [0, *range(2, 2 * len(turns) + 3)]:
        target = ("s" if size % 2 else "") + "ua" * (size // 2)

        @lru_cache(None)
        def go(r, t):
            if r == len(turns) and t == size:
                return 0, ""
            options = []
            if r < len(turns):
                cost, audit = go(r + 1, t)
                options.append((cost + 2, "D" + audit))
            if t < size and target[t] != "s":
                cost, audit = go(r, t + 1)
                options.append((cost + 5, "I" + audit))
            if r < len(turns) and t < size and turns[r] & 3 not in (1, 2):
                own, more = "sua-"[turns[r] >> 2], 5 if turns[r] & 3 == 3 else 0
                cost, audit = go(r + 1, t + 1)
                if own == target[t]:
                    options.append((cost + more, "K" + audit))
                elif target[t] != "s":
                    options.append((cost + more + 1, "R" + audit))
            return min(options, default=(10**9, ""))
        best = min(filter(None, [best, go(0, 0)]))
    return best


def test_alignments_are_the_cheapest_with_the_least_audit():
    rng = random.Random(2)
    for _ in range(600):
        turns = bytes(rng.choice([0, 4, 8, 4, 8, 12]) + rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randint(1, 9)))
        assert turn_repair.Alignment(turns).best() == turn_repair.Alignment(turns, whole_cells=1).best() == cheapest(turns), turns
    assert turn_repair.align(b"") == (0, "")


def test_a_long_conversation_is_aligned():
    turns = bytes([4, 8] * 1500 + [4, 4] + [8, 4] * 1000 + [8])
    cost, audit = turn_repair.align(turns)
    assert (cost, len(audit)) == (2, len(turns))


def repaired(rows):
    """The contract, row by row, for rows (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, codes, names = set(), [], []
    for turn, role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        fault = 1 if not words else 2 if (role, text) in seen else 3 if words[-1] not in ".!?" else 0
        seen.add((role, text))
        codes.append(4 * "sua".find(role[:1]) + fault if role[:1] and role[:1] in "sua" else 12 + fault)
        names.append(role[:1])
    cost, audit = cheapest(bytes(codes)) if codes else (0, "")
    kept, at, left = [], 0, len(audit) - audit.count("D")
    target = ("s" if left % 2 else "") + "ua" * (left // 2)
    for letter in audit:
        if letter != "D":
            role = {"u": "user", "a": "assistant", "s": "system"}[target[len(kept)]]
            kept.append(f"{rows[at][1] if letter == 'K' else role}:{'' if letter == 'I' else rows[at][2]}")
        at += letter != "I"
    turns = {r[0] for r in rows if r[0] is not None}
    faults = Counter(c & 3 for c in codes)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults[1], faults[2], faults[3],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(names, names[1:])), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_repairs_equal_a_plain_repair(spark):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(120)]:
        for _ in range(rng.randint(0, 7)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 4, 5, 9]), rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool"]),
                         rng.choice(["One.", "Two!", "cut", "", " \t", None, "Three? \n", "\u00e9t\u00e9.", "One."]), "x"))
    rows += [(500, 1, "user", "Hi.", "x")] * 3
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, digest string").repartition(3)
    spoilt = turn_repair.damaged(turns)
    groups = {}
    for r in spoilt.collect():
        own = groups.setdefault(r["conv_id"], [])
        if not r["dropped"]:
            own.append((r["turn"], r["role"], r["text"]))
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair(spoilt).collect()}
    assert got == {conv: repaired(own) for conv, own in groups.items()}
    assert set(got) == {r[0] for r in rows}
    assert turn_repair.repair(turn_repair.damaged(turns.limit(0))).collect() == []


def plain_collocations(rows, longest, least, percent):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for i in range(len(words)):
                for n in range(1, longest + 1):
                    if i + n <= len(words):
                        key = lang or "und", tuple(words[i:i + n])
                        counts[key] = counts.get(key, 0) + 1
    out = set()
    frequent = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= least}
    for (lang, words), a in frequent.items():
        n = len(words)
        if any(l == lang and len(w) > n and 100 * f >= percent * a and any(w[i:i + n] == words for i in range(len(w) - n + 1)) for (l, w), f in frequent.items()):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, n)]
        score, k = min(cuts)
        out.add((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score))
    return out


def test_collocations_equal_plain_counts(spark):
    rng = random.Random(4)
    words = ["The", "cat", "sat", "on", "mat", "\u00c9t\u00e9", "na\u00efve", "x", "0"]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", None), ("fr", ""), ("fr", "cat"), ("fr", "the"), ("en", "the cat sat on mat " * 4000)] + [("en", "a rare phrase here")] * 9
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "lang string, text string, phrase string, f int").repartition(3).cache()
    for longest, least, percent in ((5, 8, 100), (3, 3, 60), (2, 1, 100)):
        got = collocations.collocations(docs, longest=longest, least=least, percent=percent)
        assert {tuple(r) for r in got.collect()} == plain_collocations(rows, longest, least, percent)
    found = collocations.collocations(docs, least=8)
    want = {}
    for r in sorted(map(tuple, found.collect()), key=lambda r: (r[0], -r[6], -r[2], r[1].encode())):
        want.setdefault(r[0], []).append(r)
    got = collocations.top_collocations(found, top=3, salts=2).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"]) for r in got) == [(lang, i, r[1]) for lang in sorted(want) for i, r in enumerate(want[lang][:3], 1)]
    assert collocations.collocations(docs.where("false")).collect() == []


def test_tries_burst_and_spill_whole_subtrees():
    rng = np.random.default_rng(1)
    windows = rng.integers(1, 30, (20000, 4))
    windows[rng.random(20000) < 0.3, 3] = 0
    trie = collocations.HatTrie(burst=50)
    spilled = Counter()
    for part in np.array_split(windows, 7):
        trie.add(part)
        for keys, counts in trie.spill(most=2000):
            for key, count in zip(keys.tolist(), counts.tolist()):
                spilled[tuple(key)] += count
        assert trie.entries <= 2000
    for keys, counts in trie.spill():
        for key, count in zip(keys.tolist(), counts.tolist()):
            spilled[tuple(key)] += count
    assert trie.entries == 0 and spilled == Counter(map(tuple, windows.tolist()))


def test_runs_spilled_early_give_the_same_counts(spark):
    texts = [("en", " ".join(random.Random(i).choices("abcdefg", k=80))) for i in range(40)]
    rows = spark.createDataFrame(texts, "lang string, text string").repartition(2)
    found = {held: {tuple(r) for r in collocations.count_phrases(rows, 2, 2, 2, held=held).collect()} for held in (10, 10**6)}
    assert found[10] == found[10**6] and found[10]


@pytest.mark.parametrize("size", [4, 12])
def test_a_sketch_misses_nothing(spark, size):
    phrases = [("en", f"w{i} x") for i in range(300)]
    sketch = collocations.make_sketch(spark.createDataFrame(phrases, "lang string, phrase string"), size)
    assert sketch.has(collocations.phrase_hashes(*map(list, zip(*phrases)))).all()


@pytest.mark.parametrize("held", [50, 10**6])
def test_pairs_are_counted_by_hash(spark, held):
    rng = random.Random(2)
    rows = [(rng.choice(["en", "fr"]), " ".join(rng.choices([f"w{i}" for i in range(40)], range(1, 41), k=30)) + rng.choice([".", " "]) + "w1 w2") for _ in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    counts = Counter((lang, f"{a} {b}") for lang, text in rows for piece in text.split(".") for a, b in zip(piece.split(" "), piece.split(" ")[1:]))
    words = collocations.make_sketch(spark.createDataFrame([(lang, f"w{i}") for lang in ("en", "fr") for i in range(40)], "lang string, phrase string"))
    sketch = collocations.frequent_pairs(docs, words, 10, 6400, held=held)
    has = dict(zip(counts, sketch.has(collocations.phrase_hashes(*map(list, zip(*counts)))).tolist()))
    assert all(has[pair] for pair, f in counts.items() if f >= 10)
    assert sum(has[pair] for pair, f in counts.items() if f < 10) < 5 < sum(f < 10 for f in counts.values())


def test_no_window_travels_before_its_pairs_are_counted(spark, monkeypatch):
    passes, counted = [], collocations.count_phrases
    def count(rows, shortest, longest, least, words=None, pairs=None, **more):
        passes.append((shortest, longest, pairs is not None))
        return counted(rows, shortest, longest, least, words, pairs, **more)
    monkeypatch.setattr(collocations, "count_phrases", count)
    docs = spark.createDataFrame([("en", "a b c a b c. c b a")] * 4, "lang string, text string")
    found = {(r["phrase"], r["f"]) for r in collocations.frequent_phrases(docs, least=8)[0].collect()}
    assert found == {("a", 12), ("b", 12), ("c", 12), ("a b", 8), ("b c", 8), ("a b c", 8)}
    assert all(pairs for _, longest, pairs in passes if longest > 1)


def test_a_pair_is_counted_where_its_windows_are_dealt_by_three_words(spark):
    rows = spark.createDataFrame([("en", f"of the w{i % 300} x{i}") for i in range(3000)], "lang string, text string").repartition(3)
    counted = collocations.count_phrases(rows, 2, 5, 10)
    assert {tuple(r)[1:] for r in counted.collect()} == {("of the", 2, 3000)} | {(f"the w{i}", 2, 10) for i in range(300)} | {(f"of the w{i}", 3, 10) for i in range(300)}


def test_tokenizers_that_normalise_are_refused(tmp_path):
    with open(WORDS, encoding="utf-8") as file:
        made = json.load(file)
    made["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    with pytest.raises(ValueError):
        word_table.Splitter(str(path))


def test_phrases_of_words_with_control_characters(spark):
    rng = random.Random(12)
    words = ["a", "b", "a\0", "a\1", "\0", "\1\2", "\1\1b", "c"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    got = {(r["phrase"], r["words"], r["f"]) for r in collocations.frequent_phrases(docs, least=3)[0].where("words > 1").collect()}
    want = Counter(tuple(t.split(" ")[k:k + n]) for _, t, _ in rows for n in range(2, 6) for k in range(61 - n))
    assert got == {(" ".join(p), len(p), f) for p, f in want.items() if f >= 3}

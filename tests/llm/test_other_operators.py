"""Mixing, neighbours, archives, token files, components and the pipeline."""

import base64
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from gradeloom.llm import ann, bpe, common, components, language_id, mixing, queries, token_counts, warc

PATH = public_tokenizers.path(queries.RANK_FILE)


def test_targets_are_filled_by_level():
    got = mixing.weighted_targets({"a": 100, "b": 10, "c": 1000}, {"a": 1, "b": 2, "c": 3})
    assert got["b"] == 30.0 and math.isclose(sum(got.values()), 1110) and math.isclose(got["c"], 3 * got["a"])
    assert mixing.weighted_targets({"a": 0, None: 5}, {"a": 1, None: 2}) == {"a": 0.0, None: 5.0}
    assert mixing.weighted_targets({}, {}) == {}


def test_flow_uses_unused_text_first():
    capacity, members = {0: 100, 1: 100, 2: 50}, {0: [0], 1: [0, 1], 2: [1]}
    flow = mixing.min_cost_flow(capacity, members, {0: 150, 1: 100})
    used = {p: sum(f for (q, _), f in flow.items() if q == p) for p in capacity}
    assert used == {0: 100, 1: 100, 2: 50}
    flow = mixing.min_cost_flow(capacity, members, {0: 10_000, 1: 0})
    assert sum(flow.values()) == 600


def test_overlapping_sources_meet_quotas(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 20)), [["x"], ["x", "y"], ["y"]][i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, of array<string>")
    quotas = {"x": 5000.0, "y": 7000.0}
    got = mixing.mix(df, quotas, F.col("of"), mixing.word_count()).collect()
    for s, q in quotas.items():
        taken = sum(r["mix_size"] * t["copies"] for r in got for t in r["mix_takes"] if t["source"] == s)
        assert abs(taken - q) <= 60
    assert all(r["mix_taken"] <= 3 * r["mix_size"] and {t["source"] for t in r["mix_takes"]} <= set(r["of"]) for r in got)


def test_mixing_edge_rows(spark):
    rows = [(1, "a b c", "s", 1.0), (1, "a b c", "s", 1.0), (2, None, "s", 1.0), (None, "d e", None, 1.0), (3, "", None, 1.0), (4, "x " * 500, "t", 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, target double")
    got = mixing.mix_by_source(df).collect()
    assert len(got) == 6 and sorted(r["mix_size"] for r in got) == [0, 0, 2, 3, 3, 500]
    assert all(r["mix_taken"] <= 3 * r["mix_size"] for r in got)
    assert mixing.mix_by_source(df.limit(0)).count() == 0
    order = lambda rows: sorted(map(str, rows))
    assert order(mixing.mix_by_source(df, max_sources=1).select(got[0].__fields__).collect()) == order(got)
    assert mixing.mix_by_source(df.limit(0), max_sources=-1).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=6)], 0) for i in range(700)]
    vectors += [(700 + i, vectors[0][1], 0) for i in range(40)] + [(800, None, 0), (801, [0.0] * 6, 0), (802, [float("nan")] + [1.0] * 5, 0), (None, [1.0] * 6, 0),
                                                                   (900, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (1000, [1.0, 2.0], 0), (100, vectors[3][1], 0)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>, i int")
    got = ann.search(df, F.col("id") % 100 == 0).collect()
    good = [(i, np.array(v)) for i, v, _ in vectors if i is not None and v is not None and None not in v and len(v) == 6 and np.isfinite(v).all() and any(v)]
    for q in {i for i, _ in good if i % 100 == 0} - {100}:
        own = dict(good)[q]
        want = sorted((float(np.sqrt(((v - own) ** 2).sum())), i) for i, v in good if i != q)[:10]
        mine = sorted(((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q))
        assert [m[1] for m in mine] == [i for _, i in want] and np.allclose([m[2] for m in mine], [d for d, _ in want], atol=0)
    near = ann.search(df, F.col("id") % 100 == 0, candidates=120, share=0.3)
    assert near.count() == len(got)
    assert ann.search(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(6)
    one, two, sizes = rng.random(7), rng.random(5), rng.integers(0, 3, (7, 5))
    cells = ann.walk(one, two, sizes, int(sizes.sum()))
    assert cells == sorted(((i, j) for i in range(7) for j in range(5) if sizes[i, j]), key=lambda c: one[c[0]] + two[c[1]])


def test_archives(spark):
    pages = [(i, f"http://www.Example.com:80/{i % 3}#x", f"<p>{i % 4}</p>" + "é\r\n\r\nWARC/1.1" * (i % 2)) for i in range(60)]
    pages += [(100, None, None), (101, "https://a.b/c?d", ""), (-7, "x", "<p>0</p>"), (None, "x", "only"), (102, "x\ny", "z" * 300_000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(4)
    path = common.shared_path(spark, "warc-test")
    warc.write_archives(df.withColumn("bytes", F.lit(1)), path)
    index = warc.merged_index(warc.read_archives(spark, path))
    rows = warc.capture_history(index).collect()
    first = {}
    for i, h in sorted((p[0], p[2] or "") for p in pages if p[0] is not None):
        first.setdefault(h, i)
    by_id = {r["page_id"]: r for r in rows}
    assert len(rows) == len(pages)
    for i, _, h in pages:
        r, b = by_id[i], (h or "").encode()
        assert r["payload_bytes"] == len(b) and r["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
        revisit = i is not None and first[h or ""] != i
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[h or ""]) if revisit else ("response", None))
    order = [(r["url_key"], r["date"], r["page_id"] is None, r["page_id"] or 0) for r in sorted(index.collect(), key=lambda r: (r["range_no"], r["range_row"]))]
    assert order == sorted(order) and by_id[1]["url_key"] == "com,example)/1"
    assert warc.read_archives(spark, path).count() == len(pages)


def test_loser_tree_merges():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("block_bytes", [6, 64, 1 << 22])
def test_flat_files(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(token_counts, "SCAN_BLOCKS", 3)
    texts = ["", None, "one", "a longer text with more tokens " * 9, "", "two words", "x" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    path = common.shared_path(spark, "flat-test")
    token_counts.write_flat(df, path, PATH, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    got = sorted((r["doc_no"], r["n_tokens"], r["ended"]) for r in token_counts.token_counts(spark, path, block_bytes=block_bytes).collect())
    assert got == [(i, len(own.encode_ordinary(t or "")), True) for i, t in enumerate(texts)]


def test_flat_file_without_last_separator(spark):
    path = common.shared_path(spark, "flat-test")
    spark.createDataFrame([("ab" * 9,)], "value string").coalesce(1).write.option("lineSep", "zz").text(path)
    ids = int.from_bytes(b"ab", "big")
    assert ids != 0x7A7A
    got = token_counts.token_counts(spark, path, separator=0x6162, block_bytes=4).collect()
    assert sorted((r["doc_no"], r["n_tokens"], r["ended"]) for r in got) == [(i, 0, True) for i in range(9)] + [(9, 1, False)]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 1), (5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            s, t = sorted((find(a), find(b)))
            root[t] = s
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_pipeline(spark, tmp_path):
    def prose(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(["the", "house", "dog", "runs", "over", "green", "hill", "and", "sees", "river", "old", "stone"]) for _ in range(n))

    a = prose(1, 200)
    near = a.split()
    near[100] = "castle"
    texts = [a, a + "\n", " ".join(near), None, "", "123 456"] + [prose(10 + i, 60) for i in range(60)]
    rows = [(i, t, "en", "s1" if i % 3 else "s2", len(t or ""), "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "source mixing", "byte-level BPE"]
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert tuple(kept.columns) == corpus_pipeline.COLUMNS
        seen.append({r["doc_id"] for r in kept.collect()})
    clean = set(range(6, 66))
    assert seen[0] == {0, 1, 2} | clean and seen[1] == {1, 2} | clean and seen[2] == {1} | clean
    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    assert {r["doc_id"] for r in done} <= seen[2] and all(r["same"] for r in done)
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(texts[r["doc_id"]]) for r in done)


def test_contract_queries_name_their_columns():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) == {"op1_source_mixing", "op3_exact_dedup", "op12_turn_alignment", "op13_hat_trie_collocations"}
    assert language_id.UNKNOWN == "und"

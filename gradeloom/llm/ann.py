"""Approximate nearest neighbours with an inverted multi-index.

Vectors are halved, and each half is quantised by its own centroids (k-means
on a bounded sample), so K + K centroids make K * K cells. A query sorts the
centroids of both halves by distance and walks the pairs by the sum of both
with a heap, until the cells hold `candidates` vectors, or the `share` of the
index if that is more; these are reranked by the exact distance in double
precision. How large a share a recall needs depends on the data: measure it.

Cells travel by their first half: a query goes to a row of cells together
with the list of those it wants there.

Equal vectors are one entry of the index that carries its smallest ids (no
more than k + 1 can be in a result), and equal queries are searched once. A
row of cells is cut into blocks of about `BLOCK` entries, so a hot cell is
many groups. Each (query, block) gives its k + 1 nearest before anything is
shuffled again.

Bounds: at most `MAX_CENTROIDS` a half; the sample holds 16 vectors for each
centroid and at most `SAMPLE_ROWS`; the table of cell sizes, which every task
gets, has K * K entries. Where the table has fewer vectors than
`candidates`, all cells are walked and the result is exact.

Defined cases: a vector takes part if it and its id are not null, it holds
neither null nor non-finite components, is not all zero, and has the most
common length (the shorter one on a tie); ties go to the smaller id; rows
that repeat an id are separate candidates; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.llm.common import kept_table

MAX_CENTROIDS = 512
SAMPLE_ROWS = 8192
VECTORS_PER_CELL = 16
BLOCK = 4096
CANDIDATES = 4000
#: vectors without structure have no near cells: on random directions of 64 dimensions a recall of 0.9 takes about 0.45 of the rows
SHARE = 0.6
ROUNDS = 12


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.where(F.col(vec_id).isNotNull() & v.isNotNull()).where(F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
            .select(F.col(vec_id).cast("bigint").alias("id"), F.transform(v, lambda x: x.cast("double") + 0.0).alias("v")))
    return rows


def centroids(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from evenly spread first centroids."""
    if points.shape[1] == 0 or not len(points):
        return np.zeros((1, points.shape[1]))
    unique = np.unique(points, axis=0)
    centres = unique[np.linspace(0, len(unique) - 1, min(k, len(unique))).astype(int)].copy()
    rng = np.random.default_rng(7)
    if len(unique) > k:
        centres = unique[rng.choice(len(unique), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :], 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _squares(points, centres).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Non-empty cells by rising sum of the halves' distances, until they hold `wanted` entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, got, cells = [(first[a[0]] + second[b[0]], 0, 0)], 0, []
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        here = int(sizes[a[i], b[j]])
        if here:
            cells.append((int(a[i]), int(b[j])))
            got += here
        # each pair is pushed by one neighbour: to the right always, downwards from the first column
        if j + 1 < len(b):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))
    return cells


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
           candidates: int = CANDIDATES, share: float = SHARE, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of the rows for which `queries` (over the column `id`) holds."""
    spark = vectors.sparkSession
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    rows = usable(vectors, vec_id, vector)
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], empty)
    dim, n = lengths["dim"], lengths["n"]
    half = dim // 2
    rows = rows.where(F.size("v") == dim)
    same = Window.partitionBy("v").orderBy("id")
    entries = (rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
               .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    size = int(min(MAX_CENTROIDS, max(2, (n / VECTORS_PER_CELL) ** 0.5)))
    order = F.xxhash64(F.lit(seed), "id")
    sample = np.array([r["v"] for r in rows.orderBy(order, "id").limit(min(SAMPLE_ROWS, 16 * size)).select("v").collect()])
    halves = centroids(sample[:, :half], size), centroids(sample[:, half:], size)
    shipped = spark.sparkContext.broadcast(halves)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shipped.value
        for batch in batches:
            m = _matrix(batch.column("v"), dim)
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("ids"), pa.array(nearest(m[:, :half], one), pa.int32()),
                                              pa.array(nearest(m[:, half:], two), pa.int32())], ["v", "ids", "i", "j"])

    index = kept_table(entries.mapInArrow(place, "v array<double>, ids array<bigint>, i int, j int"), "multi-index")
    sizes = np.zeros((len(halves[0]), len(halves[1])), np.int64)
    for r in index.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect():  # K * K rows at most
        sizes[r["i"], r["j"]] = r["n"]
    shipped_sizes = spark.sparkContext.broadcast(sizes)
    blocks = np.maximum(1, -(-sizes.sum(axis=1) // BLOCK)).tolist()  # of each row of cells
    wanted = max(candidates, int(np.ceil(share * sizes.sum())))
    per_row = F.element_at(F.array(*map(F.lit, blocks)), F.col("i") + 1)
    blocked = index.withColumn("block", F.pmod(F.xxhash64(F.element_at("ids", 1)), per_row).cast("int"))
    asked = rows.where(queries)
    leads = asked.groupBy("v").agg(F.min("id").alias("lead"))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (one, two), cells = shipped.value, shipped_sizes.value
        for batch in batches:
            m = _matrix(batch.column("v"), dim)
            d1, d2 = _squares(m[:, :half], one), _squares(m[:, half:], two)
            of, rows_of, cells_of, block = [], [], [], []
            for q in range(len(m)):
                own: dict[int, list[int]] = {}
                for a, b in walk(d1[q], d2[q], cells, wanted):
                    own.setdefault(a, []).append(b)
                for a, list_b in own.items():
                    for part in range(blocks[a]):
                        of.append(q), rows_of.append(a), cells_of.append(list_b), block.append(part)
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("lead").take(of), batch.column("v").take(of), pa.array(rows_of, pa.int32()),
                                              pa.array(block, pa.int32()), pa.array(cells_of, pa.list_(pa.int32()))], ["lead", "v", "i", "block", "cells"])

    routed = leads.select("lead", "v").mapInArrow(route, "lead bigint, v array<double>, i int, block int, cells array<int>")

    def rerank(cell: pa.Table, wanted: pa.Table) -> pa.Table:
        leads, ids, scores = [], [], []
        if cell.num_rows and wanted.num_rows:
            m, owners, j = _matrix(cell.column("v"), dim), cell.column("ids").to_pylist(), cell.column("j").to_numpy()
            for lead, q, visited in zip(wanted.column("lead").to_pylist(), _matrix(wanted.column("v"), dim), wanted.column("cells").to_pylist()):
                here = np.flatnonzero(np.isin(j, visited))
                if not len(here):
                    continue
                d = np.sqrt(((m[here] - q) ** 2).sum(axis=1))
                limit = np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)]
                found = sorted((d[r], o) for r in np.flatnonzero(d <= limit).tolist() for o in owners[here[r]])[:k + 1]
                leads += [lead] * len(found)
                ids += [o for _, o in found]
                scores += [s for s, _ in found]
        return pa.table([pa.array(leads, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["lead", "vec_id", "score"])

    near = (blocked.groupBy("i", "block").cogroup(routed.groupBy("i", "block"))
            .applyInArrow(rerank, "lead bigint, vec_id bigint, score double"))
    best = Window.partitionBy("lead").orderBy("score", "vec_id")
    top = near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    own = asked.select(F.col("id").alias("query_id"), "v").join(leads, "v").select("query_id", "lead")
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (own.join(top, "lead").where("query_id != vec_id").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))

"""Mixing sources to target weights by a min-cost flow.

Documents may belong to several sources. They are aggregated by membership
pattern (the set of their sources); a flow routes the tokens of the patterns
to the quotas of the sources, where the first, second and third use of a
pattern are arcs of rising cost, so that nothing is repeated while unused
text is left. Documents are then selected in a seeded order, by position on
the line that the copies of a pattern form. Only pattern totals reach the
driver (at most `max_patterns` rows, else `mix` raises; `mix_by_source` needs
no driver beyond that); documents are placed by
bucketed running sums, so a source that holds a third of all rows is
thousands of groups.

Defined cases: null or empty text has size 0 and is never taken; a document
of no source (empty membership) is never taken; null is a source of its own
and ranks last; a document is taken whole, so a source misses its quota by
less than its largest document; rows that repeat an id are placed one after
the other; an empty table gives an empty result; columns named mix_*,
source_size or target are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gradeloom.llm.common import WORD_PATTERN, kept_table, text_or_empty

MAX_REPEATS = 3
MAX_PATTERNS = 2000
#: cost of the first, second and third use of a token: convex
REPEAT_COSTS = (0, 1, 3)
#: hexadecimal digits of the seeded order that name a bucket
BUCKET_DIGITS = 3


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD_PATTERN)).cast("bigint")


def weighted_targets(sizes: dict[str | None, int], weights: dict[str | None, int], cap: int = MAX_REPEATS) -> dict[str | None, float]:
    """Share the total size by weight; a source stops at `cap` times its size and the excess is shared again.

    The result is min(cap * size, level * weight) for the one level that uses up the total.
    """
    order = sorted(sizes, key=lambda s: cap * sizes[s] / weights[s])
    total, rest, level = sum(sizes.values()), sum(weights.values()), 0.0
    for s in order:
        level = total / rest
        if level <= cap * sizes[s] / weights[s]:
            break
        total, rest = total - cap * sizes[s], rest - weights[s]
    return {s: float(min(cap * sizes[s], level * weights[s])) for s in sizes}


def min_cost_flow(capacity: dict[int, int], members: dict[int, list[int]], quota: dict[int, int],
                  costs: tuple[int, ...] = REPEAT_COSTS) -> dict[tuple[int, int], int]:
    """Cheapest largest flow of tokens from patterns to sources: {(pattern, source): tokens}.

    Successive shortest paths with potentials over patterns + sources + 2
    nodes; each pattern is fed by one arc per repetition.
    """
    n, s_of = len(capacity), {s: len(capacity) + i for i, s in enumerate(quota)}
    begin, end = n + len(quota), n + len(quota) + 1
    to, left, price, out = [], [], [], [[] for _ in range(end + 1)]

    def arc(a, b, most, cost):
        for x, y, m, c in ((a, b, most, cost), (b, a, 0, -cost)):
            out[x].append(len(to))
            to.append(y), left.append(m), price.append(c)
        return len(to) - 2

    for p, c in capacity.items():
        for cost in costs:
            arc(begin, p, c, cost)
    total = sum(quota.values())
    routes = {(p, s): arc(p, s_of[s], total, 0) for p, own in members.items() for s in own}
    for s, q in quota.items():
        arc(s_of[s], end, q, 0)
    potential = [0] * (end + 1)
    while True:
        best, via, heap = [None] * (end + 1), [None] * (end + 1), [(0, begin)]
        best[begin] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > best[x]:
                continue
            for e in out[x]:
                if left[e]:
                    y, cost = to[e], d + price[e] + potential[x] - potential[to[e]]
                    if best[y] is None or cost < best[y]:
                        best[y], via[y] = cost, e
                        heapq.heappush(heap, (cost, y))
        if best[end] is None:
            return {k: left[e ^ 1] for k, e in routes.items() if left[e ^ 1]}
        potential = [v + (b if b is not None else best[end]) for v, b in zip(potential, best)]
        path, x = [], end
        while x != begin:
            path.append(via[x])
            x = to[via[x] ^ 1]
        step = min(left[e] for e in path)
        for e in path:
            left[e] -= step
            left[e ^ 1] += step


def _seeded(doc_id: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def _placed(docs: DataFrame, sources: Column, size: Column, doc_id: str, seed: str) -> DataFrame:
    return (docs.withColumn("mix_size", size).withColumn("mix_pattern", F.array_sort(F.array_distinct(sources)))
            .withColumn("mix_order", _seeded(doc_id, seed)).withColumn("mix_bucket", F.substring("mix_order", 1, BUCKET_DIGITS)))


def bucket_sums(docs: DataFrame, sources: Column, size: Column, doc_id: str = "doc_id", seed: str = "mix") -> DataFrame:
    """Tokens by membership pattern and bucket of the seeded order: the one pass over the texts that the flow needs."""
    return kept_table(_placed(docs, sources, size, doc_id, seed).groupBy("mix_pattern", "mix_bucket")
                      .agg(F.sum("mix_size").alias("bucket_size")), "mix-sums")


def pattern_totals(sums: DataFrame, max_patterns: int = MAX_PATTERNS) -> list[tuple[list[str | None], int]]:
    totals = sums.groupBy("mix_pattern").agg(F.sum("bucket_size").alias("n")).limit(max_patterns + 1).collect()
    if len(totals) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    return sorted(((r["mix_pattern"], r["n"]) for r in totals), key=lambda t: [(s is None, s or "") for s in t[0]])


def mix(docs: DataFrame, quotas: dict[str | None, float], sources: Column, size: Column, doc_id: str = "doc_id",
        seed: str = "mix", sums: DataFrame | None = None) -> DataFrame:
    """All rows of `docs` with `mix_size`, `mix_takes` (array of source, copies) and `mix_taken` (tokens, repeats counted).

    `sources` is an array of strings: the sources that a document may serve.
    `sums` are the `bucket_sums` of the same arguments, where the caller has them.
    """
    spark = docs.sparkSession
    sums = bucket_sums(docs, sources, size, doc_id, seed) if sums is None else sums
    totals = pattern_totals(sums)
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    flow = min_cost_flow({i: n for i, (_, n) in enumerate(totals)},
                         {i: [number[s] for s in pattern if s in number] for i, (pattern, _) in enumerate(totals)},
                         {i: round(quotas[s]) for i, s in enumerate(names)})
    plan = []
    for i, (pattern, capacity) in enumerate(totals):
        at, spans = 0, []
        for k, s in enumerate(names):
            if got := flow.get((i, k), 0):
                spans.append((s, at, at + got))
                at += got
        plan.append((pattern, capacity, spans))
    schema = ("mix_pattern array<string>, mix_capacity bigint, mix_spans array<struct<source string, low bigint, high bigint>>")
    return _selected(_placed(docs, sources, size, doc_id, seed), sums, spark.createDataFrame(plan, schema))


def _selected(rows: DataFrame, sums: DataFrame, planned: DataFrame) -> DataFrame:
    """The placed rows with what the plan (mix_pattern, mix_capacity, mix_spans) takes of each."""
    before = Window.partitionBy("mix_pattern").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sums.withColumn("mix_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
              .join(planned, "mix_pattern").drop("bucket_size"))
    inside = (Window.partitionBy("mix_pattern", "mix_bucket").orderBy("mix_order", "mix_size")
              .rowsBetween(Window.unboundedPreceding, 0))
    # a copy of a document is taken where its middle lies; positions are doubled to stay whole numbers
    middle = 2 * (F.col("mix_start") + F.col("mix_until")) - F.col("mix_size")
    copies = lambda x: sum(((2 * x["low"] <= middle + 2 * j * F.col("mix_capacity"))
                            & (middle + 2 * j * F.col("mix_capacity") < 2 * x["high"])).cast("int") for j in range(MAX_REPEATS))
    takes = F.filter(F.transform("mix_spans", lambda x: F.struct(x["source"].alias("source"), copies(x).alias("copies"))),
                     lambda x: (x["copies"] > 0) & (F.col("mix_size") > 0))
    return (rows.withColumn("mix_until", F.sum("mix_size").over(inside))
            .join(starts, ["mix_pattern", "mix_bucket"])
            .withColumn("mix_takes", takes)
            .withColumn("mix_taken", F.col("mix_size") * F.aggregate("mix_takes", F.lit(0), lambda a, x: a + x["copies"]))
            .drop("mix_pattern", "mix_bucket", "mix_order", "mix_until", "mix_start", "mix_capacity", "mix_spans"))


def source_targets(sums: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from the bucket sums of documents of one source each.

    Weights follow the cycle in code-point order, null last; a target stops at `MAX_REPEATS` times its source's size
    and the excess is shared by weight. With sources ordered by size per weight, those that stop come first: a target
    is the least level at which the rest of the sizes covers the rest of the weights. The windows hold a row per source.
    """
    sizes = sums.groupBy(F.col("mix_pattern")[0].alias("source")).agg(F.sum("bucket_size").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in cycle])
    weighed = sizes.withColumn("weight", F.element_at(weights, (F.row_number().over(names) - 1) % len(cycle) + 1))
    capped = weighed.withColumn("cap", MAX_REPEATS * F.col("source_size")).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    whole = Window.partitionBy()
    below = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0))).cast("double")
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0))).cast("double"))
    levels = capped.withColumn("level", level)
    place = F.struct("ratio", F.col("source").isNull(), "source")
    shared = levels.withColumn("shared", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")),
                                                  F.when(F.col("level") <= F.col("ratio"), place)).over(whole))
    return shared.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("shared") * F.col("weight")).alias("target"))


def cycled_weights(names: list[str | None], cycle: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, int]:
    """Weights by rank in code-point order, null last."""
    order = sorted(names, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(order)}


def mix_by_source(docs: DataFrame, seed: str = "mix", max_sources: int = MAX_PATTERNS) -> DataFrame:
    """Mix documents of one source each: every row with mix_size, mix_takes, mix_taken, source_size and target.

    Each document's membership is its one source. Up to `max_sources` sources are the nodes of a flow. Of more, sizes,
    targets and plan stay rows of Spark: where patterns don't overlap, the cheapest flow sends each source what its own
    quota asks, so both ways take the same documents.
    """
    docs = docs.drop("source_size", "target")
    sums = bucket_sums(docs, F.array("source"), word_count(), seed=seed)
    if sums.select("mix_pattern").distinct().limit(max_sources + 1).count() > max_sources:
        targets = source_targets(sums)
        quota = F.bround("target", 0).cast("bigint")
        spans = F.when(quota > 0, F.array(F.struct(F.col("source"), F.lit(0).cast("bigint").alias("low"), quota.alias("high")))).otherwise(
            F.array().cast("array<struct<source:string,low:bigint,high:bigint>>"))
        planned = targets.select(F.array("source").alias("mix_pattern"), F.col("source_size").alias("mix_capacity"), spans.alias("mix_spans"))
        known = targets.select(F.col("source").isNull().alias("mix_null"), F.coalesce("source", F.lit("")).alias("mix_name"), "source_size", "target")
        mixed = _selected(_placed(docs, F.array("source"), word_count(), "doc_id", seed), sums, planned)
    else:
        sizes = {pattern[0]: n for pattern, n in pattern_totals(sums, max_sources)}
        targets = weighted_targets(sizes, cycled_weights(list(sizes)))
        known = docs.sparkSession.createDataFrame([(s is None, s or "", sizes[s], targets[s]) for s in sizes],
                                                  T.StructType.fromDDL("mix_null boolean, mix_name string, source_size bigint, target double"))
        mixed = mix(docs, targets, F.array("source"), word_count(), seed=seed, sums=sums)
    return (mixed.withColumn("mix_null", F.col("source").isNull()).withColumn("mix_name", F.coalesce("source", F.lit("")))
            .join(known, ["mix_null", "mix_name"]).drop("mix_null", "mix_name"))

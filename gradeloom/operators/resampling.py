"""Bootstrap, permutation and verdict statistics as distributed resampling.

One scheme holds at every size: each row gives itself a Poisson(1) weight per
replicate (or a sign per draw) from a seeded hash. A task turns a batch of
rows into a matrix of weights and keeps the sums of each (group, replicate),
so a batch sends replicates, not rows times replicates, and no row is moved
before. A group of any size, or one holding a third of all rows, needs no
array and no join. Work is cut along both axes: an input of fewer partitions
than cores, which adaptive execution makes of few rows, is dealt as blocks of
replicates, so that 1,500 rows x 20,000 draws use every core; one of many rows
is dealt by unit into tasks of at most `TASK_DRAWS` weights on average. Groups that share
units, as the pairs of models share bugs, share their weights.

Sign-flip p-values are exact up to `EXACT_MAX` nonzero differences: the signed
sums of two halves, one of them sorted, are counted against each other by
binary search, which takes 2**(n/2) numbers instead of 2**n. Redraws with
replacement (`method="redraw"`) are there for small groups where the caller
names them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from gradeloom import fixed_values as fv
from gradeloom.functions.hashing import MODULUS, poisson_cuts, text_key, with_draw
from gradeloom.session import cut_lineage, spread

BLOCKS = 8
#: least replicates of a block, and differences whose 2**n signed sums are counted exactly
BLOCK_REPLICATES, EXACT_MAX = 64, 44
TOLERANCE = 1e-9
#: units and replicates whose weights are one matrix, which stays in a core's cache
MATRIX_ROWS, MATRIX_REPLICATES = 256, 512
#: weights that one task draws, and sums that it holds before it sends them
TASK_DRAWS, HELD_SUMS = 1 << 30, 1 << 21


def _pick(replicates: DataFrame, keys: list[str], count: int, alpha: float) -> DataFrame:
    """Percentile bounds by position in the sorted replicate means (at most `count` per group)."""
    low, high = int(alpha / 2 * count), min(int((1 - alpha / 2) * count), count - 1)
    ordered = replicates.groupBy(*keys).agg(F.sort_array(F.collect_list("mean")).alias("means"))
    # a Poisson replicate can in principle carry no weight, so positions follow the real count
    size = F.size("means")
    at = lambda i: F.element_at("means", F.least(F.lit(i + 1), size))
    return ordered.select(*keys, at(low).alias("lo"), at(high).alias("hi"))


def _redrawn(units: DataFrame, keys: list[str], count: int, seed: int) -> DataFrame:
    """Replicate means by n draws with replacement from one array per group; `units` has keys, unit, s, c."""
    arrays = units.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("unit", "s", "c"))).alias("arr"))
    blocks = arrays.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    blocks = spread(blocks, *keys, "block")
    per = -(-count // BLOCKS)
    reps = (blocks.withColumn("b", F.explode(F.sequence(F.col("block") * per, F.least(
        (F.col("block") + 1) * per, F.lit(count)) - 1)))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.size("arr") - 1))))
    at = (F.col("draw") % F.size("arr")).cast("int")
    drawn = with_draw(reps, "b", "i", seed).select(*keys, "b", F.get("arr", at).alias("u"))
    return drawn.groupBy(*keys, "b").agg((F.sum("u.s") / F.sum("u.c")).alias("mean"))


def _folded(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same remainder: MODULUS is 2**31 - 1, so the upper bits count as ones."""
    high = x >> 31
    x &= MODULUS
    x += high
    return x


def _draws(items: np.ndarray, begin: int, end: int, seed: int) -> np.ndarray:
    """The matrix of `hashing.with_draw` over items x replicates begin .. end."""
    i, b = items.astype(np.int64), np.arange(begin, end, dtype=np.int64)
    x = _folded((b * 40014 % MODULUS)[None, :] + ((i * 40692 + seed) % MODULUS)[:, None])
    square = _folded(x * x)
    x *= 16807
    x += square
    x += (i * 99991 % MODULUS)[:, None]
    x = _folded(x)
    square = _folded(x * x)
    x *= 48271
    x += square
    x = _folded(x)
    x -= (x >= MODULUS) * np.int64(MODULUS)
    return x


def _poisson_weights(draws: np.ndarray) -> np.ndarray:
    weights = np.zeros(draws.shape, np.uint8)
    for cut in poisson_cuts():
        weights += draws >= cut
    return weights.astype(np.float64)


def _signs(draws: np.ndarray) -> np.ndarray:
    return 1.0 - 2.0 * (draws & 1)


def _replicate_blocks(rows: DataFrame, count: int) -> int:
    """How many blocks of replicates make about eight units of work per core out of the input's partitions."""
    cores, have = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    return 1 if have * 2 > cores else max(1, min(count // BLOCK_REPLICATES, 8 * cores // max(have, 1)))


def _weighted_sums(values: np.ndarray, items: np.ndarray, begin: int, end: int, seed: int, weigh: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """`values` (any x items) times the weights (items x replicates begin .. end), a piece of the weights at a time."""
    out = np.zeros((len(values), end - begin))
    for cut in range(0, len(items), MATRIX_ROWS):
        part, some = values[:, cut:cut + MATRIX_ROWS], items[cut:cut + MATRIX_ROWS]
        for first in range(begin, end, MATRIX_REPLICATES):
            last = min(first + MATRIX_REPLICATES, end)
            out[:, first - begin:last - begin] += part @ weigh(_draws(some, first, last, seed))
    return out


def _dealt(rows: DataFrame, count: int) -> tuple[DataFrame, int]:
    """`rows` (with `_k`, the unit's number) in enough tasks, with `_block`, and the number of blocks of replicates."""
    have, cores = rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism
    tasks = -(-rows.count() * count // TASK_DRAWS)
    if tasks > max(have, cores):
        # rows of a unit meet, so that they share its weights
        return rows.withColumn("_block", F.lit(0)).repartition(tasks, "_k").sortWithinPartitions("_k"), 1
    blocks = _replicate_blocks(rows, count)
    if blocks == 1:
        return rows.withColumn("_block", F.lit(0)), 1
    return spread(rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), "_block"), blocks


def _replicate_sums(units: DataFrame, keys: list[str], count: int, seed: int, weigh: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """keys, b, s, c: the weighted sums of s and c per replicate; `units` has keys, unit, s, c and is materialised."""
    rows = units.select(*keys, F.col("s").cast("double").alias("s"), "c", text_key(F.col("unit").cast("string")).alias("_k"))
    dealt, blocks = _dealt(rows, count)
    per = -(-count // blocks)

    def sums_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        """((block, *keys), sums of s and c) of a batch's groups."""
        values = np.stack([batch.column("s").to_numpy(zero_copy_only=False), batch.column("c").to_numpy(zero_copy_only=False).astype(np.float64)])
        item = batch.column("_k").to_numpy(zero_copy_only=False)
        members: dict[int, dict[tuple, list[int]]] = {}
        for at, (block, *key) in enumerate(zip(*(batch.column(k).to_pylist() for k in ["_block", *keys]))):
            members.setdefault(block, {}).setdefault((block, *key), []).append(at)
        for block, groups in members.items():
            begin, end = block * per, min((block + 1) * per, count)
            if begin >= end:
                continue
            at = np.concatenate([np.array(own) for own in groups.values()])
            distinct, place = np.unique(item[at], return_inverse=True)
            if len(groups) * len(distinct) <= 2 * len(at) and len(groups) * per <= HELD_SUMS:
                # groups of mostly the same units are the rows of one product
                wide = np.zeros((2, len(groups), len(distinct)))
                np.add.at(wide, (slice(None), np.repeat(np.arange(len(groups)), [len(own) for own in groups.values()]), place), values[:, at])
                sums = _weighted_sums(wide.reshape(2 * len(groups), -1), distinct, begin, end, seed, weigh).reshape(2, len(groups), -1)
                yield from ((key, sums[:, n]) for n, key in enumerate(groups))
            else:
                yield from ((key, _weighted_sums(values[:, own], item[own], begin, end, seed, weigh)) for key, own in groups.items())

    def sent(totals: dict[tuple, np.ndarray], types: list[pa.DataType]) -> pa.RecordBatch:
        sizes = [total.shape[1] for total in totals.values()]
        heads = pa.array(np.repeat(np.arange(len(totals)), sizes))
        total = np.concatenate(list(totals.values()), axis=1)
        b = np.concatenate([np.arange(key[0] * per, key[0] * per + size, dtype=np.int32) for key, size in zip(totals, sizes)])
        return pa.RecordBatch.from_arrays([*(pa.array([key[n + 1] for key in totals], kind).take(heads) for n, kind in enumerate(types)),
                                           pa.array(b), pa.array(total[0]), pa.array(total[1])], [*keys, "b", "s", "c"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            for key, sums in sums_of(batch):
                totals[key] = totals[key] + sums if key in totals else sums
                if len(totals) * per >= HELD_SUMS:
                    yield sent(totals, types)
                    totals.clear()
        if totals:
            yield sent(totals, types)

    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("b", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("c", T.DoubleType())])
    return dealt.mapInArrow(run, schema).groupBy(*keys, "b").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))


def signed_sums(values: np.ndarray) -> np.ndarray:
    """All 2**n sums of n values with either sign."""
    sums = np.zeros(1)
    for value in values:
        sums = np.concatenate([sums + value, sums - value])
    return sums


def exact_share(values: np.ndarray, chunk: int = 1 << 16) -> float:
    """The share of all sign vectors whose sum is at least as far from 0 as the sum of `values`.

    Meet in the middle: each signed sum of one half is matched with the sorted sums of the other.
    """
    least = abs(float(values.sum())) - TOLERANCE
    if least <= 0:
        return 1.0
    half = len(values) // 2
    left, right = signed_sums(values[:half]), np.sort(signed_sums(values[half:]))
    hits = 0
    for begin in range(0, len(left), chunk):
        some = left[begin:begin + chunk]
        hits += len(some) * len(right) - int(np.searchsorted(right, least - some, side="left").sum()) + int(np.searchsorted(right, -least - some, side="right").sum())
    return hits / 2 ** len(values)


def _exact(nonzero: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p_value of groups of at most EXACT_MAX differences; larger ones raise. `nonzero` has keys, unit, d."""
    arrays = nonzero.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("unit", "d"))), lambda x: x["d"].cast("double")).alias("ds"))
    few = F.when(F.size("ds") <= EXACT_MAX, F.col("ds")).otherwise(F.raise_error(F.lit("too many differences for the exact method")).cast("array<double>"))
    rows = spread(arrays.withColumn("ds", few), *keys)
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("p_value", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [exact_share(np.array(ds.as_py(), np.float64)) for ds in batch.column("ds")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(found, pa.float64())], [*keys, "p_value"])

    return rows.mapInArrow(run, schema)


def _sampled(nonzero: DataFrame, keys: list[str], draws: int, seed: int) -> DataFrame:
    """keys, p_value from `draws` random sign vectors, with add-one smoothing."""
    totals = _replicate_sums(nonzero.select(*keys, "unit", F.col("d").alias("s"), F.lit(1).alias("c")), keys, draws, seed, _signs)
    observed = nonzero.groupBy(*keys).agg(F.abs(F.sum("d")).alias("observed"))
    return totals.join(observed, keys).groupBy(*keys).agg(
        ((F.sum((F.abs("s") >= F.col("observed") - TOLERANCE).cast("bigint")) + 1) / (draws + 1)).alias("p_value"))


def _weighted(units: DataFrame, keys: list[str], count: int, seed: int) -> DataFrame:
    """Replicate means by Poisson weights that each row draws for itself."""
    sums = _replicate_sums(units, keys, count, seed, _poisson_weights)
    return sums.select(*keys, "b", (F.col("s") / F.nullif(F.col("c"), F.lit(0.0))).alias("mean"))


def bootstrap(df: DataFrame, keys: list[str], value: str, unit: str, cluster: str | None = None,
              replicates: int = fv.BOARD_REPLICATES, seed: int = fv.BOARD_SEED,
              alpha: float = fv.ALPHA, method: str = "poisson", materialize: bool = True) -> DataFrame:
    """Seeded percentile bootstrap of the mean of `value` per group: keys, n, point, lo, hi.

    `method` is "poisson" or "redraw" (from one array per group: for small groups).
    The narrow input is read by several branches; `materialize` checkpoints it
    once so its lineage is not run for each. With `cluster`, whole clusters are redrawn (each enters as its sum and
    count); a group with fewer than two clusters falls back to redrawing rows.
    """
    base = df.filter(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, unit, value, *([cluster] if cluster else [])]))
    if materialize:
        base = cut_lineage(base)
    rows = base.select(*keys, F.col(unit).cast("string").alias("unit"),
                       F.col(value).cast("double").alias("s"), F.lit(1).cast("bigint").alias("c"))
    sizes = rows.groupBy(*keys).agg(F.sum("c").alias("n"), F.avg("s").alias("point"),
                                    F.count(F.lit(1)).alias("units"))
    units = rows
    if cluster is not None:
        clustered = base.groupBy(*keys, F.coalesce(F.col(cluster).cast("string"), F.lit("?")).alias("unit")).agg(
            F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("c"))
        counts = clustered.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("point"),
                                              F.count(F.lit(1)).alias("clusters"))
        rowwise = rows.join(counts.filter("clusters < 2").select(*keys), keys, "left_semi")
        # sums per cluster: a small table that the branches below all read
        units = cut_lineage(clustered.join(counts.filter("clusters >= 2").select(*keys), keys, "left_semi").unionByName(rowwise))
        sizes = units.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("point"),
                                         F.count(F.lit(1)).alias("units"))
    schemes = {"poisson": _weighted, "redraw": _redrawn}
    if method not in schemes:
        raise ValueError(f"unknown method {method!r}")
    reps = schemes[method](units, keys, replicates, seed)
    bounds = _pick(reps, keys, replicates, alpha)
    return sizes.join(bounds, keys, "left").select(
        *keys, "n", "point", F.coalesce("lo", "point").alias("lo"), F.coalesce("hi", "point").alias("hi"))


def pairwise_differences(scores: DataFrame) -> DataFrame:
    """(model_a, model_b, bug_id, codebase, a, b, diff) on shared bugs, model_a < model_b.

    Scores are averaged per (model, bug) first, so the self-join meets one row
    per model and bug however often a bug was attempted.
    """
    means = scores.groupBy("model", "bug_id").agg(F.avg("score").alias("score"), F.min("codebase").alias("codebase"))
    a = means.select(F.col("model").alias("model_a"), "bug_id", "codebase", F.col("score").alias("a"))
    b = means.select(F.col("model").alias("model_b"), "bug_id", F.col("score").alias("b"))
    return a.join(b, "bug_id").filter("model_a < model_b").withColumn("diff", F.col("a") - F.col("b"))


def model_pairs(models: DataFrame) -> DataFrame:
    """All (model_a, model_b) with model_a < model_b: ranks joined on equality, no cross join."""
    ranked = models.select("model").distinct().withColumn("r", F.row_number().over(W.orderBy("model")))
    partners = ranked.filter("r > 1").select(
        F.col("model").alias("model_b"), F.explode(F.sequence(F.lit(1), F.col("r") - 1)).alias("r"))
    return partners.join(ranked.withColumnRenamed("model", "model_a"), "r").select("model_a", "model_b")


def sign_permutation(diffs: DataFrame, keys: list[str], value: str = "diff", unit: str = "bug_id", method: str = "sampled",
                     draws: int = fv.SIGN_DRAWS, seed: int = fv.PAIR_SEED, materialize: bool = True) -> DataFrame:
    """Two-sided paired sign-flip p-value per group: keys, p_value.

    "auto": exact for groups of at most `EXACT_MAX` nonzero differences, "sampled" for larger ones. "sampled":
    `draws` random sign vectors; each difference signs itself per draw, so only (group, draw) sums are shuffled.
    "exact": exact, where a larger group raises. A group without nonzero differences has 1. `materialize` checkpoints
    the narrow nonzero differences, which several branches read.
    """
    if method not in ("auto", "exact", "sampled"):
        raise ValueError(f"unknown method {method!r}")
    d = diffs.filter(F.col(value).isNotNull()).select(*keys, F.col(unit).cast("string").alias("unit"), F.col(value).alias("d"))
    if materialize:
        d = cut_lineage(d)
    nonzero = d.filter(F.col("d") != 0)
    if method == "auto":
        sizes = nonzero.groupBy(*keys).agg((F.count(F.lit(1)) <= EXACT_MAX).alias("few"))
        found = _exact(nonzero.join(sizes.filter("few"), keys, "left_semi"), keys).unionByName(
            _sampled(cut_lineage(nonzero.join(sizes.filter("not few"), keys, "left_semi")), keys, draws, seed))
    else:
        found = _exact(nonzero, keys) if method == "exact" else _sampled(nonzero, keys, draws, seed)
    return d.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("p_value", F.lit(1.0)).alias("p_value"))


def dominance(diffs: DataFrame, keys: list[str], value: str = "diff") -> DataFrame:
    """(wins - losses) / shared per group."""
    return diffs.groupBy(*keys).agg(F.avg(F.signum(value)).alias("dominance"), F.count(F.lit(1)).alias("shared"))


def equivalent(lo: Column, hi: Column, delta: float = fv.EQUIVALENCE_DELTA) -> Column:
    """The whole interval lies inside (-delta, +delta)."""
    return (lo > -delta) & (hi < delta)


def holm(df: DataFrame, p: str = "p_value", tiebreak: list[str] = (), family: list[str] = ()) -> DataFrame:
    """Add `p_adjusted`, the Holm step-down value; one row per comparison, not per data row."""
    group = W.partitionBy(*family)
    order = group.orderBy(F.col(p), *tiebreak)
    m = F.count(F.lit(1)).over(group)
    stepped = df.withColumn("_step", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p)))
    running = F.max("_step").over(order.rowsBetween(W.unboundedPreceding, 0))
    return stepped.withColumn("p_adjusted", running).drop("_step")


def verdicts(scores: DataFrame, delta0: float = fv.EQUIVALENCE_DELTA, alpha: float = fv.ALPHA,
             replicates: int = fv.PAIR_REPLICATES, seed: int = fv.PAIR_SEED,
             draws: int = fv.SIGN_DRAWS, method: str = "auto") -> DataFrame:
    """Every model pair: A_WINS, B_WINS, TIED or INCONCLUSIVE, after Holm correction; `p_method` says how p was found."""
    keys = ["model_a", "model_b"]
    diffs = cut_lineage(pairwise_differences(scores))
    base = diffs.groupBy(*keys).agg(
        F.avg("diff").alias("delta"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
        F.avg(F.signum("diff")).alias("dominance"), F.count(F.lit(1)).alias("n_bugs"),
        F.when(F.count_if(F.col("diff") != 0) <= EXACT_MAX, "exact").otherwise("sampled").alias("p_method") if method == "auto" else F.max(F.lit(method)).alias("p_method"))
    p = sign_permutation(diffs, keys, method=method, draws=draws, seed=seed, materialize=False)
    ci = bootstrap(diffs, keys, "diff", "bug_id", replicates=replicates, seed=seed, alpha=alpha, materialize=False).select(*keys, F.col("lo").alias("ci_low"), F.col("hi").alias("ci_high"))
    cci = bootstrap(diffs, keys, "diff", "bug_id", cluster="codebase", replicates=replicates, seed=seed, alpha=alpha, materialize=False).select(*keys, F.col("lo").alias("cluster_low"), F.col("hi").alias("cluster_high"))
    table = reduce(lambda l, r: l.join(r, keys, "left"), [base, p, ci, cci], model_pairs(scores))
    table = table.withColumn("p_value", F.coalesce("p_value", F.lit(1.0))).withColumn(
        "n_bugs", F.coalesce("n_bugs", F.lit(0).cast("bigint")))
    table = holm(table, "p_value", keys)
    lo, hi, clo, chi = (F.col(c) for c in ("ci_low", "ci_high", "cluster_low", "cluster_high"))
    shared = F.col("n_bugs") > 0
    tied = equivalent(lo, hi, delta0)
    significant = shared & (F.col("p_value") < alpha) & ~((lo <= 0) & (hi >= 0))
    survives = significant & (F.col("p_adjusted") < alpha)
    verdict = (F.when(~shared, "INCONCLUSIVE")
               .when(survives & (F.col("delta") > 0), "A_WINS").when(survives, "B_WINS")
               .when(tied, "TIED").otherwise("INCONCLUSIVE"))
    notes = F.array_compact(F.array(
        F.when(~shared, "no bugs are shared between these two models"),
        F.when(significant & (((lo > 0) != (clo > 0)) | ((hi > 0) != (chi > 0))),
               "paired and cluster intervals disagree on the sign; the paired result stands"),
        F.when(significant & ~survives, "win does not survive Holm correction"),
        F.when(shared & ~significant & tied, f"gap bounded below {delta0}"),
        F.when(shared & ~significant & ~tied, f"could not bound the gap below {delta0}; not a tie")))
    return table.withColumn("verdict", verdict).withColumn("notes", notes)

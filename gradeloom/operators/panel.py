"""Panel building: dedupe, quotas, stratified and seeded samples, bug combinations, difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from gradeloom import fixed_values as fv
from gradeloom.operators.ordered import gap_clusters, keep_first, top_per_group


def difficulty_rank(difficulty: Column) -> Column:
    """0 hard, 1 moderate (also unknown), 2 trivial."""
    rank = F.lit(1)
    for name, value in fv.DIFFICULTY_RANK.items():
        rank = F.when(difficulty == name, value).otherwise(rank)
    return rank


def change_difficulty(changed_lines: Column, spans: Column | None = None) -> Column:
    """By the size of a real change."""
    wide = F.lit(False) if spans is None else spans >= fv.HISTORICAL_HARD_SPANS
    return (F.when((changed_lines >= fv.HISTORICAL_HARD) | wide, "hard")
            .when(changed_lines >= fv.HISTORICAL_MODERATE, "moderate").otherwise("trivial"))


def struggle_difficulty(struggle_hits: Column, changed_lines: Column) -> Column:
    """By how long the fix took, then by its size."""
    return (F.when((struggle_hits >= fv.STRUGGLE_HARD) | (changed_lines >= fv.FIX_LINES_HARD), "hard")
            .when((struggle_hits >= fv.STRUGGLE_MODERATE) | (changed_lines >= fv.FIX_LINES_MODERATE), "moderate")
            .otherwise("trivial"))


def operator_difficulty(operator: Column) -> Column:
    """By the mutation operator; unknown operators are moderate."""
    level = F.lit("moderate")
    for name, value in fv.OPERATOR_DIFFICULTY.items():
        level = F.when(operator == name, value).otherwise(level)
    return level


def combined_difficulty(hard: Column, moderate: Column, bugs: Column) -> Column:
    """As hard as the hardest bug; three or more bugs lift moderate to hard."""
    return (F.when(hard > 0, "hard").when((moderate > 0) & (bugs >= 3), "hard")
            .when(moderate > 0, "moderate").otherwise("trivial"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix + first 12 hex digits of the sha256 of the parts joined by '|'."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def opaque_node(node: Column) -> Column:
    """Content-free label of a test title."""
    return F.concat(F.lit("case_"), F.substring(F.sha2(node, 256), 1, 8))


def request_key(task_id: Column, candidate: Column, reference: Column | None = None) -> Column:
    """sha256 key of a judgement request; a reference-aware request has its own key space."""
    parts = [task_id, F.lit("\u0000CAND\u0000"), candidate]
    parts += [F.lit("\u0000NOREF\u0000")] if reference is None else [F.lit("\u0000REF\u0000"), F.coalesce(reference, F.lit(""))]
    return F.sha2(F.concat(*parts), 256)


def dedupe(pool: DataFrame) -> DataFrame:
    """One task per (codebase, module, bug_id), the earliest."""
    return keep_first(pool, ["codebase", "module", "bug_id"])


def quotas(pool: DataFrame, target: int) -> DataFrame:
    """codebase, pool_size, quota: equal shares, the remainder to the largest pools. One row per codebase."""
    sizes = pool.groupBy("codebase").agg(F.count(F.lit(1)).alias("pool_size"))
    everyone, largest = W.partitionBy(), W.orderBy(F.desc("pool_size"), "codebase")
    n = F.count(F.lit(1)).over(everyone)
    base = F.floor(F.lit(target) / n).cast("bigint")
    extra = F.when(F.row_number().over(largest) <= F.lit(target) - base * n, 1).otherwise(0)
    return sizes.select("codebase", "pool_size", (base + extra).cast("bigint").alias("quota"))


def select_panel(tasks: DataFrame, target: int = fv.PANEL_TARGET, prefer_depth: bool = True,
                 allow_trivial: bool = False) -> DataFrame:
    """The panel: hardest first within an equal budget per codebase; trivial only where nothing else exists.

    No codebase can place more than `target` tasks, so each map task keeps at
    most that many candidates per codebase before anything is shuffled.
    """
    pool = dedupe(tasks)
    budget = quotas(pool, target)
    if not allow_trivial:
        useful = pool.groupBy("codebase").agg(F.bool_or(F.coalesce(F.col("difficulty") != "trivial", F.lit(True))).alias("_useful"))
        pool = pool.join(useful, "codebase").filter(
            ~F.col("_useful") | F.coalesce(F.col("difficulty") != "trivial", F.lit(True))).drop("_useful")
    shallow = F.when(F.col("depth") == "function", 0).otherwise(1) if prefer_depth else F.lit(1)
    order = [difficulty_rank(F.col("difficulty")), shallow, "module", "line", "bug_id"]
    best = top_per_group(pool, ["codebase"], order, target)
    return best.join(budget.select("codebase", "quota"), "codebase").filter(
        F.col("rank_in_group") <= F.col("quota")).orderBy("codebase", "module", "line", "bug_id")


def panel_surplus(tasks: DataFrame, panel: DataFrame, target: int = fv.PANEL_TARGET,
                  expected: DataFrame | None = None) -> DataFrame:
    """Per codebase: pool size, quota, selected, surplus left out. Expected codebases without tasks appear with zeros."""
    budget = quotas(dedupe(tasks), target)
    taken = panel.groupBy("codebase").agg(F.count(F.lit(1)).alias("selected"))
    table = budget.join(taken, "codebase", "left")
    if expected is not None:
        table = expected.select("codebase").distinct().join(table, "codebase", "left")
    filled = table.fillna(0, ["pool_size", "quota", "selected"])
    return filled.withColumn("surplus", F.greatest(F.lit(0), F.col("pool_size") - F.col("selected"))).withColumn(
        "empty", F.col("pool_size") == 0)


def manifest_hash(panel: DataFrame, target: int = fv.PANEL_TARGET) -> DataFrame:
    """Order-free hash of which bugs are in the panel: one row. The panel has at most `target` tasks."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("codebase", "module", "bug_id", "test_node", "difficulty")]
    listed = F.replace(F.to_json(F.array(*fields)), F.lit('","'), F.lit('", "'))
    ordered = F.sort_array(F.collect_list(F.struct("codebase", "module", "bug_id", listed.alias("j"))))
    blob = F.concat(F.lit(f'{{"target": {target}, "tasks": ['),
                    F.array_join(F.transform(ordered, lambda x: x.getField("j")), ", "), F.lit("]}"))
    return panel.agg(F.substring(F.sha2(blob, 256), 1, 16).alias("manifest_hash"), F.count(F.lit(1)).alias("tasks"))


def round_robin_subset(tasks: DataFrame, n: int = 6, order: str = "ingest_seq") -> DataFrame:
    """n tasks, one per codebase in turn."""
    return top_per_group(tasks, ["codebase"], [order], n).orderBy("rank_in_group", "codebase").limit(n)


def seeded_sample(tasks: DataFrame, n: int, seed: int, key: str = "task_id") -> DataFrame:
    """Seeded shuffle cut at n; a smaller n is a prefix of a larger one."""
    return tasks.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def within_size(tasks: DataFrame, sizes: DataFrame, budget: int) -> DataFrame:
    """Tasks whose module is known and at most `budget` characters."""
    return tasks.join(sizes.filter(F.col("chars") <= budget).select("codebase", "module"), ["codebase", "module"], "left_semi")


def proximity_clusters(bugs: DataFrame, max_gap: int = fv.CLUSTER_MAX_GAP, width: int = 1 << 16) -> DataFrame:
    """Bugs with their cluster number inside (codebase, module)."""
    return gap_clusters(bugs, ["codebase", "module"], "line", max_gap, width=width)


def combinations(clustered: DataFrame, min_bugs: int = fv.COMBINE_MIN_BUGS, max_bugs: int = fv.COMBINE_MAX_BUGS) -> DataFrame:
    """Every run of 2..3 consecutive bugs of a cluster in (difficulty, line) order, on distinct test nodes.

    The hardest bug per test node stays (a map-side `min_by`). A run is the row
    and its next bugs, so nothing is gathered.
    """
    cluster = ["codebase", "module", "cluster"]
    rank = difficulty_rank(F.col("difficulty"))
    bug = F.struct(rank.alias("rank"), "line", "bug_id", "test_node", "difficulty")
    usable = clustered.groupBy(*cluster, "test_node").agg(F.min(bug).alias("bug"))
    order = W.partitionBy(*cluster).orderBy("bug.rank", "bug.line", "bug.bug_id")
    out = None
    for size in range(min_bugs, max_bugs + 1):
        runs = usable.select(*cluster, F.array(*[F.lead("bug", i).over(order) for i in range(size)]).alias("bugs")).filter(
            F.col("bugs")[size - 1].isNotNull())
        out = runs if out is None else out.unionByName(runs)
    count = lambda level: F.size(F.filter("bugs", lambda b: b.getField("difficulty") == level))
    lines = F.transform("bugs", lambda b: b.getField("line"))
    ids = F.transform("bugs", lambda b: b.getField("bug_id"))
    return out.select(
        *cluster, F.size("bugs").cast("bigint").alias("bugs_total"),
        (F.array_max(lines) - F.array_min(lines)).cast("bigint").alias("span_lines"),
        combined_difficulty(count("hard"), count("moderate"), F.size("bugs")).alias("difficulty"), "bugs",
        F.concat_ws("__", F.col("codebase").cast("string"), F.regexp_replace(F.col("module").cast("string"), r"[/.]", "_"),
                    F.substring(F.sha2(F.array_join(ids, "+"), 256), 1, 16)).alias("task_id"))


def killed_mutants(runs: DataFrame, green: DataFrame) -> DataFrame:
    """Mutants failing a test that is green at baseline: first failing node and how many fail.

    `runs`: codebase, bug_id, nodeid, outcome; `green`: codebase, nodeid.
    """
    failing = runs.filter(F.col("outcome").isin("failed", "error")).join(
        green.select("codebase", "nodeid").distinct(), ["codebase", "nodeid"], "left_semi")
    # distinct nodes first: one narrow row per (mutant, node)
    nodes = failing.select("codebase", "bug_id", "nodeid").distinct()
    return nodes.groupBy("codebase", "bug_id").agg(
        F.min("nodeid").alias("test_node"), F.count(F.lit(1)).alias("n_failing")).withColumn(
        "task_id", F.concat_ws("__", F.col("codebase").cast("string"), F.col("bug_id").cast("string")))

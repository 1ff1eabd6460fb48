"""Code as line tables: windows around a line, search/replace answers, operator mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from gradeloom import fixed_values as fv
from gradeloom.functions.text import lines, strip
from gradeloom.operators.panel import operator_difficulty, stable_id


def code_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per line, numbered from 1: path, n, line."""
    return files.select(path, F.posexplode(lines(F.col(text))).alias("n", "line")).withColumn("n", F.col("n") + 1)


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Replace the first occurrence of a plain string; unchanged when absent or empty."""
    pos = F.position(old, text)
    return F.when((pos > 0) & (F.length(old) > 0), F.concat(
        F.substring(text, F.lit(1), pos - 1), new, F.substring(text, pos + F.length(old), F.length(text)))).otherwise(text)


def apply_search_replace(before: Column, reply: Column) -> Column:
    """Blocks of a reply applied in order; each replaces its first occurrence, else its trimmed form, else nothing."""
    found = F.regexp_extract_all(reply, F.lit(fv.SEARCH_REPLACE), F.lit(1))
    replaced = F.regexp_extract_all(reply, F.lit(fv.SEARCH_REPLACE), F.lit(2))
    blocks = F.zip_with(found, replaced, lambda s, r: F.struct(s.alias("s"), r.alias("r")))

    def step(text, b):
        s, r = b.getField("s"), b.getField("r")
        return F.when(text.contains(s), replace_first(text, s, r)).when(
            text.contains(strip(s)), replace_first(text, strip(s), strip(r))).otherwise(text)

    return F.aggregate(blocks, before, step)


def focus_window(files: DataFrame, budget: int = fv.SCOPE_BUDGET_CHARS, text: str = "text", focus: str = "focus_line") -> DataFrame:
    """The lines around `focus` of a file above the budget: window, before, after (lines left out), truncated.

    A file within the budget is kept whole. The window moves inward at the ends of the file.
    """
    ls = lines(F.col(text))
    total = F.size(ls)
    per = max(budget // fv.SCOPE_CHARS_PER_LINE, 1)
    half = max(per // 2, 1)
    idx = F.least(F.greatest(F.col(focus) - 1, F.lit(0)), total - 1)
    end = F.least(total, F.greatest(F.lit(0), idx - half) + per)
    start = F.greatest(F.lit(0), end - per)
    big = F.length(text) > budget
    return files.select(
        "*", big.alias("truncated"),
        F.when(big, F.array_join(F.slice(ls, start + 1, end - start), "\n")).otherwise(F.col(text)).alias("window"),
        F.when(big, start).otherwise(0).cast("bigint").alias("lines_before"),
        F.when(big, total - end).otherwise(0).cast("bigint").alias("lines_after"))


def mutants(code: DataFrame, per_file: int | None = None, path: str = "path") -> DataFrame:
    """One mutant per line and applicable operator: bug_id, symbol, operator, difficulty, n, original, mutated.

    The operator table is a literal of the plan and is matched inside the row.
    `symbol` is the last definition at or above the line. No-ops and repeated
    ids drop. With `per_file` each file keeps its first so many in (line, operator) order.
    """
    ops = F.array(*[F.struct(F.lit(n).alias("operator"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in fv.OPERATOR_SWAPS])
    named = F.regexp_extract("line", r"^\s*(?:def|class|function)\s+(\w+)", 1)
    above = W.partitionBy(path).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    with_symbol = code.withColumn("symbol", F.coalesce(
        F.last(F.when(F.length(named) > 0, named), ignorenulls=True).over(above), F.lit("<module>")))
    usable = with_symbol.filter(~F.ltrim("line").startswith("#"))
    hits = usable.withColumn("op", F.explode(F.filter(ops, lambda o: F.col("line").contains(o.getField("a")))))
    made = hits.select(
        path, "n", "symbol", F.col("op.operator").alias("operator"), F.col("line").alias("original"),
        replace_first(F.col("line"), F.col("op.a"), F.col("op.b")).alias("mutated")).filter("original <> mutated")
    made = made.withColumn("bug_id", stable_id("mut_", F.col(path), F.col("symbol"), F.col("operator"), F.col("n").cast("string")))
    made = made.withColumn("difficulty", operator_difficulty(F.col("operator")))
    if per_file is None:
        return made
    order = W.partitionBy(path).orderBy("n", "operator")
    return made.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= per_file).drop("_k")


def apply_mutants(code: DataFrame, chosen: DataFrame, path: str = "path") -> DataFrame:
    """Each file with its chosen mutants in place: path, text, applied.

    Mutants meet their lines by an equality join, so no line number shifts. A
    file is as long as it was; several mutants of one line apply in operator order.
    """
    swap = {n: (a, b) for n, a, b in fv.OPERATOR_SWAPS}
    per_line = chosen.groupBy(path, "n").agg(F.sort_array(F.collect_set("operator")).alias("ops"))
    joined = code.join(per_line, [path, "n"], "left")

    def step(line, op):
        out = line
        for name, (a, b) in swap.items():
            out = F.when(op == name, replace_first(line, F.lit(a), F.lit(b))).otherwise(out)
        return out

    line = F.aggregate(F.coalesce("ops", F.array().cast("array<string>")), F.col("line"), step)
    return joined.withColumn("line", line).groupBy(path).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x.getField("line")), "\n").alias("text"),
        F.coalesce(F.sum(F.size("ops")), F.lit(0)).cast("bigint").alias("applied"))

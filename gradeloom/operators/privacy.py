"""Redaction, anonymisation and the publish gate."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import fixed_values as fv
from gradeloom.functions.hashing import pseudonym


def _substitute(text: Column, rule: Column) -> Column:
    """Every match replaced by its pseudonym: the pieces between matches, joined by the stand-ins.

    A pattern with groups keeps its first group and hides the second.
    """
    take = lambda i: F.regexp_extract_all(text, rule["pattern"], F.lit(i))
    stand_ins = F.when(rule["grouped"], F.zip_with(take(1), take(2), lambda keep, hide: F.concat(keep, pseudonym(rule["tag"], hide)))).otherwise(
        F.transform(take(0), lambda m: pseudonym(rule["tag"], m)))
    return F.array_join(F.zip_with(F.split(text, rule["pattern"], -1), stand_ins, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")


def _may_match(text: Column, tag: str) -> Column:
    """Does the text contain what each match of the rule contains? Literals are searched as bytes."""
    kind, hints = fv.RULE_HINTS.get(tag, ("none", ()))
    if kind == "none":
        return text.isNotNull()
    test = {"literal": lambda h: F.contains(text, F.lit(h)), "any case": lambda h: F.contains(F.lower(text), F.lit(h)), "pattern": lambda h: F.rlike(text, F.lit(h))}[kind]
    return reduce(or_, [test(h) for h in hints])


def redact(df: DataFrame, columns: Iterable[str], pii: bool = True, count: str = "replacements",
           extra: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Replace secrets (and, with `pii`, identities) in the columns by `<TAG:sha8>`; add how many were replaced.

    `extra` adds (tag, pattern) rules of the caller's own. Rules run in table
    order, each on the text the one before it left. One projection per column
    tells by required literals which rules a text may match, and folds only
    those over it: a text without any literal meets no pattern. A stand-in
    (tag and hex digits) can't bring in a literal that the text didn't have.
    """
    built_in = [(t, p, t) for t, p in (*fv.SECRET_PATTERNS, *(fv.PII_PATTERNS if pii else ()))]
    rules = [*built_in, *((t, p, None) for t, p in extra)]  # a rule of the caller has no known literal
    out = df.withColumn(count, F.lit(0).cast("bigint"))
    for column in columns:
        text = F.col(column)
        tried = F.array_compact(F.array(*[
            F.when(_may_match(text, hint or ""), F.struct(F.lit(tag).alias("tag"), F.lit(pattern).alias("pattern"), F.lit(re.compile(pattern).groups > 0).alias("grouped")))
            for tag, pattern, hint in rules]))

        def step(done: Column, rule: Column) -> Column:
            found = F.regexp_count(done["text"], rule["pattern"]).cast("bigint")
            return F.when(found > 0, F.struct(_substitute(done["text"], rule).alias("text"), (done["found"] + found).alias("found"))).otherwise(done)

        whole = F.aggregate(tried, F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("found")), step)
        out = out.withColumn("_done", whole).withColumn(column, F.col("_done.text")).withColumn(count, F.col(count) + F.col("_done.found"))
    return out.drop("_done")


def anonymise(df: DataFrame, columns: Iterable[str], context: Iterable[tuple[str, str]],
              projects: DataFrame | None = None, blank: Iterable[str] = ()) -> DataFrame:
    """Context words replaced in order, ignoring case; projects mapped (unknown = project-x); session fields blanked.

    `projects`: project, alias.
    """
    out = df
    for column in columns:
        text = F.col(column)
        for pattern, replacement in context:
            text = F.regexp_replace(text, "(?i)" + pattern, replacement)
        out = out.withColumn(column, text)
    if projects is not None:
        out = out.join(projects.select("project", "alias"), "project", "left").withColumn(
            "project", F.coalesce("alias", F.lit("project-x"))).drop("alias")
    for column in blank:
        out = out.withColumn(column, F.lit(""))
    return out


def active_patterns(tier: str = "public", private: Iterable[tuple[str, str]] = ()) -> tuple[tuple[str, str], ...]:
    """Patterns a tier forbids: all in public, credentials in private, none in the acknowledged raw tier."""
    if tier not in fv.SWEEP_TIERS:
        raise ValueError(f"unknown tier {tier!r}")
    if tier == "raw":
        return ()
    credentials = fv.SWEEP_CREDENTIALS
    return credentials if tier == "private" else (*credentials, *fv.PII_PATTERNS, *private)


def findings(lines: DataFrame, tier: str = "public", private: Iterable[tuple[str, str]] = (),
             line: str = "line", keep: Iterable[str] = ("path", "n")) -> DataFrame:
    """(path, n, pattern, matches): each forbidden pattern on each line. Patterns are literals of the plan, matched in the row."""
    rules = active_patterns(tier, private)
    none = F.lit(None).cast("struct<pattern:string,matches:bigint>")
    hits = [none] + [F.when(F.col(line).rlike(p), F.struct(
        F.lit(name).alias("pattern"), F.regexp_count(line, F.lit(p)).cast("bigint").alias("matches"))) for name, p in rules]
    return lines.select(*keep, F.explode(F.array_compact(F.array(*hits))).alias("f")).select(*keep, "f.pattern", "f.matches")


def publish_verdict(found: DataFrame, strict: bool = False) -> DataFrame:
    """One row: findings, publishable. With `strict` any finding raises when the row is read."""
    out = found.agg(F.coalesce(F.sum("matches"), F.lit(0)).cast("bigint").alias("findings"))
    ok = F.col("findings") == 0
    if strict:
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(
            F.lit("refusing to publish: "), F.col("findings").cast("string"), F.lit(" findings"))).cast("boolean"))
    return out.withColumn("publishable", ok)


def publish_drift(private: DataFrame, public: DataFrame, key: str, text: str) -> DataFrame:
    """One row: ids missing from the public set, ids it invents, and texts whose token count changed.

    Both sides meet in one aggregation by id.
    """
    tokens = F.size(F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda t: F.length(t) > 0))
    side = lambda df, name: df.select(key, F.lit(name).alias("side"), tokens.alias("n"))
    count = lambda name: F.count_if(F.col("side") == name)
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("n")))
    per = side(private, "private").unionByName(side(public, "public")).groupBy(key).agg(
        count("private").alias("a"), count("public").alias("b"), of("private").alias("na"), of("public").alias("nb"))
    return per.agg(
        F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))), F.lit(0)).alias("added"),
        F.count_if((F.col("a") > 0) & (F.col("b") > 0) & (F.col("na") != F.col("nb"))).alias("drifted")).withColumn(
        "same", (F.col("missing") == 0) & (F.col("added") == 0) & (F.col("drifted") == 0))

"""Outcome taxonomy: every row resolves to one state, only `completed` is scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import fixed_values as fv
from gradeloom.functions.replies import first_object
from gradeloom.functions.text import contains_any, extract_code, first_match, has_code, matches, strip

ERROR_FIELDS = ("diagnose_error", "repair_error", "repair_given_error")


def error_text(df: DataFrame) -> Column:
    """All stage errors of a row as one string."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ERROR_FIELDS if c in df.columns])


def classify_error(error: Column) -> Column:
    """struct(retryable, kind), NULL when there is no error. Unknown is not retryable."""
    text = strip(error)
    fatal = first_match(text, fv.NO_RETRY_ERRORS)
    passing = first_match(text, fv.RETRY_ERRORS)
    return F.when(F.length(text) > 0, F.struct(
        (fatal.isNull() & passing.isNotNull()).alias("retryable"),
        F.coalesce(fatal, passing, F.lit("unknown")).alias("kind")))


def nonempty(column: Column) -> Column:
    return F.length(F.coalesce(column.cast("string"), F.lit(""))) > 0


def stored_taint(df: DataFrame) -> Column:
    test = F.lit(False)
    for name in ("tainted", "taint_reason"):
        if name in df.columns:
            test = test | nonempty(F.col(name))
    return test


def with_state(df: DataFrame) -> DataFrame:
    """Add `state` and `error_class`. The first matching rule wins."""
    err = error_text(df)
    empty_reply = F.coalesce(F.col("empty_reply"), F.lit(False)) if "empty_reply" in df.columns else F.lit(False)
    candidate = F.col("repair.candidate")
    state = (F.when(stored_taint(df), "tainted")
             .when(err.rlike(fv.POLICY_BLOCKED), "policy_blocked")
             .when(F.length(strip(err)) > 0, "infra_error")
             .when(empty_reply, "invalid_response")
             .when(candidate.isNotNull() & ~has_code(candidate), "invalid_response")
             .otherwise("completed"))
    return df.withColumn("state", state).withColumn("error_class", classify_error(err))


def retryable_rows(df: DataFrame) -> DataFrame:
    """Rows whose transport failure another attempt can fix."""
    return with_state(df).filter((F.col("state") == "infra_error") & F.col("error_class.retryable"))


def parse_reply(reply: Column) -> Column:
    """struct(code, has_diff, wants_tools, and the diagnosis fields under their canonical names)."""
    low = F.lower(F.coalesce(reply, F.lit("")))
    fence = F.regexp_extract(F.coalesce(reply, F.lit("")), "(?s)" + fv.FENCE, 1)
    body = F.when(F.length(fence) > 0, fence).otherwise(reply)
    pairs = F.from_json(first_object(body), "map<string,string>")
    keyed = F.transform_keys(pairs, lambda k, v: F.replace(F.lower(k), F.lit(" "), F.lit("_")))

    def alias(names):
        return F.coalesce(*[F.when(F.length(F.try_element_at(keyed, F.lit(n))) > 0,
                                   F.try_element_at(keyed, F.lit(n))) for n in names])

    old = F.regexp_extract(reply, fv.PATCH_OLD_HEADER, 1)
    new = F.regexp_extract(reply, fv.PATCH_NEW_HEADER, 1)
    bare = lambda p: F.regexp_replace(p, r"^[ab/]+", "")
    has_diff = (F.length(old) > 0) & (bare(old) == bare(new)) & F.coalesce(reply, F.lit("")).rlike(r"(?m)^@@")
    return F.struct(
        extract_code(F.coalesce(reply, F.lit(""))).alias("code"),
        has_diff.alias("has_diff"),
        F.coalesce(reply, F.lit("")).rlike(fv.TOOL_CALL_MARKERS).alias("wants_tools"),
        contains_any(low, fv.REFUSAL_MARKERS).alias("refuses"),
        contains_any(low, fv.NO_EDIT_MARKERS).alias("declines"),
        *[alias(names).alias(field) for field, names in fv.DIAGNOSIS_ALIASES.items()])


def attempt_outcome(reply: Column, has_patch: Column, wants_tools: Column,
                    transport_error: Column | None = None, smuggled_tests: Column | None = None) -> Column:
    """Outcome of one attempt: transport and smuggled tests override what the reply says."""
    text = F.coalesce(reply, F.lit(""))
    low = F.lower(text)
    said = (F.when(F.length(strip(text)) == 0, "invalid_response")
            .when(contains_any(low, fv.REFUSAL_MARKERS), "refused")
            .when(~has_patch & wants_tools, "needs_tools")
            .when(~has_patch & contains_any(low, fv.NO_EDIT_MARKERS), "declined_work")
            .when(~has_patch, "invalid_response")
            .otherwise("scored"))
    if smuggled_tests is not None:
        said = F.when(smuggled_tests, "policy_violation").otherwise(said)
    if transport_error is not None:
        said = F.when(nonempty(transport_error), "transport").otherwise(said)
    return said


def transport_retryable(error: Column) -> Column:
    return contains_any(F.lower(F.coalesce(error, F.lit(""))), fv.RETRYABLE_TRANSPORT)


def refuses(raw: Column) -> Column:
    return matches(raw, fv.REFUSAL_TEXT, ignore_case=True)

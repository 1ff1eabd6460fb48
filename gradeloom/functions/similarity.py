"""Sequence similarity: the two measures no built-in expression covers.

Both run on rows that cheap SQL bounds could not decide. NULL input means
"already decided" and costs nothing. The functions take a row at a time, in
Spark's batches of some hundred rows: whole texts in Arrow batches of ten
thousand rows, with their copies and results, would fill gigabytes of Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from gradeloom import fixed_values as fv
from gradeloom.functions.matching import matching_ratio


def by_row(returns: T.DataType) -> Callable:
    """A function of one row's values as a function of columns; its `func` takes Series, as that of a pandas function."""
    def wrap(one: Callable) -> Callable:
        column = F.udf(one, returnType=returns, useArrow=False)
        column.func = lambda *series: pd.Series([one(*values) for values in zip(*series)])
        return column
    return wrap


def common_subsequence_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one big-integer row per token of `a`.

    Shared ends are stripped first; the rest uses the bit-vector recurrence
    (Hyyrö 2004), so a pair costs len(a) integer operations of len(b) bits.
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    where: dict[str, int] = {}
    for at, token in enumerate(b):
        where[token] = where.get(token, 0) | (1 << at)
    full = (1 << len(b)) - 1
    open_bits = full
    for token in a:
        hits = open_bits & where.get(token, 0)
        open_bits = ((open_bits + hits) | (open_bits - hits)) & full
    return head + tail + len(b) - open_bits.bit_count()


@by_row(T.DoubleType())
def token_similarity(left: str | None, right: str | None) -> float | None:
    """2 * LCS / (tokens left + tokens right); 0 when either side has no token."""
    if left is None or right is None:
        return None
    x, y = re.findall(fv.TOKEN, left), re.findall(fv.TOKEN, right)
    return 2.0 * common_subsequence_length(x, y) / (len(x) + len(y)) if x and y else 0.0


@by_row(T.DoubleType())
def character_ratio(left: str | None, right: str | None) -> float | None:
    """Share of the characters of two strings that lie in their longest common blocks (see `matching`)."""
    return None if left is None or right is None else matching_ratio(left, right)


@by_row(T.StringType())
def normalize_identifiers(text: str | None) -> str | None:
    """Tokens joined by spaces, each identifier replaced by ID<n> in first-seen order."""
    if text is None:
        return None
    seen: dict[str, str] = {}
    return " ".join(seen.setdefault(t, f"ID{len(seen)}") if t.isidentifier() else t for t in re.findall(fv.TOKEN, text))


def length_bound(left_len: Column, right_len: Column) -> Column:
    """Upper bound of any matching ratio, from the two lengths alone."""
    return 2 * F.least(left_len, right_len) / F.nullif(left_len + right_len, F.lit(0))

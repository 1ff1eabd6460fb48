"""JSON objects inside free text, which no built-in expression finds."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F, types as T

_BRACE = re.compile(r"[{}]")


def _balanced_end(text: str, start: int) -> int:
    """The place after the brace that closes the one at `start`, or -1."""
    depth = 0
    for brace in _BRACE.finditer(text, start):
        depth += 1 if brace.group() == "{" else -1
        if not depth:
            return brace.end()
    return -1


def _first(text: str | None) -> str | None:
    at, decoder = text.find("{") if text else -1, json.JSONDecoder()
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            # not JSON: its inner objects aren't answers, the next one may be
            end = _balanced_end(text, at)
            at = text.find("{", end) if end > 0 else -1
            continue
        flat = {k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":")) for k, v in found.items()}
        return json.dumps(flat, ensure_ascii=False)
    return None


@F.pandas_udf(T.StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first top-level JSON object of each text that parses, at any depth and size, with its values as strings; else NULL."""
    return texts.map(_first)

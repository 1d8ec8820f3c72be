"""Fuzzy name similarity: token-sorted ratio by longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (one big integer per row)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def token_sort_ratio(a: str, b: str) -> float:
    """Percent: twice the common subsequence over both lengths, after sorting words; two empty names are equal."""
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not x and not y:
        return 100.0
    return 200.0 * common_subsequence(x, y) / (len(x) + len(y))


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``token_sort_ratio`` of two name columns; null if either is null."""
    return pd.Series([None if x is None or y is None else token_sort_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def strong_name_match(a, b, ratio, least: float = 90.0):
    """Both names non-empty, equal sets of digit runs, and a ratio of at least ``least``."""
    runs = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+)"))))
    return (a != "") & (b != "") & (runs(a) == runs(b)) & (ratio >= least)

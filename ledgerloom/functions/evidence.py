"""Weighted similarity over signals that may be unavailable, with its evidence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def set_jaccard(a: Column, b: Column) -> Column:
    """Percent of shared values; null, not zero, if either set is empty or null."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 100 * F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def set_containment(a: Column, b: Column) -> Column:
    """Percent of the smaller set that the other holds; null if either is empty or null."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 100 * F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def same_value(a: Column, b: Column, fold: Callable[[Column], Column] = F.lower) -> Column:
    """100 or 0 for two texts; null if either is blank: unknown values are not unequal."""
    x, y = fold(F.btrim(a)), fold(F.btrim(b))
    return F.when((x != "") & (y != ""), F.when(x == y, F.lit(100.0)).otherwise(F.lit(0.0)))


def weighted(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean of the available signals by their weights, renormalised over these; null if none is available."""
    total = _sum([F.when(signals[k].isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for k, w in weights.items()])
    points = _sum([F.coalesce(signals[k] * F.lit(float(w)), F.lit(0.0)) for k, w in weights.items()])
    return F.when(total > 0, points / total)


def ceiling(signals: dict[str, Column], weights: dict[str, float], cheap: list[str]) -> Column:
    """The most that ``weighted`` can reach if only the cheap signals are known: the rest counts in full."""
    known = [F.coalesce(signals[k], F.lit(100.0)) * F.lit(float(weights[k])) for k in cheap]
    rest = sum(w for k, w in weights.items() if k not in cheap)
    return (_sum(known) + F.lit(100.0 * rest)) / F.lit(float(sum(weights.values())))


def evidence_text(signals: dict[str, Column]) -> Column:
    """'field=87%; name=n/a': every signal, whole percent, in order."""
    return F.concat_ws("; ", *[F.concat(F.lit(k + "="), F.coalesce(F.concat(F.bround(c).cast("long").cast("string"), F.lit("%")), F.lit("n/a"))) for k, c in signals.items()])


def relation(overall: Column, contained: Column, names: dict[float, str], contained_name: str, contained_least: float, overall_least: float, otherwise: str) -> Column:
    """First label that holds: the highest band, then containment with enough overall similarity, then lower bands."""
    bands = sorted(names.items(), reverse=True)
    out = F.when(overall >= bands[0][0], bands[0][1]).when((contained >= contained_least) & (overall >= overall_least), contained_name)
    for least, name in bands[1:]:
        out = out.when(overall >= least, name)
    return out.otherwise(otherwise)

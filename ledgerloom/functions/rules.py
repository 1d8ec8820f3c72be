"""Parameterised rule expressions: tiers, labels, capped credits, reason trails, masking."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def tier(value: Column, above: Iterable[tuple[float, float]], if_null: float, otherwise: float = 0) -> Column:
    """Points of the first bound (descending) that the value strictly exceeds; nulls have their own."""
    out = F.when(value.isNull(), F.lit(if_null))
    for bound, points in sorted(above, reverse=True):
        out = out.when(value > bound, F.lit(points))
    return out.otherwise(F.lit(otherwise))


def label_at_least(value: Column, labels: dict[float, str]) -> Column:
    """Label of the highest minimum that the value reaches; null and lower values get the lowest label."""
    ordered = sorted(labels.items(), reverse=True)
    out = F.when(value >= ordered[0][0], F.lit(ordered[0][1]))
    for least, name in ordered[1:]:
        out = out.when(value >= least, F.lit(name))
    return out.otherwise(F.lit(ordered[-1][1]))


def label_at_most(value: Column, labels: dict[float, str]) -> Column:
    """Label of the lowest inclusive maximum that the value stays within."""
    ordered = sorted(labels.items())
    out = F.when(value <= ordered[0][0], F.lit(ordered[0][1]))
    for most, name in ordered[1:]:
        out = out.when(value <= most, F.lit(name))
    return out


def capped(total: Column, most: float) -> Column:
    return F.greatest(F.lit(0), F.least(total, F.lit(most)))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days between the dates of two times."""
    return F.datediff(F.to_date(later), F.to_date(earlier))


def flags(named: dict[str, Column]) -> Column:
    """Sorted-by-declaration list of the names whose condition holds."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]), lambda x: x.isNotNull())


def trail(entries: list[tuple[str, Column, Column]]) -> Column:
    """Ordered reason trail: (category, label, points) of the entries whose label is not null."""
    rows = F.array(*[F.struct(F.lit(c).alias("category"), label.alias("label"), p.cast("int").alias("points")) for c, label, p in entries])
    return F.filter(rows, lambda x: x["label"].isNotNull())


def render_trail(c: Column) -> Column:
    """'+30 label; label2': a sign before positive points, none for reasons without points."""
    one = lambda x: F.concat(F.when(x["points"].isNull(), F.lit("")).otherwise(F.concat(F.when(x["points"] >= 0, F.lit("+")).otherwise(F.lit("")), x["points"].cast("string"), F.lit(" "))), x["label"])
    return F.array_join(F.transform(c, one), "; ")


def mask(c: Column) -> Column:
    """Three stars for any value that is not blank."""
    return F.when(F.btrim(c) != "", F.lit("***")).otherwise(c)


def spreadsheet_safe(c: Column) -> Column:
    """A text that a spreadsheet would run as a formula is led by an apostrophe."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)

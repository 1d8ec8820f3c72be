"""Validation of hand-labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked_pairs(df: DataFrame, a: Column, b: Column, label: Column, known_label: Column, percents: list[str]) -> DataFrame:
    """``df`` plus ``error``: the first thing wrong with a row, null if it is good.

    In order: a missing end, a pair of one record with itself, an unknown label, a percentage outside 0..100.
    """
    rules = [(a.isNull() | b.isNull(), "missing end"), (a == b, "same record"), (label.isNotNull() & ~F.coalesce(known_label, F.lit(False)), "unknown label")]
    rules += [(F.col(c).isNotNull() & ~F.col(c).between(0, 100), f"{c} out of range") for c in percents]
    return df.withColumn("error", F.coalesce(*[F.when(cond, F.lit(text)) for cond, text in rules]))


def repeated_pairs(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(a, b, n) of pairs that occur more than once in either order, a < b."""
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")

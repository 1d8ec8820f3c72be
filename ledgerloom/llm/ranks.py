"""Ranks within classes of any size: no class is ever ordered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_within(df: DataFrame, cls: str, key: str, salts: int = 64) -> DataFrame:
    """``df`` plus ``_rank`` (from 0, dense, unique) within ``cls``; ``key`` is unique and not null.

    Each class is cut into ``salts`` parts by a hash of the key; a part is ranked alone and shifted by the
    size of the parts before it. Deterministic.
    """
    parts = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    counts = parts.groupBy(cls, "_salt").agg(F.count("*").alias("_n"))
    before = counts.select(cls, "_salt", (F.sum("_n").over(Window.partitionBy(cls).orderBy("_salt")) - F.col("_n")).alias("_before"))
    inner = parts.withColumn("_in", F.row_number().over(Window.partitionBy(cls, "_salt").orderBy(key)))
    return inner.join(before, [cls, "_salt"]).withColumn("_rank", F.col("_before") + F.col("_in") - 1).drop("_salt", "_in", "_before")

"""A lookup whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def looked_up(big: DataFrame, small: DataFrame, key: str, by: str | list[str], size: str, limit: int = 100_000, salts: int = 32) -> DataFrame:
    """``big`` left-joined with ``small``, which has one row per ``key`` and the key's rows in ``big`` in ``size``.

    Keys of more than ``limit`` rows are met in ``salts`` parts by a hash of ``by``; there are few of them, whatever
    the input. ``size`` is not part of the result.
    """
    rest = [c for c in small.columns if c not in (key, size)]
    salt = F.pmod(F.xxhash64(*([by] if isinstance(by, str) else by)), F.lit(salts)).cast("int")
    hot = small.where(F.col(size) > limit).select(F.col(key), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.struct(*rest).alias("_hot"))
    cool = small.where(F.col(size) <= limit).select(F.col(key), F.lit(-1).alias("_salt"), F.struct(*rest).alias("_cool"))
    first = big.withColumn("_salt", salt).join(hot, [key, "_salt"], "left")
    # rows that were met already keep their salt, so they are spread in the second join too
    second = first.withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(-1)).otherwise(F.col("_salt"))).join(cool, [key, "_salt"], "left")
    return second.select(*big.columns, *[F.coalesce(F.col("_hot")[c], F.col("_cool")[c]).alias(c) for c in rest])

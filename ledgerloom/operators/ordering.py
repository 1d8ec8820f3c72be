"""Global ranks without a global sort in one task, best matches and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.storage import Workspace


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """``df`` plus its place (from 1) by ``order``, which must be unique.

    Range partitions are ranked alone and shifted by the sizes of those before, of which there is one row each.
    """
    w = Window.partitionBy("_part").orderBy(*order)
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.row_number().over(w))
    local = Workspace(df.sparkSession, "rank").write(parts, "ranked")
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return local.join(F.broadcast(shift), "_part").withColumn(out, F.col("_in") + F.col("_b")).drop("_part", "_in", "_b")


def both_directions(pairs: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """Each pair from either end: (uid, partner, ...)."""
    ends = F.explode(F.array(F.struct(F.col(a).alias("uid"), F.col(b).alias("partner")), F.struct(F.col(b).alias("uid"), F.col(a).alias("partner")))).alias("e")
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(ends, *keep).select("e.*", *keep)


def best_partner(directed: DataFrame, score: Column) -> DataFrame:
    """(uid, partner, score, n_partners): highest score, ties to the lowest partner; partially aggregated."""
    best = F.max(F.struct(score.alias("s"), (-F.col("partner")).alias("p")))
    return directed.groupBy("uid").agg(best.alias("b"), F.count("*").alias("n_partners")).select("uid", (-F.col("b.p")).alias("partner"), F.col("b.s").alias("score"), "n_partners")


def top_partners(directed: DataFrame, score: str, k: int) -> DataFrame:
    """The ``k`` best partners per uid with their place; the group limit also applies before the shuffle."""
    w = Window.partitionBy("uid").orderBy(F.desc(score), "partner")
    return directed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)

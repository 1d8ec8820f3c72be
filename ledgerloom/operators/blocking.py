"""Candidate pairs by inverted-index blocking, and their set similarities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_sizes(keys: DataFrame, key: str, least: int = 2, most: int = 400) -> DataFrame:
    """Keys whose block holds between ``least`` and ``most`` records; others don't discriminate."""
    return keys.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n").between(least, most)).select(key)


def shared_counts(items: DataFrame, uid: str, item: str, most: int = 400) -> DataFrame:
    """(a, b, shared) of records that share items of useful blocks, a < b; ``items`` is distinct.

    Blocks are bounded by ``most``, so no key is hot in the self-join and a block gives at most most^2/2 rows.
    Shared counts are of the useful items only.
    """
    useful = items.join(block_sizes(items, item, 2, most), item, "left_semi").select(F.col(uid).alias("u"), F.col(item).alias("i"))
    x, y = useful.select(F.col("u").alias("a"), "i"), useful.select(F.col("u").alias("b"), "i")
    return x.join(y, "i").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def with_overlap(pairs: DataFrame, sets: DataFrame, uid: str, items: str) -> DataFrame:
    """Pairs plus exact overlap of their whole sets: shared, jaccard and containment in percent, one decimal."""
    a = sets.select(F.col(uid).alias("a"), F.col(items).alias("_x"))
    b = sets.select(F.col(uid).alias("b"), F.col(items).alias("_y"))
    j = pairs.select("a", "b").join(a, "a").join(b, "b").withColumn("shared", F.size(F.array_intersect("_x", "_y")))
    union = F.size("_x") + F.size("_y") - F.col("shared")
    return j.select("a", "b", "shared", F.bround(100 * F.col("shared") / union, 1).alias("jaccard"), F.bround(100 * F.col("shared") / F.least(F.size("_x"), F.size("_y")), 1).alias("containment"))


def least_shared(jaccard: float, containment: float) -> float:
    """Share of the smaller set that a pair has in common at least, if either percentage (of one decimal) is reached."""
    j, c = max(0.0, jaccard - 0.05) / 100, max(0.0, containment - 0.05) / 100
    return min(c, 2 * j / (1 + j))


def linked_sets(sets: DataFrame, uid: str, items: str, jaccard: float = 50.0, containment: float = 80.0) -> DataFrame:
    """All pairs that share an item and reach either percentage, with their overlap; ``items`` are distinct.

    No block is left out: the smaller set of such a pair shares one of its rarest items (prefix filter), so only
    these meet the lists of all sets that hold the item. The result is exact and does not depend on block sizes.
    """
    each = sets.select(F.col(uid).alias("u"), F.size(items).alias("n"), F.explode(items).alias("i"))
    frequency = each.groupBy("i").agg(F.count("*").alias("f"))
    shared = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(least_shared(jaccard, containment)) - F.lit(1e-9))).cast("int")
    rarest = each.join(frequency.where("f > 1"), "i", "left").groupBy("u", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "i"))).alias("o"))
    small = rarest.select(F.col("u").alias("a"), F.col("n").alias("na"), F.explode(F.slice("o", F.lit(1), F.col("n") - shared + 1)).alias("x")).where("x.f > 1").select("a", "na", F.col("x.i").alias("i"))
    met = small.join(each.select(F.col("u").alias("b"), F.col("n").alias("nb"), "i"), "i").where("na < nb or (na = nb and a < b)")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return with_overlap(pairs, sets, uid, items).where((F.col("jaccard") >= jaccard) | (F.col("containment") >= containment))

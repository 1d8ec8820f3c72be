"""Best representative of each duplicate group (p6).

Records are ranked by window ordering with a total order. A group may hold a third of all rows: the first
window ranks inside hash parts of a group, the second only the parts' winners, so no task orders a whole
group. The surviving record takes each field from the best member that has it, again in two steps, by
aggregation instead of ordering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.names import NULL_TOKENS, squeeze


def keepers(records: DataFrame, group: str, uid: str, order: list[Column], salts: int = 64) -> DataFrame:
    """(group, uid, member_count) of the first record of each group of two or more.

    ``order`` sorts best first and is followed by ``uid``, which is unique. Rows without group or uid take
    no part; no groups give an empty result.
    """
    named = records.where(F.col(group).isNotNull() & F.col(uid).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(uid), F.lit(salts)))
    part = Window.partitionBy(group, "_salt").orderBy(*order, F.col(uid))
    whole = Window.partitionBy(group).orderBy(*order, F.col(uid))
    counted = named.groupBy(group).agg(F.count("*").alias("member_count")).where("member_count > 1")
    winners = named.withColumn("_r", F.row_number().over(part)).where("_r = 1").withColumn("_r", F.row_number().over(whole)).where("_r = 1")
    return winners.select(group, uid).join(counted, group)


def survivors(records: DataFrame, group: str, uid: str, rank: Column, fields: list[str]) -> DataFrame:
    """One built record per group of two or more: each field from the best-ranked member that has it.

    ``rank`` is a struct that compares smaller for better records and ends in the uid. A null, a blank text
    or a null token is no value; a field that no member has is null.
    """
    named = records.where(F.col(group).isNotNull() & F.col(uid).isNotNull()).withColumn("_rank", rank)
    types = dict(named.dtypes)
    has = {c: F.col(c).isNotNull() & ~F.lower(squeeze(F.col(c))).isin(NULL_TOKENS) if types[c] == "string" else F.col(c).isNotNull() for c in fields}
    best = [F.min(F.when(has[c], F.struct("_rank", F.col(c).alias("v")))).alias(f"b_{c}") for c in fields]
    out = named.groupBy(group).agg(F.count("*").alias("member_count"), F.min("_rank").alias("_first"), *best).where("member_count > 1")
    return out.select(group, "member_count", F.col(f"_first.{uid}").alias("keeper_uid"), *[F.col(f"b_{c}.v").alias(c) for c in fields])

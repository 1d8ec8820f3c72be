"""Mixed timestamp formats and zones to one UTC instant (problem 3 of the general list: p7).

Zones that a site table lacks are estimated: each candidate zone stands for one history of offsets; the
site's zone-less local times, converted under each, are held against the time the row was ingested. A row
that would start after its own ingestion violates the candidate. The candidate with the fewest violations
wins; among equals the one with the smallest ingestion lag, then the first name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ledgerloom.functions import instants as _inst
from ledgerloom.storage import spread


@pandas_udf(T.LongType())
def _utc_micros(text: pd.Series, zone: pd.Series, order: pd.Series) -> pd.Series:
    f = _inst.to_utc
    out = [f(t, z, o) for t, z, o in zip(text.tolist(), zone.tolist(), order.tolist())]
    return pd.Series(out, dtype="Int64")


@pandas_udf(T.LongType())
def _local_micros(text: pd.Series, order: pd.Series) -> pd.Series:
    def one(t, o):
        got = _inst.parse(t, o)
        return got[1] if got is not None and got[0] == "local" and got[2] is None else None

    return pd.Series([one(t, o) for t, o in zip(text.tolist(), order.tolist())], dtype="Int64")


def utc_micros(text: Column | str, zone: Column | str, order: Column | str) -> Column:
    """UTC microseconds of a timestamp text; null where the text is no real instant.

    Null or unusable text, an unknown abbreviation, a date that does not exist, a local time that the clocks
    skip, and a zone-less text without a zone all give null.
    """
    return _utc_micros(text, zone, order)


def estimate_zones(rows: DataFrame, candidates: list[str], site: str = "site_code", text: str = "text", seen: str = "loaded_at") -> DataFrame:
    """Most likely zone and order of all-numeric dates of each site from its zone-less texts and their ingestion times (UTC).

    ``candidates`` is a short, fixed list. One pass: per site, zone and order, the rows that would be no date or lie
    after their ingestion (violations) and the mean lag are aggregated; no row leaves its partition before the partial
    sums. Sites without a usable row are absent. Columns: site_code, zone_name, date_order, n_rows, violations, lag_hours.
    """
    orders = ["DMY", "MDY"]
    read = [_local_micros(F.col(text), F.lit(o)).alias(f"l{k}") for k, o in enumerate(orders)]
    local = rows.select(F.col(site).alias("site_code"), *read, F.unix_micros(F.col(seen).cast("timestamp")).alias("seen")).where("site_code is not null and coalesce(l0, l1) is not null and seen is not null")
    aggs, tried = [F.count("*").alias("n_rows")], []
    for k, o in enumerate(orders):
        for i, z in enumerate(candidates):
            lag = F.col("seen") - F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(f"l{k}"), z))
            aggs += [F.count_if(F.coalesce(lag < 0, F.lit(True))).alias(f"v{k}_{i}"), F.avg(F.when(lag >= 0, lag)).alias(f"g{k}_{i}")]
            tried.append(F.struct(F.col(f"v{k}_{i}").alias("violations"), F.coalesce(f"g{k}_{i}", F.lit(float("inf"))).alias("lag"), F.lit(z).alias("zone"), F.lit(o).alias("order")))
    best = local.groupBy("site_code").agg(*aggs).select("site_code", "n_rows", F.array_min(F.array(*tried)).alias("b"))
    return best.select("site_code", F.col("b.zone").alias("zone_name"), F.col("b.order").alias("date_order"), "n_rows", F.col("b.violations").alias("violations"), F.round(F.col("b.lag") / 3.6e9, 3).alias("lag_hours"))


def complete_zones(site_zones: DataFrame, rows: DataFrame, text: str, seen: str = "loaded_at") -> DataFrame:
    """``site_zones`` with estimates for site codes of ``rows`` that have no zone.

    The known zones are the candidates, so only their distinct names come to the driver (the table has one
    row per site; more than 10,000 names are refused rather than gathered).
    """
    known = site_zones.where("site_code is not null and zone_name is not null").select("site_code", "zone_name", "date_order").dropDuplicates(["site_code"])
    codes = rows.where("site_code is not null").select("site_code").distinct()
    lacking = codes.join(known, "site_code", "left_anti")
    if lacking.isEmpty():
        return known
    names = sorted(r[0] for r in known.select("zone_name").distinct().limit(10_001).collect())
    if not names:
        return known
    if len(names) > 10_000:
        raise ValueError("more than 10,000 candidate zones")
    guess = estimate_zones(rows.join(lacking, "site_code", "left_semi"), names, text=text, seen=seen)
    return known.unionByName(guess.select("site_code", "zone_name", "date_order"))


def with_utc(df: DataFrame, site_zones: DataFrame, text: str, site: str = "site_code", out: str = "utc_micros") -> DataFrame:
    """``df`` with the UTC instant of its timestamp text, by the zone of each row's site.

    The zone table is joined by an equi-join without a hint: Spark broadcasts it only if its own size limit
    allows. Rows are never lost; the result is null where the text is no real instant.
    """
    z = site_zones.select(F.col("site_code").alias("_site"), F.col("zone_name").alias("_zone"), F.col("date_order").alias("_order")).dropDuplicates(["_site"])
    joined = spread(df).join(z, df[site] == z["_site"], "left")
    return joined.withColumn(out, _utc_micros(F.col(text), F.col("_zone"), F.col("_order"))).drop("_site", "_zone", "_order")

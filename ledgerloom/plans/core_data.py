"""Queries of the general training-data operators: p3 packed values, p7 instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.names import name_key
from ledgerloom.operators import instants
from ledgerloom.operators.packed_values import packed_values
from ledgerloom.plans.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "field_catalog").select("field_row_id", "t3_where_used")
    names = table(spark, d, "reports").select("report_name")
    out = packed_values(cells, "t3_where_used", names, "report_name")
    return out.select("field_row_id", F.col("value_pos").cast("int").alias("value_pos"), name_key(F.col("value")).alias("report_key"))


def p3_where_used_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many catalog rows and values name each report."""
    return p3_found(spark, d).groupBy("report_key").agg(F.count("*").alias("n_values"), F.countDistinct("field_row_id").alias("n_cells"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "runs").select(F.lit("runs").alias("table_name"), F.col("run_row_id").alias("row_id"), F.col("t2_start_date").alias("text"), "site_code", "loaded_at")
    comp = table(spark, d, "comprehensive").select(F.lit("comprehensive").alias("table_name"), F.col("comp_row_id").alias("row_id"), F.col("last_run_date").alias("text"), "site_code", "loaded_at")
    rows = runs.unionByName(comp)
    zones = instants.complete_zones(table(spark, d, "site_zones"), rows, text="text")
    out = instants.with_utc(rows.where("text is not null"), zones, "text")
    return out.where("utc_micros is not null").select("table_name", "row_id", "utc_micros")


def p7_zone_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Zone and date order of every site as the estimator finds it without looking at the site's own entry."""
    runs = table(spark, d, "runs").select("site_code", F.col("t2_start_date").alias("text"), "loaded_at")
    rows = runs.unionByName(table(spark, d, "comprehensive").select("site_code", F.col("last_run_date").alias("text"), "loaded_at"))
    zones = table(spark, d, "site_zones")
    names = sorted(r[0] for r in zones.select("zone_name").where("zone_name is not null").distinct().limit(10_001).collect())
    return instants.estimate_zones(rows, names)


QUERIES = {"p3_found": p3_found, "p3_where_used_counts": p3_where_used_counts, "p7_found": p7_found, "p7_zone_estimates": p7_zone_estimates}

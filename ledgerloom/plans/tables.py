"""Reading the project's tables and the views most queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_reports(reports: DataFrame, columns: list[str]) -> DataFrame:
    """The row with the highest run_id of each report_uid, narrowed to ``columns`` before the shuffle.

    Rows repeated within the highest run are equal in content; ties take the latest loaded_at, then the
    smallest remaining row, so the result is the same whatever the order. Rows without report_uid drop out.
    """
    rest = [c for c in columns if c != "report_uid"]
    order = F.struct(F.col("run_id"), F.col("loaded_at"), *[F.col(c) for c in rest])
    best = reports.where("report_uid is not null").groupBy("report_uid").agg(F.max(order).alias("r"))
    return best.select("report_uid", *[F.col(f"r.{c}").alias(c) for c in rest])

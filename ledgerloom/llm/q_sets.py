"""Queries of similar sets (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.names import field_set
from ledgerloom.llm.set_similarity import record_pairs, similar_sets
from ledgerloom.plans import sql
from ledgerloom.plans.tables import current_reports, table

THRESHOLD = (3, 4)


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    now = current_reports(table(spark, d, "reports"), ["report_uid", "report_fields"])
    return similar_sets(now.select("report_uid", field_set(F.col("report_fields")).alias("items")), "report_uid", "items", THRESHOLD)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = record_pairs(*_similar(spark, d))
    return out.select(F.col("a").alias("report_uid_a"), F.col("b").alias("report_uid_b"))


def p2_best(spark: SparkSession, d: str) -> DataFrame:
    """One row per report with a field set: its class, how many classes resemble it, and its best similarity."""
    members, pairs = _similar(spark, d)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls"), "similarity")
    near = ends.groupBy("cls").agg(F.count("*").alias("n_classes"), F.max("similarity").alias("best"))
    sizes = members.groupBy("cls").agg(F.count("*").alias("n_equal"))
    out = members.join(sizes, "cls").join(near, "cls", "left")
    best = F.when(F.col("n_equal") > 1, F.lit(1.0)).otherwise(F.col("best"))
    return out.select(F.col("uid").alias("report_uid"), F.col("cls").alias("class_uid"), "n_equal", F.coalesce("n_classes", F.lit(0)).alias("n_classes"), F.round(100 * best, 4).alias("field_jaccard_similarity"))


QUERIES = {"p2_found": p2_found, "p2_best": p2_best}

_PAIRS = f"""r AS (SELECT report_uid AS u, {sql.field_list('report_fields')} AS f FROM {sql.CURRENT}), i AS (SELECT u, len(f) AS n, unnest(f) AS k FROM r),
  p AS (SELECT x.u AS a, y.u AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS s FROM i x JOIN i y ON x.k = y.k AND x.u < y.u GROUP BY 1, 2 HAVING 4 * count(*) >= 3 * (any_value(x.n) + any_value(y.n) - count(*)))"""

_BEST = f"""WITH {_PAIRS}, c AS (SELECT u, f, min(u) OVER (PARTITION BY f) AS cls, count(*) OVER (PARTITION BY f) AS n_equal FROM r WHERE len(f) > 0),
  l AS (SELECT a AS cls, s FROM p WHERE a IN (SELECT cls FROM c) AND b IN (SELECT cls FROM c) AND s < 1 UNION ALL SELECT b, s FROM p WHERE a IN (SELECT cls FROM c) AND b IN (SELECT cls FROM c) AND s < 1),
  n AS (SELECT cls, count(*) AS n_classes, max(s) AS best FROM l GROUP BY cls)
  SELECT u AS report_uid, c.cls AS class_uid, n_equal, coalesce(n_classes, 0) AS n_classes, round(100 * CASE WHEN n_equal > 1 THEN 1.0 ELSE best END, 4) AS field_jaccard_similarity FROM c LEFT JOIN n ON c.cls = n.cls"""

ORACLES = {"p2_best": _BEST, "p2_found": f"WITH {_PAIRS} SELECT a AS report_uid_a, b AS report_uid_b FROM p"}

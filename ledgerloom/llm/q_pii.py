"""Queries of personal data (p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.name_statistics import name_statistics
from ledgerloom.llm.redaction import Redactor, find_pii, fit, redact, sample
from ledgerloom.plans.tables import table

_fitted: dict[tuple, Redactor] = {}


def model_for(spark: SparkSession, d: str) -> Redactor:
    """The models for a folder of tables: its reports' owners and creators are the name directory, their names the titles."""
    reports = table(spark, d, "reports")
    names = reports.select(F.explode(F.array("owner", "created_by")).alias("n"))
    statistics = name_statistics(names, "n", reports, "report_name")
    people, titles = sample(names, "n"), sample(reports, "report_name")
    key = (tuple(people), tuple(titles), tuple(sorted(statistics.totals.items())))
    if key not in _fitted:
        _fitted.clear()
        _fitted[key] = fit(statistics, people, titles)
    return _fitted[key]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_pii(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", model_for(spark, d))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", model_for(spark, d))


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted}

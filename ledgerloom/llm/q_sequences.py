"""Queries of runs of events (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.names import NULL_TOKENS, name_key, squeeze
from ledgerloom.llm.runs_of_events import collapse_runs, links
from ledgerloom.operators import instants
from ledgerloom.plans.tables import table
from ledgerloom.storage import Workspace

#: Two executions of one report belong together if at most 30 minutes apart.
MAX_GAP = 30 * 60 * 1_000_000


def executions(spark: SparkSession, d: str) -> DataFrame:
    """One row per execution with requester, report and start: id, who, k1, k2, at.

    The lowest run_row_id stands for an execution_ref (rows without one stand for themselves) before rows
    without requester, name or start are left out. The name key travels as 128 bits of hash.
    """
    runs = table(spark, d, "runs").select("run_row_id", "execution_ref", "t2_report_name", "t2_requested_id", "site_code", "t2_start_date", "loaded_at")
    zones = instants.complete_zones(table(spark, d, "site_zones"), runs.select("site_code", F.col("t2_start_date").alias("text"), "loaded_at"), text="text")
    ref = F.coalesce("execution_ref", F.concat(F.lit("row "), "run_row_id"))
    named = runs.select("run_row_id", ref.alias("ref"), "site_code", "t2_start_date", squeeze(F.col("t2_requested_id")).alias("who"), name_key(F.col("t2_report_name")).alias("k"))
    timed = instants.with_utc(named, zones, "t2_start_date", out="at")
    k = F.col("k")
    named_well = ~k.isin(NULL_TOKENS)
    who = F.when(~F.lower("who").isin(NULL_TOKENS), F.col("who"))
    slim = timed.select("ref", F.struct("run_row_id", who.alias("who"), F.when(named_well, F.xxhash64(k)).alias("k1"), F.when(named_well, F.xxhash64(F.lit(1), k)).alias("k2"), "at").alias("r"))
    return slim.groupBy("ref").agg(F.min("r").alias("r")).select("r.*")


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(executions(spark, d), ["who"], "at", "run_row_id", ["k1", "k2"], MAX_GAP)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.floor((F.col("last_micros") - F.col("first_micros")) / 1_000_000).cast("long")
    return p5_runs(spark, d).select(F.col("first_id").alias("first_row_id"), F.col("run_count").cast("int").alias("run_count"), seconds.alias("duration_seconds"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Every execution that goes on with the run of the one before, and that one."""
    ws = Workspace(spark, "run-links")
    named = executions(spark, d).where("who is not null and k1 is not null and at is not null")
    events = ws.write(named.select("who", "at", F.col("run_row_id").alias("id"), "k1", "k2"), "events")
    return links(ws, events, ["who"], ["k1", "k2"], MAX_GAP).select(F.col("id").alias("run_row_id"), F.col("ptr").alias("previous_row_id"))


QUERIES = {"p5_found": p5_found, "p5_links": p5_links}

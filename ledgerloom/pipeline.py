"""From three exports to result tables: ingest, map, clean, roll up, join, link, group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import Settings, flat
from ledgerloom.functions import instants as inst
from ledgerloom.functions.names import casefold, clean_text, denoised_name, name_key, squeeze, to_bool, to_number
from ledgerloom.functions.similarity import name_ratio, strong_name_match
from ledgerloom.operators import blocking, bursts, rollups
from ledgerloom.operators.components import components
from ledgerloom.operators.instants import utc_micros
from ledgerloom.operators.packed_values import packed_values
from ledgerloom.operators.similar_names import similar_names
from ledgerloom.session import ship
from ledgerloom.sinks import writers
from ledgerloom.sources.guards import checked
from ledgerloom.sources.headers import ALIASES, canonical
from ledgerloom.sources.sheets import read_sheet

PEOPLE = ["owner", "created_by", "t2_owner"]


@dataclass
class Results:
    """Result relations, lazy until a sink reads them."""

    reports: DataFrame
    links: DataFrame
    field_sets: DataFrame
    pairs: DataFrame
    groups: DataFrame
    coverage: DataFrame
    settings: DataFrame

    def tabs(self) -> dict[str, DataFrame]:
        return {"All Reports": self.reports, "Field Links": self.links, "Field Rollup": self.field_sets, "Similar Pairs": self.pairs, "Duplicate Groups": self.groups, "Data Quality": self.coverage, "Config": self.settings}


def analyse(spark: SparkSession, comprehensive: DataFrame, runs: DataFrame, fields: DataFrame | None, settings: Settings | None = None, zone: str = "UTC", date_order: str = "MDY") -> Results:
    """Canonical text tables (with ``row_id``) to results; zone and date order hold for all zone-less texts."""
    cfg = settings or Settings()
    ship(spark)
    at = lambda c: F.timestamp_micros(utc_micros(F.col(c), F.lit(zone), F.lit(date_order)))
    t1 = comprehensive.select(F.col("row_id").alias("report_uid"), squeeze(F.col("report_name")).alias("report_name"), name_key(F.col("report_name")).alias("name_key"), to_number(F.col("times_run")).alias("times_run"), at("last_run_date").alias("last_run_date"), to_bool(F.col("shared")).alias("shared"), clean_text(F.col("owner")).alias("owner"), clean_text(F.col("created_by")).alias("created_by"))
    t2 = runs.withColumn("name_key", name_key(F.col("t2_report_name"))).withColumn("start", at("t2_start_date"))
    who = F.coalesce(clean_text(F.col("t2_requested_by")), clean_text(F.col("t2_requested_id")))
    rolled = rollups.runs_rollup(t2, "name_key", "row_id", "start", who, clean_text(F.col("t2_exec_mode")), clean_text(F.col("t2_report_owner")))
    rhythm = bursts.recurrence(bursts.burst_starts(t2.select("name_key", F.unix_micros("start").alias("at")), "name_key", "at", cfg.burst_minutes * 60_000_000), "name_key", "at", cfg.cadences)
    reports = rollups.join_rollup(t1, rolled, "name_key", "last_run_date").join(rhythm, "name_key", "left")
    if fields is None:
        links = spark.createDataFrame([], "field_row_id long, report_key string, t3_field_name string")
        objects_of = spark.createDataFrame([], "name_key string, objects array<string>")
    else:
        named = packed_values(fields.select("row_id", "t3_field_name", "t3_where_used"), "t3_where_used", comprehensive, "report_name")
        links = named.select(F.col("row_id").alias("field_row_id"), name_key(F.col("value")).alias("report_key"), "t3_field_name").distinct()
        owned = fields.select(F.col("row_id").alias("field_row_id"), casefold(clean_text(F.col("t3_business_object"))).alias("object")).where("object is not null")
        objects_of = links.join(owned, "field_row_id").groupBy(F.col("report_key").alias("name_key")).agg(F.collect_set("object").alias("objects"))
    sets = links.groupBy(F.col("report_key").alias("name_key")).agg(F.array_sort(F.collect_set(F.col("field_row_id").cast("string"))).alias("field_ids"))
    with_sets = t1.join(sets, "name_key").select("report_uid", "field_ids")
    objects = t1.join(objects_of, "name_key").select("report_uid", "objects")
    by_fields = blocking.linked_sets(with_sets, "report_uid", "field_ids", cfg.jaccard_least, cfg.containment_least)
    plain = t1.select("report_uid", denoised_name(F.col("report_name"), True).alias("n"))
    na, nb = plain.withColumnsRenamed({"report_uid": "a", "n": "na"}), plain.withColumnsRenamed({"report_uid": "b", "n": "nb"})
    named = pairs_by_name(plain, with_sets, objects, cfg.name_least)
    either = by_fields.select("a", "b").unionByName(named).distinct()
    scored = either.join(na, "a").join(nb, "b").withColumn("name_ratio", name_ratio("na", "nb")).withColumn("name_match", strong_name_match(F.col("na"), F.col("nb"), F.col("name_ratio"), cfg.name_least))
    overlap = blocking.with_overlap(either, with_sets, "report_uid", "field_ids").where("shared > 0")
    pairs = scored.join(overlap, ["a", "b"], "left").select("a", "b", F.round("name_ratio", 4).alias("name_ratio"), "name_match", "shared", "jaccard", "containment")
    groups = components(pairs, "a", "b").select(F.col("node").alias("report_uid"), F.col("component").alias("group_uid"))
    covered = rollups.coverage(t1, ["report_name", "times_run", "last_run_date", "owner", "created_by"])
    return Results(reports, links, sets, pairs, groups, covered, spark.createDataFrame(flat(cfg), "setting string, value string"))


def pairs_by_name(plain: DataFrame, sets: DataFrame, objects: DataFrame, least: float) -> DataFrame:
    """Record pairs (a, b), a < b, of strongly matching names that begin alike or share a field or a business object.

    ``plain`` is (report_uid, n), ``sets`` is (report_uid, field_ids), ``objects`` is (report_uid, objects). Similar names are found among all names.
    """
    one = plain.where("n <> ''").join(sets, "report_uid", "left").join(objects, "report_uid", "left")
    alike = similar_names(plain, "n", least).unionByName(one.select(F.col("n").alias("na"), F.col("n").alias("nb")).distinct())
    x, y = one.withColumnsRenamed({"report_uid": "u", "n": "na", "field_ids": "fa", "objects": "oa"}), one.withColumnsRenamed({"report_uid": "v", "n": "nb", "field_ids": "fb", "objects": "ob"})
    met = alike.join(x, "na").join(y, "nb").where("na < nb or u < v")
    near = (F.substring("na", 1, 4) == F.substring("nb", 1, 4)) | F.coalesce(F.arrays_overlap("fa", "fb"), F.lit(False)) | F.coalesce(F.arrays_overlap("oa", "ob"), F.lit(False))
    return met.where(near).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def run_pipeline(spark: SparkSession, table1: str, table2: str | None, table3: str | None, out: str, settings: Settings | None = None, run_id: int = 1, zone: str = "UTC", date_order: str = "MDY") -> Results:
    """Read the exports, analyse them and write every result below ``out``."""
    cfg = settings or Settings()
    if zone and inst._zone(zone) is None:
        raise ValueError(f"unknown zone {zone}")
    ship(spark)
    read = lambda path, kind: canonical(checked(read_sheet(spark, path)), kind)
    # without an execution log every report counts as never run
    runs = read(table2, "runs") if table2 else spark.createDataFrame([], "row_id long, " + ", ".join(f"{c} string" for c in ALIASES["runs"]))
    res = analyse(spark, read(table1, "comprehensive"), runs, read(table3, "fields") if table3 else None, cfg, zone, date_order)
    for name, df in res.tabs().items():
        df = writers.masked(df, PEOPLE) if cfg.sensitive else df
        writers.write_run(df, f"{out}/{name.lower().replace(' ', '_')}", run_id, cfg.keep_history)
    return res

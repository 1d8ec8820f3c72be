"""Queries of splits (p1), match groups (p4) and duplicate-group keepers (p6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.names import TRUTHY, field_set, squeeze
from ledgerloom.llm.match_groups import match_groups
from ledgerloom.llm.related_splits import QUARANTINE, SplitStore, split_pairs
from ledgerloom.llm.survivors import keepers, survivors
from ledgerloom.plans import sql
from ledgerloom.plans.tables import current_reports, table
from ledgerloom.storage import Workspace

#: Pairs reviewed before this day are the first load of the split store, the others its next batch.
FIRST_LOAD_ENDS = "2026-01-01"


def whole_number(c: Column) -> Column:
    """The whole number a spreadsheet text stands for: blanks, grouping commas, a leading apostrophe and '.0' are ignored."""
    n = F.regexp_replace(c, "[\\s\\u00a0',]", "").try_cast("decimal(38,6)")
    return F.when(n == F.floor(n), n).cast("long")


def _splits(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "labeled_pairs").select("pair_id", whole_number(F.col("report_uid_a")).alias("a"), whole_number(F.col("report_uid_b")).alias("b"), "reviewed_at")
    ws = Workspace(spark, "splits")
    pairs = ws.write(raw.where("a is not null and b is not null"), "input")
    store = SplitStore.open(spark, f"{ws.root}/store")
    early = F.col("reviewed_at") < F.lit(FIRST_LOAD_ENDS).cast("timestamp")
    store.ingest(pairs.where(early), "a", "b")
    store.commit()
    # a later session goes on from what is kept
    store = SplitStore.open(spark, f"{ws.root}/store")
    store.ingest(pairs.where(~F.coalesce(early, F.lit(False))), "a", "b")
    return split_pairs(pairs, "pair_id", "a", "b", store.records)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d).select("pair_id", "group_uid")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d)


def _latest_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose latest score says duplicate; of equal times the highest match_id counts."""
    m = table(spark, d, "report_matches").select("match_id", "report_uid_a", "report_uid_b", "potential_duplicate", "scored_at").where("report_uid_a is not null and report_uid_b is not null and report_uid_a <> report_uid_b")
    latest = m.groupBy(F.least("report_uid_a", "report_uid_b").alias("a"), F.greatest("report_uid_a", "report_uid_b").alias("b")).agg(F.max(F.struct("scored_at", "match_id", "potential_duplicate")).alias("m"))
    return latest.where("m.potential_duplicate = 1").select("a", "b")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return match_groups(_latest_matches(spark, d), "a", "b").select(F.col("id").alias("report_uid"), F.col("group_id").alias("dup_group_id"), "member_count")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_groups(spark, d).select("report_uid", F.col("dup_group_id").alias("group_uid"))


_KEEPER_COLUMNS = ["report_uid", "dup_group_id", "overall_score", "total_risk_score", "effective_last_run_date", "last_run_date", "recurrence_classification", "distinct_requesters", "field_extraction_status", "report_fields", "areas_used", "shared", "last_updated"]


def _ranked_reports(spark: SparkSession, d: str, extra: list[str]) -> DataFrame:
    """Current reports in a duplicate group with the keys of the keeper order, each smaller for better."""
    now = current_reports(table(spark, d, "reports"), [*_KEEPER_COLUMNS, *extra])
    g = F.upper(squeeze(F.col("dup_group_id")))
    rank = {"Strong": 0, "Moderate": 1, "No Recurring Pattern": 2}
    recurrence = F.coalesce(*[F.when(F.col("recurrence_classification") == k, F.lit(v)) for k, v in rank.items()], F.lit(3))
    areas = F.filter(F.transform(F.split(F.coalesce("areas_used", F.lit("")), "[,;|\n\r]+"), lambda x: F.lower(squeeze(x))), lambda x: x != "")
    late = lambda c: -F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(-(2**62)))
    return now.where(g.isNotNull() & (g != "")).select(
        "report_uid", *extra, *[c for c in ("report_fields", "areas_used", "shared", "last_updated", "last_run_date", "effective_last_run_date", "recurrence_classification", "overall_score") if c not in extra],
        g.alias("gid"),
        F.coalesce(F.coalesce("overall_score", "total_risk_score").cast("double"), F.lit(float("inf"))).alias("o1"),
        late(F.coalesce("effective_last_run_date", "last_run_date")).alias("o2"),
        recurrence.alias("o3"),
        (-F.coalesce("distinct_requesters", F.lit(0))).alias("o4"),
        F.when(F.col("field_extraction_status") == "Matched", -F.size(field_set(F.col("report_fields")))).otherwise(F.lit(0)).alias("o5"),
        (-F.size(F.array_distinct(areas))).alias("o6"),
        F.when(F.lower(squeeze(F.col("shared"))).isin(TRUTHY), F.lit(0)).otherwise(F.lit(1)).alias("o7"),
        late(F.col("last_updated")).alias("o8"),
    )


_ORDER = [f"o{i}" for i in range(1, 9)]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    out = keepers(_ranked_reports(spark, d, []), "gid", "report_uid", [F.col(c) for c in _ORDER])
    return out.select(F.col("gid").alias("dup_group_id"), F.col("report_uid").alias("keeper_uid"))


def p6_survivors(spark: SparkSession, d: str) -> DataFrame:
    extra = ["report_name", "owner", "description", "category", "data_source"]
    ranked = _ranked_reports(spark, d, extra)
    fields = [*extra, "report_fields", "areas_used", "shared", "last_updated", "effective_last_run_date", "recurrence_classification"]
    out = survivors(ranked, "gid", "report_uid", F.struct(*_ORDER, "report_uid"), fields)
    return out.withColumnRenamed("gid", "dup_group_id")


def p1_split_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the splits: pairs and groups covered, and reports that stand in two splits (none)."""
    pairs = _splits(spark, d)
    ends = table(spark, d, "labeled_pairs").select("pair_id", F.explode(F.array(whole_number(F.col("report_uid_a")), whole_number(F.col("report_uid_b")))).alias("uid"))
    placed = ends.join(pairs, "pair_id").where(F.col("split") != QUARANTINE).select("uid", "split").distinct()
    parted = placed.groupBy("uid").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("v")).select(F.lit("parted_reports").alias("figure"), "v")
    counts = pairs.agg(F.count("*").alias("n_pairs"), F.countDistinct("group_uid").alias("n_groups"), F.count_if(F.col("split").isNull()).alias("unplaced"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).alias("v")) for c in counts.columns])).alias("r")).select("r.*").unionByName(parted)


QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_split_checks": p1_split_checks, "p4_found": p4_found, "p4_groups": p4_groups, "p6_found": p6_found, "p6_survivors": p6_survivors}

_UID = "CAST(CASE WHEN x{0} = floor(x{0}) THEN x{0} END AS BIGINT)"
_PAIRS = (
    "(SELECT pair_id, " + _UID.format("a") + " AS a, " + _UID.format("b") + " AS b FROM (SELECT pair_id, "
    "try_cast(regexp_replace(report_uid_a, '[\\s\\x{a0}'',]', '', 'g') AS DECIMAL(38,6)) AS xa, try_cast(regexp_replace(report_uid_b, '[\\s\\x{a0}'',]', '', 'g') AS DECIMAL(38,6)) AS xb FROM labeled_pairs))"
)
_MATCHED = """(SELECT a, b FROM (SELECT least(report_uid_a, report_uid_b) AS a, greatest(report_uid_a, report_uid_b) AS b, potential_duplicate, row_number() OVER (PARTITION BY least(report_uid_a, report_uid_b), greatest(report_uid_a, report_uid_b) ORDER BY scored_at DESC, match_id DESC) AS rn
  FROM report_matches WHERE report_uid_a IS NOT NULL AND report_uid_b IS NOT NULL AND report_uid_a <> report_uid_b) WHERE rn = 1 AND potential_duplicate = 1)"""
_REACH = "r AS (SELECT DISTINCT u AS node, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.node WHERE r.c < e.v), g AS (SELECT node, min(c) AS c FROM r GROUP BY node)"
_AREAS = r"len(list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(areas_used, ''), '[,;|\n\r]+'), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))), lambda y: y <> '')))"

_KEYS = f"""coalesce(overall_score, total_risk_score) NULLS LAST, coalesce(effective_last_run_date, last_run_date) DESC NULLS LAST,
      CASE recurrence_classification WHEN 'Strong' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'No Recurring Pattern' THEN 2 ELSE 3 END, coalesce(distinct_requesters, 0) DESC, CASE WHEN field_extraction_status = 'Matched' THEN len({sql.field_list('report_fields')}) ELSE 0 END DESC, {_AREAS} DESC,
      CASE WHEN lower(trim(shared)) IN ('yes','y','true','1','t') THEN 0 ELSE 1 END, last_updated DESC NULLS LAST, report_uid"""
_GROUPED = f"(SELECT *, count(*) OVER (PARTITION BY gid) AS n, row_number() OVER (PARTITION BY gid ORDER BY {_KEYS}) AS k FROM (SELECT *, upper(trim(dup_group_id)) AS gid FROM {sql.CURRENT}) WHERE gid <> '')"
_TEXTS = ["report_name", "owner", "description", "category", "data_source", "report_fields", "areas_used", "shared", "recurrence_classification"]
_SURVIVOR = ", ".join([f"arg_min({c}, k) FILTER (WHERE {c} IS NOT NULL AND lower({sql.squeeze(c)}) NOT IN ({sql.TOKENS})) AS {c}" for c in _TEXTS] + [f"arg_min({c}, k) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("last_updated", "effective_last_run_date")])

ORACLES = {
    "p1_found": f"WITH RECURSIVE p AS {_PAIRS}, e AS (SELECT a AS u, b AS v FROM p WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM p WHERE a IS NOT NULL AND b IS NOT NULL), {_REACH} SELECT pair_id, g.c AS group_uid FROM p JOIN g ON p.a = g.node WHERE p.b IS NOT NULL",
    "p4_found": f"WITH RECURSIVE p AS {_MATCHED}, e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p), {_REACH} SELECT node AS report_uid, c AS group_uid FROM g",
    "p4_groups": f"WITH RECURSIVE p AS {_MATCHED}, e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p), {_REACH} SELECT node AS report_uid, c AS dup_group_id, count(*) OVER (PARTITION BY c) AS member_count FROM g",
    "p1_split_checks": f"""WITH RECURSIVE p AS {_PAIRS}, e AS (SELECT a AS u, b AS v FROM p WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM p WHERE a IS NOT NULL AND b IS NOT NULL), {_REACH}, t AS (SELECT g.c FROM p JOIN g ON p.a = g.node WHERE p.b IS NOT NULL)
      SELECT 'n_pairs' AS figure, count(*) AS v FROM t UNION ALL SELECT 'n_groups', count(DISTINCT c) FROM t UNION ALL SELECT 'unplaced', 0 UNION ALL SELECT 'parted_reports', 0""",
    "p6_found": f"SELECT gid AS dup_group_id, report_uid AS keeper_uid FROM {_GROUPED} WHERE n > 1 AND k = 1",
    "p6_survivors": f"SELECT gid AS dup_group_id, count(*) AS member_count, arg_min(report_uid, k) AS keeper_uid, {_SURVIVOR} FROM {_GROUPED} WHERE n > 1 GROUP BY gid",
}

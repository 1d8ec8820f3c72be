"""Queries of pair similarity, field profiles and result ordering, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.names import clean_text, denoised_name, field_set, name_key, squeeze
from ledgerloom.functions.similarity import strong_name_match
from ledgerloom.operators import ordering, pair_similarity, rollups
from ledgerloom.plans import sql
from ledgerloom.plans.portfolio import _LATEST_SQL, _LINKS_SQL, _UID_SQL, latest_pairs
from ledgerloom.plans.tables import current_reports, table

QUERIES = {}
ORACLES: dict[str, str] = {}

_CATALOG = {"objects": "t3_business_object", "prompts": "t3_built_in_prompts", "related": "t3_related_business_object", "usage": "t3_authorized_usage", "domains": "t3_domain", "categories": "t3_categories"}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def catalog_links(s: SparkSession, d: str) -> DataFrame:
    return rollups.field_links(table(s, d, "field_catalog"), "field_row_id", "t3_where_used")


_SETS_SQL = ", ".join(f"list_sort(list(DISTINCT lower({sql.clean_text(c)})) FILTER (WHERE {sql.clean_text(c)} IS NOT NULL)) AS {k}" for k, c in _CATALOG.items())
_NAMES_SQL = f"list_sort(list(DISTINCT {sql.clean_text('t3_field_name')}) FILTER (WHERE {sql.clean_text('t3_field_name')} IS NOT NULL)) AS names"
_PROFILES_SQL = f"(SELECT report_key, count(DISTINCT field_row_id) AS field_count, {_NAMES_SQL}, {_SETS_SQL} FROM {_LINKS_SQL} GROUP BY report_key)"


@query(f"SELECT report_key, field_count, 'where_used' AS match_type, {', '.join(f'''coalesce(array_to_string({k}, '; '), '') AS {k}''' for k in ('names', *_CATALOG))} FROM {_PROFILES_SQL}")
def field_profiles(s: SparkSession, d: str) -> DataFrame:
    """Fields of each report key with all seven of their value sets."""
    p = rollups.field_profiles(catalog_links(s, d), "field_row_id", "t3_field_name", _CATALOG)
    return p.select("report_key", "field_count", "match_type", *[F.array_join(k, "; ").alias(k) for k in ("names", *_CATALOG)])


_CELL_SQL = "trim(coalesce(t3_where_used, ''), ' ')"


@query(f"""WITH l AS (SELECT field_row_id, count(*) AS n FROM {_LINKS_SQL} GROUP BY 1), f AS (SELECT c.field_row_id, coalesce(n, 0) AS n, {_CELL_SQL} AS cell FROM (SELECT field_row_id, max(t3_where_used) AS t3_where_used FROM field_catalog GROUP BY 1) c LEFT JOIN l USING (field_row_id)),
  k AS (SELECT DISTINCT report_key FROM {_LINKS_SQL} WHERE report_key NOT IN (SELECT {sql.name_key('report_name')} FROM reports))
  SELECT 'total_field_rows' AS figure, count(*) AS n FROM f UNION ALL SELECT 'total_report_field_links', CAST(sum(n) AS BIGINT) FROM f UNION ALL SELECT 'total_unmatched_rows', count(*) FROM f WHERE n = 0 UNION ALL SELECT 'total_where_used_rows_parsed', count(*) FROM f WHERE cell <> ''
  UNION ALL SELECT 'total_where_used_parse_failures', count(*) FROM f WHERE cell <> '' AND n = 0 UNION ALL SELECT 'blank_where_used_rows', count(*) FROM f WHERE cell = '' UNION ALL SELECT 'multi_report_field_rows', count(*) FROM f WHERE n > 1 UNION ALL SELECT 'unmatched_where_used_reports', count(*) FROM k""")
def field_diagnostics(s: SparkSession, d: str) -> DataFrame:
    """Counts that tell how well the field catalog joins the reports."""
    known = table(s, d, "reports").select(name_key(F.col("report_name")).alias("report_key"))
    return rollups.field_diagnostics(catalog_links(s, d), "field_row_id", "t3_where_used", known)


@query(f"SELECT field_row_id, 'no_report_key' AS reason FROM field_catalog WHERE field_row_id NOT IN (SELECT field_row_id FROM {_LINKS_SQL})")
def unmatched_fields(s: SparkSession, d: str) -> DataFrame:
    """Fields that name no report."""
    return catalog_links(s, d).where("report_key is null").select("field_row_id", F.lit("no_report_key").alias("reason"))


@query(f"SELECT report_uid, coalesce(field_count, 0) AS field_count, CASE WHEN field_count IS NULL THEN 'No fields found' ELSE 'Matched' END AS status FROM {sql.CURRENT} r LEFT JOIN {_PROFILES_SQL} p ON p.report_key = {sql.name_key('report_name')}")
def reports_with_fields(s: SparkSession, d: str) -> DataFrame:
    """Current reports with the fields of their name key."""
    p = rollups.field_profiles(catalog_links(s, d), "field_row_id", "t3_field_name", {})
    now = current_reports(table(s, d, "reports"), ["report_uid", "report_name"]).select("report_uid", name_key(F.col("report_name")).alias("k"))
    return rollups.attach_fields(now, p, "k").select("report_uid", "field_count", F.col("field_extraction_status").alias("status"))


_TEXTS = pair_similarity.TEXTS
_PROFILED_SQL = f"(SELECT r.report_uid AS uid, {sql.field_list('report_fields')} AS fields, p.objects, p.prompts, p.related, p.usage, {sql.denoised('report_name', True)} AS name, {', '.join(_TEXTS)} FROM {sql.CURRENT} r LEFT JOIN {_PROFILES_SQL} p ON p.report_key = {sql.name_key('report_name')})"


def profiles(s: SparkSession, d: str) -> DataFrame:
    """What the signals need of every current report."""
    now = current_reports(table(s, d, "reports"), ["report_uid", "report_name", "report_fields", *_TEXTS])
    sets = {k: c for k, c in _CATALOG.items() if k in pair_similarity.SETS.values()}
    p = rollups.field_profiles(catalog_links(s, d), "field_row_id", "t3_field_name", sets).select("report_key", *sets)
    keyed = now.withColumn("report_key", name_key(F.col("report_name"))).join(p, "report_key", "left")
    return keyed.select(F.col("report_uid").alias("uid"), field_set(F.col("report_fields")).alias("fields"), *sets, denoised_name(F.col("report_name"), True).alias("name"), *_TEXTS)


def labelled(s: SparkSession, d: str) -> DataFrame:
    """Labelled pairs of two different known reports with their profiles and the reviewers' name ratio."""
    uid = lambda c: F.regexp_replace(c, "[\\s\\u00a0',]", "").try_cast("decimal(38,6)").cast("long")
    ends = table(s, d, "labeled_pairs").select("pair_id", uid("report_uid_a").alias("a"), uid("report_uid_b").alias("b"), F.col("sig_name").alias("ratio")).where("a <> b")
    return pair_similarity.with_profiles(ends, profiles(s, d))


def _jaccard_sql(c: str) -> str:
    return f"CASE WHEN len(x.{c}) > 0 AND len(y.{c}) > 0 THEN 100.0 * len(list_intersect(x.{c}, y.{c})) / len(list_distinct(list_concat(x.{c}, y.{c}))) END"


def _same_sql(c: str) -> str:
    return f"CASE WHEN trim(x.{c}) <> '' AND trim(y.{c}) <> '' THEN CASE WHEN lower(trim(x.{c})) = lower(trim(y.{c})) THEN 100.0 ELSE 0.0 END END"


_BY_SIGNAL = {
    "field_jaccard": _jaccard_sql("fields"), "smaller_containment": "CASE WHEN len(x.fields) > 0 AND len(y.fields) > 0 THEN 100.0 * len(list_intersect(x.fields, y.fields)) / least(len(x.fields), len(y.fields)) END",
    "business_object": _jaccard_sql("objects"), "name": "CASE WHEN x.name <> '' AND y.name <> '' THEN p.ratio END", "built_in_prompts": _jaccard_sql("prompts"), "related_business_object": _jaccard_sql("related"),
    "data_source": _same_sql("data_source"), "authorized_usage": _jaccard_sql("usage"), "report_type": _same_sql("report_type"),
}
_DIGITS_SQL = "list_sort(list_distinct(regexp_extract_all({}.name, '\\d+')))"
_GATE_SQL = {c: f"CASE WHEN trim(x.{c}) <> '' AND lower(trim(x.{c})) = lower(trim(y.{c})) THEN 1 ELSE 0 END" for c in _TEXTS}
_POINTS_SQL = "round_even(coalesce(p.ratio, 0.0) * 50 / 100" + "".join(f" + {pts}.0 * {_GATE_SQL[c]}" for c, pts in pair_similarity.CANDIDATE_POINTS.items() if c != "name") + ", 1)"
_SIGNALS_SQL = f"""WITH profiled AS MATERIALIZED {_PROFILED_SQL}, s AS (SELECT p.pair_id, p.a, p.b, {', '.join(f'{e} AS {k}' for k, e in _BY_SIGNAL.items())}, coalesce(x.name <> '' AND y.name <> '' AND {_DIGITS_SQL.format('x')} = {_DIGITS_SQL.format('y')} AND p.ratio >= 90, false) AS name_match, {_POINTS_SQL} AS points,
  coalesce(len(list_intersect(x.fields, y.fields)) > 0, false) OR coalesce(len(list_intersect(x.objects, y.objects)) > 0, false) OR coalesce(p.ratio, 0) >= 75 OR (coalesce(p.ratio, 0) >= 60 AND {_GATE_SQL['category']} = 1 AND {_GATE_SQL['report_tag']} = 1) OR {_POINTS_SQL} >= 70 AS passed
  FROM (SELECT pair_id, {_UID_SQL.format('report_uid_a')} AS a, {_UID_SQL.format('report_uid_b')} AS b, sig_name AS ratio FROM labeled_pairs) p JOIN profiled x ON p.a = x.uid JOIN profiled y ON p.b = y.uid WHERE p.a <> p.b)"""
_WEIGHTED_SQL = "(" + " + ".join(f"coalesce({k} * {w}, 0)" for k, w in pair_similarity.WEIGHTS.items()) + ") / nullif(" + " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {w} END" for k, w in pair_similarity.WEIGHTS.items()) + ", 0)"
_CEILING_SQL = "(coalesce(field_jaccard, 100) * 0.4 + coalesce(smaller_containment, 100) * 0.2 + coalesce(name, 100) * 0.1 + 30.0)"
_JUDGED_SQL = f"""{_SIGNALS_SQL}, o AS (SELECT *, CASE WHEN field_jaccard IS NOT NULL AND NOT name_match AND {_CEILING_SQL} < 70 THEN 0.0 ELSE coalesce(round_even({_WEIGHTED_SQL}, 1), 0.0) END AS known FROM s),
  l AS (SELECT *, CASE WHEN known >= 90 THEN 'Nearly Identical' WHEN smaller_containment >= 95 AND known >= 80 THEN 'Smaller Report Contained in Larger Report' WHEN known >= 80 THEN 'High Field Overlap' WHEN known >= 70 THEN 'Possible Duplicate' ELSE 'Not Flagged' END AS label FROM o),
  j AS (SELECT pair_id, a, b, CASE WHEN label = 'Not Flagged' AND name_match THEN greatest(known, round_even(name, 1)) ELSE known END AS overall, CASE WHEN label = 'Not Flagged' AND name_match THEN 'Likely Duplicate (Name Match)' ELSE label END AS relationship, label <> 'Not Flagged' OR name_match AS potential FROM l)"""


def judged_pairs(s: SparkSession, d: str) -> DataFrame:
    p = labelled(s, d)
    signals = pair_similarity.raw_signals(F.col("ratio"))
    p = p.select("pair_id", "a", "b", F.coalesce(strong_name_match(F.col("x_name"), F.col("y_name"), F.col("ratio")), F.lit(False)).alias("name_match"), *[c.alias(k) for k, c in signals.items()])
    named = {k: F.col(k) for k in signals}
    return p.select("pair_id", "a", "b", *[c.alias(k) for k, c in pair_similarity.judged(named, F.col("name_match")).items()])


@query(f"{_SIGNALS_SQL} SELECT pair_id, {', '.join(f'round({k}, 6) AS {k}' for k in _BY_SIGNAL)} FROM s")
def pair_signals(s: SparkSession, d: str) -> DataFrame:
    """All nine raw signals of every labelled pair; null where a side knows nothing."""
    return labelled(s, d).select("pair_id", *[F.round(c, 6).alias(k) for k, c in pair_similarity.raw_signals(F.col("ratio")).items()])


@query(f"{_SIGNALS_SQL} SELECT pair_id, {', '.join(f'round(coalesce(least(greatest({k} / 100, 0.0), 1.0), 0.0), 8) AS v_{k}, CAST(CASE WHEN {k} IS NULL THEN 1 ELSE 0 END AS DOUBLE) AS m_{k}' for k in _BY_SIGNAL)} FROM s")
def pair_vectors(s: SparkSession, d: str) -> DataFrame:
    """The eighteen model features of every labelled pair."""
    p = labelled(s, d).select("pair_id", pair_similarity.feature_vector(pair_similarity.raw_signals(F.col("ratio"))).alias("v"))
    return p.select("pair_id", *[c for i, k in enumerate(_BY_SIGNAL) for c in (F.round(F.get("v", F.lit(2 * i)), 8).alias(f"v_{k}"), F.get("v", F.lit(2 * i + 1)).alias(f"m_{k}"))])


@query(f"{_JUDGED_SQL} SELECT pair_id, overall, relationship, potential FROM j")
def pair_similarities(s: SparkSession, d: str) -> DataFrame:
    """Overall similarity and relationship of every labelled pair over nine signals."""
    return judged_pairs(s, d).select("pair_id", "overall", "relationship", "potential")


@query(f"{_SIGNALS_SQL} SELECT pair_id, points, passed FROM s")
def pair_gate(s: SparkSession, d: str) -> DataFrame:
    """Metadata points of every labelled pair and whether it is worth comparing."""
    r = F.col("ratio")
    return labelled(s, d).select("pair_id", pair_similarity.candidate_score(r).alias("points"), pair_similarity.gate(r).alias("passed"))


@query(f"""{_JUDGED_SQL}, e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, overall, relationship FROM j WHERE potential), u AS (SELECT a AS uid, b AS partner, overall, relationship FROM e UNION ALL SELECT b, a, overall, relationship FROM e)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY overall DESC, partner, relationship) AS place FROM u) WHERE place <= 50""")
def pair_matches(s: SparkSession, d: str) -> DataFrame:
    """Up to fifty qualified partners per report, from either side of a pair."""
    once = judged_pairs(s, d).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "overall", "relationship", "potential").distinct()
    # one row per pair: judged alike, but the name ratio of repeated labels may differ
    w = Window.partitionBy("uid").orderBy(F.desc("overall"), "partner", "relationship")
    directed = ordering.both_directions(once.where("potential"), "a", "b", ["overall", "relationship"])
    return directed.withColumn("place", F.row_number().over(w)).where("place <= 50")


@query(f"""SELECT uid, p AS probability, a AS first, b AS second FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY p DESC, a, b) AS rn FROM (SELECT unnest([a, b]) AS uid, a, b, duplicate_similarity / 100 AS p FROM {_LATEST_SQL} WHERE duplicate_similarity IS NOT NULL)) WHERE rn = 1""")
def best_probabilities(s: SparkSession, d: str) -> DataFrame:
    """Most likely pair of every report over all candidates, qualified or not."""
    p = latest_pairs(s, d).select("a", "b", (F.col("s") / 100).alias("p"))
    return pair_similarity.best_probability(p, "a", "b", "p")


_GID_SQL = "upper(trim(dup_group_id))"


@query(f"""WITH r AS (SELECT report_uid, nullif({_GID_SQL}, '') AS g, {sql.name_key('report_name')} AS k FROM {sql.CURRENT}), n AS (SELECT g, row_number() OVER (ORDER BY min(k), g) AS i FROM r WHERE g IS NOT NULL GROUP BY g)
  SELECT row_number() OVER (ORDER BY CASE WHEN n.i IS NULL THEN 1 ELSE 0 END, coalesce(n.i, 0), k, report_uid) AS place, report_uid, coalesce(printf('DG-%03d', n.i), '') AS group_label, CASE WHEN n.i IS NULL THEN 'Not a Duplicate' ELSE 'Duplicate' END AS status FROM r LEFT JOIN n ON r.g = n.g""")
def summary_order(s: SparkSession, d: str) -> DataFrame:
    """Reports as the summary lists them: groups by their first name, members by name, then all others."""
    r = current_reports(table(s, d, "reports"), ["report_uid", "report_name", "dup_group_id"]).select("report_uid", F.upper(squeeze(F.col("dup_group_id"))).alias("g"), name_key(F.col("report_name")).alias("k")).withColumn("g", F.when(F.col("g") != "", F.col("g")))
    n = ordering.global_rank(r.where("g is not null").groupBy("g").agg(F.min("k").alias("first")), ["first", "g"], "i").select("g", "i")
    j = r.join(n, "g", "left").withColumns({"o1": F.col("i").isNull().cast("int"), "o2": F.coalesce("i", F.lit(0))})
    out = ordering.global_rank(j, ["o1", "o2", "k", "report_uid"], "place")
    return out.select(F.col("place").cast("long").alias("place"), "report_uid", F.coalesce(F.format_string("DG-%03d", "i"), F.lit("")).alias("group_label"), F.when(F.col("i").isNull(), "Not a Duplicate").otherwise("Duplicate").alias("status")).withColumn("group_label", F.when(F.col("status") == "Duplicate", F.col("group_label")).otherwise(F.lit("")))


@query(f"""WITH r AS (SELECT report_uid, nullif({_GID_SQL}, '') AS g, is_suggested_keeper FROM {sql.CURRENT}) SELECT row_number() OVER (ORDER BY g, CASE WHEN is_suggested_keeper = 1 THEN 0 ELSE 1 END, report_uid) AS place, g AS dup_group_id, report_uid FROM r WHERE g IS NOT NULL""")
def keeper_first(s: SparkSession, d: str) -> DataFrame:
    """Members of duplicate groups, the keeper of a group before the others."""
    r = current_reports(table(s, d, "reports"), ["report_uid", "dup_group_id", "is_suggested_keeper"]).select("report_uid", F.upper(squeeze(F.col("dup_group_id"))).alias("dup_group_id"), F.when(F.col("is_suggested_keeper") == 1, 0).otherwise(1).alias("o")).where("dup_group_id <> ''")
    return ordering.global_rank(r, ["dup_group_id", "o", "report_uid"], "place").select(F.col("place").cast("long").alias("place"), "dup_group_id", "report_uid")


@query(f"SELECT owner, printf('Owner %d', dense_rank() OVER (ORDER BY owner)) AS pseudonym FROM (SELECT DISTINCT {sql.clean_text('owner')} AS owner FROM reports) WHERE owner IS NOT NULL")
def owner_pseudonyms(s: SparkSession, d: str) -> DataFrame:
    """Stable pseudonyms of all owners, by the rank of their names."""
    o = table(s, d, "reports").select(clean_text(F.col("owner")).alias("owner")).where("owner is not null").distinct()
    return ordering.global_rank(o, ["owner"], "i").select("owner", F.format_string("Owner %d", "i").alias("pseudonym"))


def _flag_sql(c: str, name: str) -> str:
    return f"CASE WHEN {sql.clean_text(c)} IS NULL THEN '{name}' END"


_FLAGS = {"owner": "Missing Owner", "created_by": "Missing Creator", "description": "Missing Description", "category": "Missing Category", "report_tag": "Missing Tag", "data_source": "Missing Data Source", "areas_used": "Missing Areas", "landing_page": "Missing Landing Page"}


@query(f"SELECT report_uid, array_to_string(list_filter([{', '.join(_flag_sql(c, n) for c, n in _FLAGS.items())}], lambda x: x IS NOT NULL), '; ') AS flags FROM {sql.CURRENT}")
def quality_flags(s: SparkSession, d: str) -> DataFrame:
    """Names of the descriptive values that a current report lacks."""
    from ledgerloom.functions import rules

    now = current_reports(table(s, d, "reports"), ["report_uid", *_FLAGS])
    missing: dict[str, Column] = {n: clean_text(F.col(c)).isNull() for c, n in _FLAGS.items()}
    return now.select("report_uid", F.array_join(rules.flags(missing), "; ").alias("flags"))


@query(f"""WITH c AS (SELECT {sql.name_key('custom_report')} AS k FROM comprehensive), r AS (SELECT DISTINCT {sql.name_key('t2_report_name')} AS k FROM runs), f AS (SELECT DISTINCT report_key AS k FROM {_LINKS_SQL})
  SELECT 'with_runs' AS figure, count(*) FILTER (WHERE k <> '' AND k IN (SELECT k FROM r)) AS n, round_even(100.0 * count(*) FILTER (WHERE k <> '' AND k IN (SELECT k FROM r)) / greatest(count(*), 1), 1) AS pct FROM c
  UNION ALL SELECT 'with_fields', count(*) FILTER (WHERE k <> '' AND k IN (SELECT k FROM f)), round_even(100.0 * count(*) FILTER (WHERE k <> '' AND k IN (SELECT k FROM f)) / greatest(count(*), 1), 1) FROM c""")
def join_rates(s: SparkSession, d: str) -> DataFrame:
    """How many report rows find executions and fields."""
    c = table(s, d, "comprehensive").select(name_key(F.col("custom_report")).alias("k"))
    r = table(s, d, "runs").select(name_key(F.col("t2_report_name")).alias("k")).where("k <> ''").distinct().withColumn("r", F.lit(1))
    f = rollups.where_used_lines(table(s, d, "field_catalog").select("t3_where_used"), "t3_where_used").select(F.col("report_key").alias("k")).distinct().withColumn("f", F.lit(1))
    one = c.join(r, "k", "left").join(f, "k", "left").agg(F.count("*").alias("n"), F.count("r").alias("with_runs"), F.count("f").alias("with_fields"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), F.col(k).alias("n"), F.bround(100 * F.col(k) / F.greatest("n", F.lit(1)), 1).alias("pct")) for k in ("with_runs", "with_fields")])).alias("x")
    return one.select(rows).select("x.*")

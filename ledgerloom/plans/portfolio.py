"""Queries of the report portfolio, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import evidence, rules
from ledgerloom.functions.names import clean_text, denoised_name, field_set, name_key, squeeze, to_bool, to_number
from ledgerloom.functions.similarity import name_ratio, strong_name_match
from ledgerloom.operators import blocking, bursts, instants, metrics, ordering, rollups
from ledgerloom.operators.components import components
from ledgerloom.plans import sql
from ledgerloom.plans.tables import current_reports, table
from ledgerloom.sources.labels import checked_pairs, repeated_pairs

#: The day that ages are counted to.
AS_OF = "2026-06-06 00:00:00"
QUERIES = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(rf"""SELECT comp_row_id, {sql.clean_text('custom_report')} AS report_name,
  try_cast(regexp_replace(number_of_times_executed, '[,$]|{sql.SPACE}', '', 'g') AS DOUBLE) AS times_run,
  CASE WHEN lower({sql.squeeze('shared')}) IN ('yes','y','true','1','t') THEN 1 WHEN lower({sql.squeeze('shared')}) IN ('no','n','false','0','f') THEN 0 END AS shared,
  {sql.clean_text('owner')} AS owner, {sql.clean_text('created_by')} AS created_by FROM comprehensive""")
def clean_comprehensive(s: SparkSession, d: str) -> DataFrame:
    """Typed, cleaned report metadata."""
    t = table(s, d, "comprehensive")
    return t.select("comp_row_id", clean_text(F.col("custom_report")).alias("report_name"), to_number(F.col("number_of_times_executed")).alias("times_run"), to_bool(F.col("shared")).cast("int").alias("shared"), clean_text(F.col("owner")).alias("owner"), clean_text(F.col("created_by")).alias("created_by"))


@query(f"SELECT DISTINCT report_uid, {sql.name_key('report_name')} AS name_key, {sql.denoised('report_name', True)} AS denoised, {sql.denoised('report_name', False)} AS denoised_no_digits FROM reports")
def report_names(s: SparkSession, d: str) -> DataFrame:
    """Exact and de-noised keys of every report name."""
    n = F.col("report_name")
    return table(s, d, "reports").select("report_uid", name_key(n).alias("name_key"), denoised_name(n, True).alias("denoised"), denoised_name(n).alias("denoised_no_digits")).distinct()


_ROLLUP_SQL = f"""SELECT k AS name_key, count(*) AS run_count, max(t2_last_run_date) AS last_run, count(*) FILTER (WHERE t2_last_run_date IS NULL) AS missing_times,
  coalesce(string_agg(DISTINCT m, ', ' ORDER BY m), '') AS modes, arg_min(o, run_row_id) FILTER (WHERE o IS NOT NULL) AS owner, count(DISTINCT q) AS distinct_requesters
  FROM (SELECT *, {sql.name_key('t2_report_name')} AS k, {sql.clean_text('t2_exec_mode')} AS m, {sql.clean_text('t2_report_owner')} AS o, coalesce({sql.clean_text('t2_requested_by')}, {sql.clean_text('t2_requested_id')}) AS q FROM runs) WHERE k <> '' GROUP BY k"""


@query(_ROLLUP_SQL)
def runs_rollup(s: SparkSession, d: str) -> DataFrame:
    """Runs per report name: counts, latest run, requesters, modes, first owner."""
    runs = table(s, d, "runs").withColumn("name_key", name_key(F.col("t2_report_name")))
    who = F.coalesce(clean_text(F.col("t2_requested_by")), clean_text(F.col("t2_requested_id")))
    return rollups.runs_rollup(runs, "name_key", "run_row_id", "t2_last_run_date", who, clean_text(F.col("t2_exec_mode")), clean_text(F.col("t2_report_owner")))


@query(f"""WITH r AS ({_ROLLUP_SQL}), c AS (SELECT report_uid, last_run_date, {sql.name_key('report_name')} AS name_key FROM {sql.CURRENT})
  SELECT c.report_uid, coalesce(r.run_count, 0) AS run_count, coalesce(r.distinct_requesters, 0) AS distinct_requesters, greatest(c.last_run_date, r.last_run) AS effective_last_run,
  CAST(r.last_run IS NOT NULL AND (c.last_run_date IS NULL OR r.last_run > c.last_run_date) AS INTEGER) AS runs_newer FROM c LEFT JOIN r ON c.name_key = r.name_key""")
def reports_with_runs(s: SparkSession, d: str) -> DataFrame:
    """Current reports with their run figures and the later of both last runs."""
    now = current_reports(table(s, d, "reports"), ["report_uid", "report_name", "last_run_date"]).withColumn("name_key", name_key(F.col("report_name")))
    out = rollups.join_rollup(now, runs_rollup(s, d), "name_key", "last_run_date")
    return out.select("report_uid", "run_count", "distinct_requesters", "effective_last_run", F.col("runs_newer").cast("int").alias("runs_newer"))


@query(f"""SELECT DISTINCT k AS name_key FROM (SELECT {sql.name_key('t2_report_name')} AS k FROM runs) WHERE k <> '' AND k NOT IN (SELECT {sql.name_key('report_name')} FROM reports)""")
def unmatched_run_names(s: SparkSession, d: str) -> DataFrame:
    """Names that ran but that no report holds (left anti join)."""
    ran = table(s, d, "runs").select(name_key(F.col("t2_report_name")).alias("name_key")).where("name_key <> ''").distinct()
    return ran.join(table(s, d, "reports").select(name_key(F.col("report_name")).alias("name_key")).distinct(), "name_key", "left_anti")


@query(f"SELECT k AS name_key FROM (SELECT {sql.name_key('t2_report_name')} AS k FROM runs INTERSECT SELECT {sql.name_key('custom_report')} FROM comprehensive) WHERE k <> ''")
def names_in_both(s: SparkSession, d: str) -> DataFrame:
    """Names both in the run log and in the metadata export (intersect)."""
    a = table(s, d, "runs").select(name_key(F.col("t2_report_name")).alias("name_key"))
    return a.intersect(table(s, d, "comprehensive").select(name_key(F.col("custom_report")).alias("name_key"))).where("name_key <> ''")


_LINKS_SQL = rf"""(SELECT *, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(t3_where_used, '\r\n|\r|\n'), lambda x: {sql.name_key('x')}), lambda y: y <> ''))) AS report_key FROM field_catalog WHERE t3_where_used IS NOT NULL)"""


@query(f"""SELECT l.field_row_id, l.report_key, r.report_uid FROM {_LINKS_SQL} l LEFT JOIN (SELECT max(report_uid) AS report_uid, {sql.name_key('report_name')} AS k FROM reports GROUP BY 2) r ON l.report_key = r.k""")
def field_links(s: SparkSession, d: str) -> DataFrame:
    """Field-to-report links of line-separated cells, with the report's uid where its name is known."""
    links = rollups.where_used_lines(table(s, d, "field_catalog").select("field_row_id", "t3_where_used"), "t3_where_used")
    known = table(s, d, "reports").groupBy(name_key(F.col("report_name")).alias("report_key")).agg(F.max("report_uid").alias("report_uid"))
    return links.join(known, "report_key", "left").select("field_row_id", "report_key", "report_uid")


@query(f"""SELECT report_key, count(DISTINCT field_row_id) AS field_count, string_agg(DISTINCT CAST(field_row_id AS VARCHAR), '|' ORDER BY CAST(field_row_id AS VARCHAR)) AS signature,
  coalesce(string_agg(DISTINCT n, '; ' ORDER BY n), '') AS field_names, coalesce(string_agg(DISTINCT b, '; ' ORDER BY b), '') AS business_objects, coalesce(string_agg(DISTINCT p, '; ' ORDER BY p), '') AS prompts
  FROM (SELECT *, {sql.clean_text('t3_field_name')} AS n, lower({sql.clean_text('t3_business_object')}) AS b, lower({sql.clean_text('t3_built_in_prompts')}) AS p FROM {_LINKS_SQL}) GROUP BY report_key""")
def field_rollup(s: SparkSession, d: str) -> DataFrame:
    """Fields, objects and prompts per report key."""
    links = rollups.where_used_lines(table(s, d, "field_catalog").select("field_row_id", "t3_field_name", "t3_business_object", "t3_built_in_prompts", "t3_where_used"), "t3_where_used")
    return rollups.field_rollup(links, "field_row_id", "t3_field_name", {"business_objects": "t3_business_object", "prompts": "t3_built_in_prompts"})


@query(f"SELECT report_uid, len({sql.field_list('report_fields')}) AS n_fields, array_to_string({sql.field_list('report_fields')}, '; ') AS fields FROM {sql.CURRENT}")
def report_field_sets(s: SparkSession, d: str) -> DataFrame:
    """Normalised field set of each current report."""
    now = current_reports(table(s, d, "reports"), ["report_uid", "report_fields"]).select("report_uid", field_set(F.col("report_fields")).alias("f"))
    return now.select("report_uid", F.size("f").alias("n_fields"), F.array_join("f", "; ").alias("fields"))


_COVERED = ["report_name", "owner", "description", "areas_used", "report_fields", "last_run_date", "overall_score"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE {c} IS NOT NULL{chr(32) + 'AND trim(' + c + chr(41) + ' <> ' + chr(39) * 2 if c not in ('last_run_date', 'overall_score') else ''}) AS filled, round_even(100.0 * count(*) FILTER (WHERE {c} IS NOT NULL{chr(32) + 'AND trim(' + c + chr(41) + ' <> ' + chr(39) * 2 if c not in ('last_run_date', 'overall_score') else ''}) / greatest(count(*), 1), 1) AS pct FROM reports" for c in _COVERED))
def report_coverage(s: SparkSession, d: str) -> DataFrame:
    """Share of filled values per column."""
    return rollups.coverage(table(s, d, "reports"), _COVERED)


@query(f"SELECT k AS key, count(*) AS n FROM (SELECT {sql.name_key('custom_report')} AS k FROM comprehensive) WHERE k <> '' GROUP BY k HAVING count(*) > 1")
def repeated_names(s: SparkSession, d: str) -> DataFrame:
    """Report names that several metadata rows share."""
    return rollups.repeated_keys(table(s, d, "comprehensive"), name_key(F.col("custom_report")))


_LATEST_SQL = "(SELECT * FROM (SELECT least(report_uid_a, report_uid_b) AS a, greatest(report_uid_a, report_uid_b) AS b, duplicate_similarity, potential_duplicate, row_number() OVER (PARTITION BY least(report_uid_a, report_uid_b), greatest(report_uid_a, report_uid_b) ORDER BY scored_at DESC, match_id DESC) AS rn FROM report_matches WHERE report_uid_a IS NOT NULL AND report_uid_b IS NOT NULL AND report_uid_a <> report_uid_b) WHERE rn = 1)"
_ENDS_SQL = f"(SELECT a AS uid, b AS partner, duplicate_similarity AS s FROM {_LATEST_SQL} UNION ALL SELECT b, a, duplicate_similarity FROM {_LATEST_SQL})"


def latest_pairs(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "report_matches").where("report_uid_a is not null and report_uid_b is not null and report_uid_a <> report_uid_b")
    last = F.max(F.struct("scored_at", "match_id", "duplicate_similarity", "potential_duplicate")).alias("m")
    return m.groupBy(F.least("report_uid_a", "report_uid_b").alias("a"), F.greatest("report_uid_a", "report_uid_b").alias("b")).agg(last).select("a", "b", F.col("m.duplicate_similarity").alias("s"), F.col("m.potential_duplicate").alias("dup"))


@query(f"SELECT uid, partner, s AS score, n AS n_partners FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY s DESC NULLS LAST, partner) AS rn, count(*) OVER (PARTITION BY uid) AS n FROM {_ENDS_SQL}) WHERE rn = 1")
def best_match(s: SparkSession, d: str) -> DataFrame:
    """Best match of each report, ties to the lowest partner."""
    return ordering.best_partner(ordering.both_directions(latest_pairs(s, d), "a", "b", ["s"]), F.col("s"))


@query(f"SELECT uid, partner, s, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY s DESC NULLS LAST, partner) AS rn FROM {_ENDS_SQL}) WHERE rn <= 50")
def top_matches(s: SparkSession, d: str) -> DataFrame:
    """Up to fifty best matches per report."""
    return ordering.top_partners(ordering.both_directions(latest_pairs(s, d), "a", "b", ["s"]), "s", 50).select("uid", "partner", "s", "place")


@query(f"""WITH RECURSIVE e AS (SELECT a AS u, b AS v FROM {_LATEST_SQL} WHERE potential_duplicate = 1 UNION SELECT b, a FROM {_LATEST_SQL} WHERE potential_duplicate = 1),
  r AS (SELECT u AS node, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.node WHERE r.c < e.v) SELECT node, min(c) AS component FROM r GROUP BY node""")
def match_components(s: SparkSession, d: str) -> DataFrame:
    """Connected components of confirmed matches."""
    return components(latest_pairs(s, d).where("dup = 1"), "a", "b")


@query(f"""WITH g AS (SELECT dup_group_id, min(report_uid) AS lead, count(*) AS members FROM {sql.CURRENT} WHERE dup_group_id IS NOT NULL GROUP BY 1)
  SELECT dup_group_id, members, printf('DUP-%04d', row_number() OVER (ORDER BY lead)) AS number FROM g""")
def group_numbers(s: SparkSession, d: str) -> DataFrame:
    """Groups numbered by their smallest member."""
    g = current_reports(table(s, d, "reports"), ["report_uid", "dup_group_id"]).where("dup_group_id is not null").groupBy("dup_group_id").agg(F.min("report_uid").alias("lead"), F.count("*").alias("members"))
    return ordering.global_rank(g, ["lead"]).select("dup_group_id", "members", F.format_string("DUP-%04d", "rank").alias("number"))


_LABEL_SQL = "CASE WHEN lower(trim(coalesce(label, ''))) IN ('1','1.0','yes','y','true','t','duplicate','dup') THEN 1 WHEN lower(trim(coalesce(label, ''))) IN ('0','0.0','no','n','false','f','not_duplicate','not duplicate') THEN 0 END"


def parsed_label() -> F.Column:
    x = F.lower(squeeze(F.coalesce("label", F.lit(""))))
    return F.when(x.isin("1", "1.0", "yes", "y", "true", "t", "duplicate", "dup"), 1).when(x.isin("0", "0.0", "no", "n", "false", "f", "not_duplicate", "not duplicate"), 0)


def scored_labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "labeled_pairs").select("pair_id", parsed_label().alias("y"), "sig_field_jaccard", "sig_name")


@query(f"SELECT y AS label, count(*) AS n FROM (SELECT {_LABEL_SQL} AS y FROM labeled_pairs) GROUP BY y")
def label_counts(s: SparkSession, d: str) -> DataFrame:
    """Pairs per parsed label; unresolved labels are null."""
    return scored_labels(s, d).groupBy(F.col("y").alias("label")).agg(F.count("*").alias("n"))


_SCORED_SQL = f"(SELECT sig_field_jaccard AS s, {_LABEL_SQL} AS y FROM labeled_pairs WHERE sig_field_jaccard IS NOT NULL AND {_LABEL_SQL} IS NOT NULL)"


@query(f"""WITH c AS (SELECT count(*) FILTER (WHERE s >= 75 AND y = 1) AS tp, count(*) FILTER (WHERE s >= 75 AND y = 0) AS fp, count(*) FILTER (WHERE s < 75 AND y = 1) AS fn, count(*) FILTER (WHERE s < 75 AND y = 0) AS tn FROM {_SCORED_SQL})
  SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM c""")
def label_confusion(s: SparkSession, d: str) -> DataFrame:
    """Confusion of the field similarity at 75 percent."""
    return metrics.confusion(scored_labels(s, d), "sig_field_jaccard", "y", 75.0)


@query(f"""WITH g AS (SELECT s, count(*) AS n, sum(y) AS p FROM {_SCORED_SQL} GROUP BY s), c AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER (ORDER BY s DESC) AS cp FROM g)
  SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(p) AS BIGINT) AS n_pos, round(sum((n - p) * (cp - p) + 0.5 * (n - p) * p) / (sum(p) * sum(n - p)), 6) AS roc_auc, round(sum(p * cp / cn) / sum(p), 6) AS average_precision FROM c""")
def label_ranking(s: SparkSession, d: str) -> DataFrame:
    """ROC area and average precision of the field similarity."""
    return metrics.ranking_metrics(scored_labels(s, d), "sig_field_jaccard", "y")


@query(f"""WITH g AS (SELECT s, count(*) AS n, sum(y) AS p FROM {_SCORED_SQL} GROUP BY s), c AS (SELECT s, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER (ORDER BY s DESC) AS cp, (SELECT sum(p) FROM g) AS ap FROM g)
  SELECT s AS threshold, round(2 * cp / (cn + ap), 6) AS f1, round(cp / cn, 6) AS precision FROM c WHERE cp / cn >= 0.6 ORDER BY 2 * cp / (cn + ap) DESC, s DESC LIMIT 1""")
def label_threshold(s: SparkSession, d: str) -> DataFrame:
    """Best F1 threshold at a precision of at least 0.6."""
    return metrics.best_threshold(scored_labels(s, d), "sig_field_jaccard", "y", 0.6)


def _policy_sql(floor: float) -> str:
    return f"""WITH x AS (SELECT s / 100 AS s, y FROM {_SCORED_SQL}), t AS (SELECT DISTINCT s FROM x UNION SELECT CAST(0.5 AS DOUBLE)), g AS (SELECT s, count(*) AS n, sum(y) AS p FROM x GROUP BY s),
      c AS (SELECT t.s, coalesce(sum(n), 0) AS cn, coalesce(sum(p), 0) AS cp, (SELECT sum(p) FROM g) AS ap FROM t LEFT JOIN g ON g.s >= t.s GROUP BY t.s),
      m AS (SELECT s, 2 * cp / (cn + ap) AS f1, CASE WHEN cn > 0 THEN cp / cn ELSE 0 END AS pr FROM c)
      SELECT CAST({floor} AS DOUBLE) AS floor, arg_max(s, (CASE WHEN pr >= {floor} THEN 1 ELSE 0 END, f1, s)) AS threshold, CASE WHEN max(pr) >= {floor} THEN 'floor' ELSE 'no floor' END AS criterion FROM m"""


@query(" UNION ALL ".join(f"SELECT * FROM ({_policy_sql(f)})" for f in (0.6, 0.9, 1.0)))
def threshold_policy(s: SparkSession, d: str) -> DataFrame:
    """Chosen threshold of the field similarity for three floors of precision, and whether the floor was reached."""
    x = scored_labels(s, d).select((F.col("sig_field_jaccard") / 100).alias("s"), "y")
    parts = [metrics.choose_threshold(x, "s", "y", f).select(F.lit(f).alias("floor"), "threshold", "criterion") for f in (0.6, 0.9, 1.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT pair_id, coalesce(least(greatest(sig_field_jaccard / 100, 0.0), 1.0), 0.0) AS f_jaccard, CASE WHEN sig_field_jaccard IS NULL THEN 1.0 ELSE 0.0 END AS f_jaccard_missing,
  coalesce(least(greatest(sig_name / 100, 0.0), 1.0), 0.0) AS f_name, CASE WHEN sig_name IS NULL THEN 1.0 ELSE 0.0 END AS f_name_missing FROM labeled_pairs""")
def feature_vectors(s: SparkSession, d: str) -> DataFrame:
    """Each signal as a value in 0..1 and a missing mark: missing is not zero."""
    cols = []
    for c, n in (("sig_field_jaccard", "f_jaccard"), ("sig_name", "f_name")):
        unit = F.least(F.greatest(F.col(c) / 100, F.lit(0.0)), F.lit(1.0))
        cols += [F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(unit).alias(n), F.when(F.col(c).isNull(), F.lit(1.0)).otherwise(F.lit(0.0)).alias(n + "_missing")]
    return table(s, d, "labeled_pairs").select("pair_id", *cols)


@query(f"""WITH r AS (SELECT report_uid, upper(trim(dup_group_id)) AS g, {sql.field_list('report_fields')} AS f FROM {sql.CURRENT}),
  k AS (SELECT g, min(report_uid) AS keeper FROM r WHERE g IS NOT NULL AND g <> '' GROUP BY g HAVING count(*) > 1)
  SELECT m.report_uid, k.keeper, len(list_intersect(m.f, x.f)) AS shared, CASE WHEN len(m.f) > 0 AND len(x.f) > 0 THEN round_even(100.0 * len(list_intersect(m.f, x.f)) / (len(m.f) + len(x.f) - len(list_intersect(m.f, x.f))), 1) END AS jaccard,
  CASE WHEN len(m.f) > 0 AND len(x.f) > 0 THEN round_even(100.0 * len(list_intersect(m.f, x.f)) / least(len(m.f), len(x.f)), 1) END AS containment,
  array_to_string(list_filter(m.f, lambda v: NOT list_contains(x.f, v)), '; ') AS only_here, array_to_string(list_filter(x.f, lambda v: NOT list_contains(m.f, v)), '; ') AS only_keeper
  FROM r m JOIN k ON m.g = k.g JOIN r x ON x.report_uid = k.keeper WHERE m.report_uid <> k.keeper""")
def member_vs_lead(s: SparkSession, d: str) -> DataFrame:
    """Each group member's fields against those of the group's first report."""
    now = current_reports(table(s, d, "reports"), ["report_uid", "dup_group_id", "report_fields"]).select("report_uid", F.upper(squeeze(F.col("dup_group_id"))).alias("g"), field_set(F.col("report_fields")).alias("f"))
    lead = now.where("g is not null and g <> ''").groupBy("g").agg(F.min("report_uid").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("g", "keeper")
    k = now.select(F.col("report_uid").alias("keeper"), F.col("f").alias("kf"))
    j = now.join(lead, "g").where("report_uid <> keeper").join(k, "keeper").withColumn("shared", F.size(F.array_intersect("f", "kf")))
    both = (F.size("f") > 0) & (F.size("kf") > 0)
    jac = F.when(both, F.bround(100 * F.col("shared") / (F.size("f") + F.size("kf") - F.col("shared")), 1))
    con = F.when(both, F.bround(100 * F.col("shared") / F.least(F.size("f"), F.size("kf")), 1))
    return j.select("report_uid", "keeper", "shared", jac.alias("jaccard"), con.alias("containment"), F.array_join(F.array_except("f", "kf"), "; ").alias("only_here"), F.array_join(F.array_except("kf", "f"), "; ").alias("only_keeper"))


@query(f"""WITH r AS (SELECT report_uid, {sql.field_list('report_fields')} AS f FROM {sql.CURRENT}), i AS (SELECT report_uid AS u, unnest(f) AS k FROM r), b AS (SELECT * FROM i WHERE k IN (SELECT k FROM i GROUP BY k HAVING count(*) > 1)),
  p AS (SELECT DISTINCT x.u AS a, y.u AS b FROM b x JOIN b y ON x.k = y.k AND x.u < y.u), o AS (SELECT a, b, len(list_intersect(ra.f, rb.f)) AS n, len(ra.f) AS na, len(rb.f) AS nb FROM p JOIN r ra ON a = ra.report_uid JOIN r rb ON b = rb.report_uid),
  e AS (SELECT a, b, round_even(100.0 * n / (na + nb - n), 1) AS j, round_even(100.0 * n / least(na, nb), 1) AS c FROM o), d AS (SELECT a AS u, j, c FROM e WHERE j >= 50 OR c >= 80 UNION ALL SELECT b, j, c FROM e WHERE j >= 50 OR c >= 80)
  SELECT u AS report_uid, count(*) AS n_links, max(j) AS best_jaccard, max(c) AS best_containment FROM d GROUP BY u""")
def field_overlap_links(s: SparkSession, d: str) -> DataFrame:
    """Reports linked by overlapping fields, however frequent: links and best overlap per report."""
    sets = current_reports(table(s, d, "reports"), ["report_uid", "report_fields"]).select("report_uid", field_set(F.col("report_fields")).alias("f"))
    scored = blocking.linked_sets(sets, "report_uid", "f", 50, 80)
    ends = ordering.both_directions(scored, "a", "b", ["jaccard", "containment"])
    return ends.groupBy(F.col("uid").alias("report_uid")).agg(F.count("*").alias("n_links"), F.max("jaccard").alias("best_jaccard"), F.max("containment").alias("best_containment"))


@query()
def name_similarity(s: SparkSession, d: str) -> DataFrame:
    """Token-sorted name ratio of every match's reports and whether it is strong (distinct name pairs only)."""
    names = current_reports(table(s, d, "reports"), ["report_uid", "report_name"]).select("report_uid", denoised_name(F.col("report_name"), True).alias("n"))
    p = latest_pairs(s, d).select("a", "b").join(names.withColumnsRenamed({"report_uid": "a", "n": "na"}), "a").join(names.withColumnsRenamed({"report_uid": "b", "n": "nb"}), "b")
    ratios = p.select("na", "nb").distinct().withColumn("r", name_ratio("na", "nb"))
    j = p.join(ratios, ["na", "nb"])
    return j.select("a", "b", F.round("r", 4).alias("ratio"), strong_name_match(F.col("na"), F.col("nb"), F.col("r")).alias("strong"))


_AGE_SQL = f"date_diff('day', CAST(last_updated AS DATE), CAST(TIMESTAMP '{AS_OF}' AS DATE))"


@query(f"""SELECT report_uid, {_AGE_SQL} AS age_days, CASE WHEN last_updated IS NULL THEN 5 WHEN {_AGE_SQL} > 1095 THEN 10 WHEN {_AGE_SQL} > 730 THEN 7 ELSE 0 END AS age_points,
  CASE WHEN overall_score >= 80 THEN 'high' WHEN overall_score >= 40 THEN 'middle' ELSE 'low' END AS level,
  array_to_string(list_filter([CASE WHEN {sql.clean_text('owner')} IS NULL THEN 'Missing Owner' END, CASE WHEN {sql.clean_text('created_by')} IS NULL THEN 'Missing Creator' END, CASE WHEN {sql.clean_text('description')} IS NULL THEN 'Missing Description' END], lambda x: x IS NOT NULL), '; ') AS flags,
  coalesce(regexp_matches(report_name, '(?i)\\bdnu\\b'), false)::INTEGER AS marked FROM {sql.CURRENT}""")
def report_flags(s: SparkSession, d: str) -> DataFrame:
    """Ages, tiers, labels, flags and name marks of current reports (parameterised rule expressions)."""
    now = current_reports(table(s, d, "reports"), ["report_uid", "report_name", "last_updated", "overall_score", "owner", "created_by", "description"])
    age = rules.days_between(F.lit(AS_OF).cast("timestamp"), F.col("last_updated"))
    fl = rules.flags({"Missing Owner": clean_text(F.col("owner")).isNull(), "Missing Creator": clean_text(F.col("created_by")).isNull(), "Missing Description": clean_text(F.col("description")).isNull()})
    return now.select("report_uid", age.alias("age_days"), rules.tier(age, [(1095, 10), (730, 7)], 5).alias("age_points"), rules.label_at_least(F.col("overall_score"), {80: "high", 40: "middle", 0: "low"}).alias("level"), F.array_join(fl, "; ").alias("flags"), F.coalesce(F.col("report_name").rlike(r"(?i)\bdnu\b"), F.lit(False)).cast("int").alias("marked"))


@query(f"""SELECT report_uid, category, label, points FROM (SELECT report_uid, 'age' AS category, 'not updated for years' AS label, 10 AS points FROM {sql.CURRENT} WHERE {_AGE_SQL} > 1095
  UNION ALL SELECT report_uid, 'context', 'no areas', 6 FROM {sql.CURRENT} WHERE {sql.clean_text('areas_used')} IS NULL UNION ALL SELECT report_uid, 'score', 'carried over', NULL FROM {sql.CURRENT} WHERE overall_score IS NOT NULL)""")
def reasons(s: SparkSession, d: str) -> DataFrame:
    """Reason trails, one row per reason."""
    now = current_reports(table(s, d, "reports"), ["report_uid", "last_updated", "areas_used", "overall_score"])
    old = rules.days_between(F.lit(AS_OF).cast("timestamp"), F.col("last_updated")) > 1095
    t = rules.trail([("age", F.when(old, F.lit("not updated for years")), F.lit(10)), ("context", F.when(clean_text(F.col("areas_used")).isNull(), F.lit("no areas")), F.lit(6)), ("score", F.when(F.col("overall_score").isNotNull(), F.lit("carried over")), F.lit(None))])
    return now.select("report_uid", F.explode(t).alias("x")).select("report_uid", "x.category", "x.label", "x.points")


@query(f"""SELECT report_uid, CASE WHEN trim(owner) <> '' THEN '***' ELSE owner END AS owner, CASE WHEN regexp_matches(report_name, '^[=+\\-@]') THEN '''' || report_name ELSE report_name END AS report_name, CASE WHEN trim(created_by) <> '' THEN '***' ELSE created_by END AS created_by FROM {sql.CURRENT}""")
def masked_reports(s: SparkSession, d: str) -> DataFrame:
    """Reports with people masked and texts safe for spreadsheets."""
    now = current_reports(table(s, d, "reports"), ["report_uid", "owner", "report_name", "created_by"])
    return now.select("report_uid", rules.mask(F.col("owner")).alias("owner"), rules.spreadsheet_safe(F.col("report_name")).alias("report_name"), rules.mask(F.col("created_by")).alias("created_by"))


@query(f"""SELECT count(*) AS reports, count(*) FILTER (WHERE overall_score >= 60) AS high, count(*) FILTER (WHERE dup_group_id IS NOT NULL) AS grouped, count(*) FILTER (WHERE is_suggested_keeper = 1) AS keepers, count(DISTINCT category) AS categories FROM {sql.CURRENT}""")
def portfolio_summary(s: SparkSession, d: str) -> DataFrame:
    """Key figures in one aggregation."""
    now = current_reports(table(s, d, "reports"), ["report_uid", "overall_score", "dup_group_id", "is_suggested_keeper", "category"])
    return now.agg(F.count("*").alias("reports"), F.count_if(F.col("overall_score") >= 60).alias("high"), F.count("dup_group_id").alias("grouped"), F.count_if(F.col("is_suggested_keeper") == 1).alias("keepers"), F.countDistinct("category").alias("categories"))


@query(f"SELECT report_uid, report_name, category FROM {sql.CURRENT} WHERE category IN ('Compliance', 'Staffing') AND contains(lower(report_name), 'audit')")
def filtered_reports(s: SparkSession, d: str) -> DataFrame:
    """Value filters and a literal, case-insensitive search."""
    now = current_reports(table(s, d, "reports"), ["report_uid", "report_name", "category"])
    return now.where(F.col("category").isin("Compliance", "Staffing") & F.lower("report_name").contains("audit"))


@query("""WITH RECURSIVE t AS (SELECT user_id AS u, epoch_us(ts) AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM (SELECT DISTINCT user_id, ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)),
  f AS (SELECT u, i, m, m AS last, true AS kept FROM t WHERE i = 1 UNION ALL SELECT t.u, t.i, t.m, CASE WHEN t.m - f.last > 1800000000 THEN t.m ELSE f.last END, t.m - f.last > 1800000000 FROM f JOIN t ON t.u = f.u AND t.i = f.i + 1)
  SELECT u AS user_id, count(*) AS occurrences, min(m) AS first_micros, max(m) AS last_micros FROM f WHERE kept GROUP BY u""")
def burst_collapse(s: SparkSession, d: str) -> DataFrame:
    """Events per user with bursts of thirty minutes collapsed."""
    e = table(s, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return bursts.burst_starts(e, "user_id", "at", 1_800_000_000).groupBy("user_id").agg(F.count("*").alias("occurrences"), F.min("at").alias("first_micros"), F.max("at").alias("last_micros"))


@query()
def run_recurrence(s: SparkSession, d: str) -> DataFrame:
    """Cadence of every report's executions."""
    runs = table(s, d, "runs").select(name_key(F.col("t2_report_name")).alias("name_key"), "t2_start_date", "site_code", "loaded_at").where("name_key <> ''")
    zones = instants.complete_zones(table(s, d, "site_zones"), runs.select("site_code", F.col("t2_start_date").alias("text"), "loaded_at"), text="text")
    timed = instants.with_utc(runs, zones, "t2_start_date", out="at").select("name_key", "at")
    return bursts.recurrence(bursts.burst_starts(timed, "name_key", "at", 1_800_000_000), "name_key", "at")


_JAC = "CASE WHEN len(a.f) > 0 AND len(b.f) > 0 THEN 100.0 * len(list_intersect(a.f, b.f)) / (len(a.f) + len(b.f) - len(list_intersect(a.f, b.f))) END"
_CON = "CASE WHEN len(a.f) > 0 AND len(b.f) > 0 THEN 100.0 * len(list_intersect(a.f, b.f)) / least(len(a.f), len(b.f)) END"
_SAME = "CASE WHEN trim(a.{0}) <> '' AND trim(b.{0}) <> '' THEN CASE WHEN lower(trim(a.{0})) = lower(trim(b.{0})) THEN 100.0 ELSE 0.0 END END"
WEIGHTS = {"fields": 0.5, "contained": 0.25, "source": 0.15, "type": 0.1}


@query(f"""WITH r AS (SELECT report_uid, data_source, report_type, {sql.field_list('report_fields')} AS f FROM {sql.CURRENT}),
  s AS (SELECT p.a, p.b, {_JAC} AS j, {_CON} AS c, {_SAME.format('data_source')} AS d, {_SAME.format('report_type')} AS t FROM {_LATEST_SQL} p JOIN r a ON p.a = a.report_uid JOIN r b ON p.b = b.report_uid),
  w AS (SELECT *, (coalesce(j * 0.5, 0) + coalesce(c * 0.25, 0) + coalesce(d * 0.15, 0) + coalesce(t * 0.1, 0)) / nullif((CASE WHEN j IS NULL THEN 0 ELSE 0.5 END + CASE WHEN c IS NULL THEN 0 ELSE 0.25 END + CASE WHEN d IS NULL THEN 0 ELSE 0.15 END + CASE WHEN t IS NULL THEN 0 ELSE 0.1 END), 0) AS o FROM s)
  SELECT a, b, round(o, 4) AS overall, CASE WHEN o >= 90 THEN 'near' WHEN c >= 95 AND o >= 80 THEN 'contained' WHEN o >= 70 THEN 'similar' ELSE 'apart' END AS relation FROM w""")
def weighted_similarity(s: SparkSession, d: str) -> DataFrame:
    """Weighted similarity of matched reports; unavailable signals drop out and the other weights grow."""
    now = current_reports(table(s, d, "reports"), ["report_uid", "report_fields", "data_source", "report_type"]).select("report_uid", field_set(F.col("report_fields")).alias("f"), "data_source", "report_type")
    left = now.select(*[F.col(c).alias({"report_uid": "a"}.get(c, "x_" + c)) for c in now.columns])
    right = now.select(*[F.col(c).alias({"report_uid": "b"}.get(c, "y_" + c)) for c in now.columns])
    p = latest_pairs(s, d).select("a", "b").join(left, "a").join(right, "b")
    x, y = (lambda c: F.col("x_" + c)), (lambda c: F.col("y_" + c))
    p = p.select("a", "b", evidence.set_jaccard(x("f"), y("f")).alias("fields"), evidence.set_containment(x("f"), y("f")).alias("contained"), evidence.same_value(x("data_source"), y("data_source")).alias("source"), evidence.same_value(x("report_type"), y("report_type")).alias("type"))
    o = evidence.weighted({k: F.col(k) for k in WEIGHTS}, WEIGHTS)
    label = evidence.relation(F.col("o"), F.col("contained"), {90: "near", 70: "similar"}, "contained", 95, 80, "apart")
    return p.withColumn("o", o).select("a", "b", F.round("o", 4).alias("overall"), label.alias("relation"))


_UID_SQL = "try_cast(try_cast(regexp_replace({0}, '[\\s\\x{{a0}}'',]', '', 'g') AS DECIMAL(38,6)) AS BIGINT)"


@query(f"""WITH p AS (SELECT pair_id, {_UID_SQL.format('report_uid_a')} AS a, {_UID_SQL.format('report_uid_b')} AS b, {_LABEL_SQL} AS y, lower(trim(label)) AS raw, sig_name FROM labeled_pairs)
  SELECT pair_id, CASE WHEN a IS NULL OR b IS NULL THEN 'missing end' WHEN a = b THEN 'same record' WHEN raw IS NOT NULL AND y IS NULL AND raw NOT IN ('', '?', 'unsure', 'unknown', 'tbd') THEN 'unknown label' WHEN sig_name IS NOT NULL AND NOT (sig_name BETWEEN 0 AND 100) THEN 'sig_name out of range' END AS error FROM p""")
def label_errors(s: SparkSession, d: str) -> DataFrame:
    """What is wrong with each labelled pair."""
    return checked_pairs(_label_ends(s, d), F.col("a"), F.col("b"), F.col("label"), parsed_label().isNotNull() | F.lower(F.btrim("label")).isin("", "?", "unsure", "unknown", "tbd"), ["sig_name"]).select("pair_id", "error")


def _label_ends(s: SparkSession, d: str) -> DataFrame:
    uid = lambda c: F.regexp_replace(c, "[\\s\\u00a0',]", "").try_cast("decimal(38,6)").cast("long")
    return table(s, d, "labeled_pairs").select("pair_id", uid("report_uid_a").alias("a"), uid("report_uid_b").alias("b"), "label", "sig_name")


@query(f"SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM (SELECT {_UID_SQL.format('report_uid_a')} AS a, {_UID_SQL.format('report_uid_b')} AS b FROM labeled_pairs) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_label_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs that were labelled more than once, in either order."""
    e = _label_ends(s, d).where("a is not null and b is not null")
    return repeated_pairs(e, F.col("a"), F.col("b"))


@query()
def pair_scores(s: SparkSession, d: str) -> DataFrame:
    """Probability of every labelled pair under a small neural model that was fitted on a bounded sample."""
    from ledgerloom.operators import pair_model

    names = ["f_jaccard", "f_jaccard_missing", "f_name", "f_name_missing"]
    x = feature_vectors(s, d).join(scored_labels(s, d).select("pair_id", "y"), "pair_id")
    model = pair_model.fit_sample(x, names, "y", "pair_id")
    return x.select("pair_id", F.round(pair_model.score(model, *names), 6).alias("probability"))


@query()
def daily_runs(s: SparkSession, d: str) -> DataFrame:
    """Events per user and day by the streaming rollup, here over the whole table."""
    from ledgerloom.streaming.rollup import run_counts

    e = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return run_counts(e, "user_id", "ts")


ORACLES["daily_runs"] = "SELECT user_id, date_trunc('day', ts) AS window_start, count(*) AS run_count, max(ts) AS last_run FROM events GROUP BY ALL"

"""Rollups and joins of the report portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.names import casefold, clean_text, name_key


def runs_rollup(runs: DataFrame, key: str, row_id: str, last_run: str, requester: Column, mode: Column, owner: Column) -> DataFrame:
    """Per key: rows, latest run, distinct requesters, sorted modes, first owner in row order, unusable times.

    All aggregates combine before the shuffle; distinct requesters are counted from distinct pairs, so a key
    with a third of all rows is never gathered in one task.
    """
    base = runs.select(F.col(key).alias("k"), F.col(row_id).alias("r"), F.col(last_run).alias("t"), requester.alias("q"), mode.alias("m"), owner.alias("o")).where("k <> ''")
    whole = base.groupBy("k").agg(
        F.count("*").alias("run_count"), F.max("t").alias("last_run"), F.count_if(F.col("t").isNull()).alias("missing_times"),
        F.array_join(F.array_sort(F.collect_set("m")), ", ").alias("modes"), F.min(F.when(F.col("o").isNotNull(), F.struct("r", "o"))).alias("first"),
    )
    people = base.where("q is not null").select("k", "q").distinct().groupBy("k").agg(F.count("*").alias("distinct_requesters"))
    out = whole.join(people, "k", "left")
    return out.select(F.col("k").alias(key), "run_count", "last_run", "missing_times", "modes", F.col("first.o").alias("owner"), F.coalesce("distinct_requesters", F.lit(0)).alias("distinct_requesters"))


def join_rollup(reports: DataFrame, rollup: DataFrame, key: str, own_last: str) -> DataFrame:
    """Reports with their run figures (zeros if never run), the later of both last runs and which was later."""
    joined = reports.join(rollup.select(key, "run_count", "last_run", "distinct_requesters"), key, "left")
    newer = F.col("last_run").isNotNull() & (F.col(own_last).isNull() | (F.col("last_run") > F.col(own_last)))
    return joined.withColumns({"effective_last_run": F.greatest(own_last, "last_run"), "runs_newer": newer, "run_count": F.coalesce("run_count", F.lit(0)), "distinct_requesters": F.coalesce("distinct_requesters", F.lit(0)), "matched": F.col("run_count").isNotNull()}).drop("last_run")


def where_used_lines(fields: DataFrame, cell: str) -> DataFrame:
    """One row per distinct report key of a cell whose names are parted by line breaks only."""
    keys = F.array_distinct(F.filter(F.transform(F.split(F.col(cell), r"\r\n|\r|\n"), name_key), lambda x: x != ""))
    return fields.withColumn("report_key", F.explode(keys))


def field_rollup(links: DataFrame, field_id: str, name: str, sets: dict[str, str]) -> DataFrame:
    """Per report key: distinct fields, their sorted ids and names, and sorted folded sets of other columns."""
    aggs = [F.countDistinct(field_id).alias("field_count"), F.array_join(F.array_sort(F.collect_set(F.col(field_id).cast("string"))), "|").alias("signature"), F.array_join(F.array_sort(F.collect_set(clean_text(F.col(name)))), "; ").alias("field_names")]
    aggs += [F.array_join(F.array_sort(F.collect_set(casefold(clean_text(F.col(c))))), "; ").alias(out) for out, c in sets.items()]
    return links.groupBy("report_key").agg(*aggs)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, pct): rows with a value that is not blank, per column, in one pass."""
    types = dict(df.dtypes)
    filled = [F.count_if(F.col(c).isNotNull() & (F.btrim(F.col(c)) != "") if types[c] == "string" else F.col(c).isNotNull()).alias(c) for c in columns]
    one = df.agg(F.count("*").alias("_n"), *filled)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])).alias("x")
    return one.select(rows, "_n").select("x.field", "x.filled", F.bround(100 * F.col("x.filled") / F.greatest("_n", F.lit(1)), 1).alias("pct"))


def repeated_keys(df: DataFrame, key: Column) -> DataFrame:
    """Keys that several rows share, with their number."""
    return df.select(key.alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


#: Most names in a text list of ``field_profiles``; the whole list stands in the link rows.
LISTED = 1_000


def field_links(fields: DataFrame, field_id: str, lines: str | None = None, report_id: str | None = None, report_name: str | None = None) -> DataFrame:
    """``fields`` plus report_key and match_type, one row per field and report it is used in.

    The lines of ``lines`` come first ('where_used'), then the report id ('report_id'), then the report name
    ('report_name'); a field without any of them has one row with a null key. Repeated lines of a cell count once.
    """
    none = F.array().cast("array<string>")
    keys = F.coalesce(F.array_distinct(F.filter(F.transform(F.split(F.col(lines), r"\r\n|\r|\n"), name_key), lambda x: x != "")), none) if lines else none
    by_id = F.lower(F.btrim(F.col(report_id))) if report_id else F.lit(None).cast("string")
    by_name = name_key(F.col(report_name)) if report_name else F.lit(None).cast("string")
    one = lambda c, kind: F.when(F.coalesce(c, F.lit("")) != "", F.array(F.struct(c.alias("report_key"), F.lit(kind).alias("match_type"))))
    many = F.when(F.size(keys) > 0, F.transform(keys, lambda k: F.struct(k.alias("report_key"), F.lit("where_used").alias("match_type"))))
    empty = F.array(F.struct(F.lit(None).cast("string").alias("report_key"), F.lit(None).cast("string").alias("match_type")))
    return fields.select("*", F.explode(F.coalesce(many, one(by_id, "report_id"), one(by_name, "report_name"), empty)).alias("_l")).select(*fields.columns, "_l.report_key", "_l.match_type")


def field_profiles(links: DataFrame, field_id: str, name: str, sets: dict[str, str]) -> DataFrame:
    """Per report key: field_count, match_type, a signature of the field ids, the names, and the distinct values of ``sets``.

    Values are made distinct before they are gathered, so a key with a third of all rows brings only its distinct
    values together; ids are never gathered: their number and an order-free hash stand for them. Of the names
    the first ``LISTED`` are kept; ``field_links`` has them all.
    """
    used = links.where("report_key is not null")
    ids = used.select("report_key", F.col(field_id).alias("i"), "match_type").distinct()
    whole = ids.groupBy("report_key").agg(F.count("*").alias("field_count"), F.min("match_type").alias("match_type"), F.sum(F.xxhash64("i").cast("decimal(38,0)")).cast("string").alias("signature"))
    values = F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.lit(k != "names"), casefold(clean_text(F.col(c)))).otherwise(clean_text(F.col(c))).alias("v")) for k, c in {"names": name, **sets}.items()])
    each = used.select("report_key", F.explode(values).alias("x")).select("report_key", "x.k", "x.v").where("v is not null").distinct()
    # the rank of a name is cut off before the names meet
    rank = F.row_number().over(Window.partitionBy("report_key").orderBy("v"))
    kept = each.where("k <> 'names'").unionByName(each.where("k = 'names'").withColumn("_r", rank).where(F.col("_r") <= LISTED).drop("_r"))
    listed = kept.groupBy("report_key", "k").agg(F.array_sort(F.collect_set("v")).alias("vs")).groupBy("report_key").agg(F.map_from_entries(F.collect_list(F.struct("k", "vs"))).alias("m"))
    out = whole.join(listed, "report_key", "left")
    return out.select("report_key", "field_count", "match_type", "signature", *[F.coalesce(F.col("m")[k], F.array().cast("array<string>")).alias(k) for k in ("names", *sets)])


def field_diagnostics(links: DataFrame, field_id: str, lines: str, known: DataFrame) -> DataFrame:
    """(figure, n): counts of field rows, links, unmatched rows, parsed, blank and unparsed cells, fields of several reports, keys that no report has.

    ``known`` is (report_key) of the reports.
    """
    per = links.groupBy(field_id).agg(F.count("report_key").alias("keys"), F.max(F.btrim(F.col(lines))).alias("cell"), F.max("match_type").alias("kind"))
    has = F.coalesce(F.col("cell"), F.lit("")) != ""
    figures = {
        "total_field_rows": F.count("*"), "total_report_field_links": F.sum("keys"), "total_unmatched_rows": F.count_if(F.col("keys") == 0), "total_where_used_rows_parsed": F.count_if(has),
        "total_where_used_parse_failures": F.count_if(has & (F.coalesce(F.col("kind"), F.lit("")) != "where_used")), "blank_where_used_rows": F.count_if(~has), "multi_report_field_rows": F.count_if(F.col("keys") > 1),
    }
    one = per.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in figures.items()])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), F.col(k).alias("n")) for k in figures])).alias("r")).select("r.*")
    lost = links.where("report_key is not null").select("report_key").distinct().join(known.select("report_key").distinct(), "report_key", "left_anti")
    return rows.unionByName(lost.agg(F.count("*").alias("n")).select(F.lit("unmatched_where_used_reports").alias("figure"), "n"))


def attach_fields(reports: DataFrame, profiles: DataFrame, key: str, report_id: str | None = None) -> DataFrame:
    """``reports`` plus field_count, signature and field_extraction_status: by report id first, then by name key."""
    p = profiles.select("report_key", "field_count", "signature")
    out = reports.join(p.select(F.col("report_key").alias(key), F.col("field_count").alias("_n"), F.col("signature").alias("_s")), key, "left")
    if report_id:
        by_id = p.select(F.col("report_key").alias("_id"), F.col("field_count").alias("_m"), F.col("signature").alias("_t"))
        out = out.join(by_id, F.lower(F.btrim(F.col(report_id))) == F.col("_id"), "left")
        found = F.col("_m").isNotNull()
        out = out.withColumns({"_n": F.when(found, F.col("_m")).otherwise(F.col("_n")), "_s": F.when(found, F.col("_t")).otherwise(F.col("_s"))}).drop("_id", "_m", "_t")
    status = F.when(F.col("_n").isNull(), F.lit("No fields found")).otherwise(F.lit("Matched"))
    return out.select(*reports.columns, F.coalesce("_n", F.lit(0)).cast("long").alias("field_count"), F.col("_s").alias("signature"), status.alias("field_extraction_status"))

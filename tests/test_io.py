import io
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom import config
from ledgerloom.pipeline import analyse, run_pipeline
from ledgerloom.sinks import writers
from ledgerloom.sources import guards, headers, sheets

HEAD = "Custom Report{0}Number of Times Executed{0}Last Run Date{0}Shared"
ROW = "Active Employee Report{0}240{0}2026-05-01{0}Yes"


@pytest.mark.parametrize("sep, lead", [(",", ""), (";", ""), ("\t", ""), (",", "﻿"), (",", "Export of reports\n\nFilter: none,\n")])
def test_delimited(spark, tmp_path, sep, lead):
    p = tmp_path / "t.csv"
    p.write_text(lead + HEAD.format(sep) + "\n" + ROW.format(sep) + "\n", encoding="utf-8")
    df = sheets.read_sheet(spark, str(p))
    assert df.columns == ["row_id", *HEAD.split("{0}")]
    assert [tuple(r) for r in df.collect()] == [(0, *ROW.split("{0}"))]


def test_ragged_and_quoted(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('a,b,c\n1,"x\ny"\n\n4,5,6\n')
    rows = [tuple(r) for r in sheets.read_sheet(spark, str(p)).orderBy("row_id").collect()]
    assert rows == [(0, "1", "x\ny", None), (1, None, None, None), (2, "4", "5", "6")]


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("=x", 1.5, ["a", "b"]), (None, None, None)], "t string, n double, l array<string>")
    path = str(tmp_path / "w.xlsx")
    writers.write_workbook(path, {"A/B": df, "A:B": df})
    guards.check_content(path, open(path, "rb").read())
    got = sheets.read_sheet(spark, path)
    assert got.columns == ["row_id", "t", "n", "l"] and tuple(got.first()) == (0, "'=x", "1.5", "a; b")
    with pytest.raises(FileExistsError):
        writers.write_workbook(path, {"A": df})


def test_guards(spark):
    with pytest.raises(guards.RejectedFile):
        guards.check_content("a.csv", b"a\x00b")
    with pytest.raises(guards.RejectedFile):
        guards.check_content("a.xlsx", b"no zip")
    with pytest.raises(guards.RejectedFile):
        guards.check_content("a.exe", b"x")
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"0" * 12_000_000)
    with pytest.raises(guards.RejectedFile):
        guards.check_content("a.xlsx", bomb.getvalue())
    with pytest.raises(guards.RejectedFile):
        guards.check_table(spark.range(11), guards.Limits(rows=10))


def test_headers():
    m = headers.match_headers(["-", "Report Name", "Owner (full)", "LAST_RUN-date"], headers.ALIASES["comprehensive"])
    assert m == {"report_name": "Report Name", "last_run_date": "LAST_RUN-date", "owner": "Owner (full)"}
    # the preferred spelling counts, not the first header
    assert headers.match_headers(["Report Name", "Custom Report"], headers.ALIASES["comprehensive"])["report_name"] == "Custom Report"
    assert headers.match_headers(["Used In", "Where_Used"], headers.ALIASES["fields"])["t3_where_used"] == "Where_Used"
    assert headers.match_headers(["Worklet Landing Pages", "Landing Page"], headers.ALIASES["comprehensive"]) == {"landing_page": "Worklet Landing Pages", "report_landing_page": "Landing Page"}


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "r.db")
    df = spark.createDataFrame([(1, True)], "id int, ok boolean")
    assert writers.write_sqlite(df, path, "t") == 1
    writers.write_sqlite(df.withColumn("extra", F.lit("x")), path, "t", keep_history=True)
    assert sqlite3.connect(path).execute("SELECT id, ok, extra FROM t ORDER BY extra").fetchall() == [(1, 1, None), (1, 1, "x")]


def test_settings(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"burst_minutes": 10, "cadences": {"daily": [1, 2]}}')
    assert config.load(str(p)).burst_minutes == 10
    p.write_text('{"cadences": {"daily": [3, 2]}}')
    with pytest.raises(config.ConfigError):
        config.load(str(p))
    p.write_text('{"nonsense": 1}')
    with pytest.raises(config.ConfigError):
        config.load(str(p))


def test_pipeline(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Report Name,Number of Times Executed,Last Run Date,Owner\nHeadcount Summary,3,2026-01-01,Ann\nCopy of Headcount Summary,1,2026-01-02,Bo\nPayroll List,,,\n")
    (tmp_path / "2.csv").write_text("Report Name,Start Date and Time,Requested By\n" + "".join(f"headcount  summary,2026-01-{d:02d} 09:00,Cy\n" for d in range(1, 9)))
    (tmp_path / "3.csv").write_text('Field Name,Business Object,Where Used\nWorker,Staff,"Headcount Summary; Payroll List"\nPlan,Pay,"Payroll List"\n')
    out = run_pipeline(spark, *(str(tmp_path / f"{i}.csv") for i in (1, 2, 3)), str(tmp_path / "out"), config.Settings(sensitive=True))
    reports = {r.report_uid: r for r in out.reports.collect()}
    assert reports[0].run_count == 8 and reports[0].cadence == "daily" and reports[2].run_count == 0
    assert [(r.a, r.b, r.name_match) for r in out.pairs.where("name_match").collect()] == [(0, 1, True)]
    assert {r.report_uid: r.group_uid for r in out.groups.collect()}[1] == 0
    assert spark.read.parquet(str(tmp_path / "out" / "all_reports")).where("owner = '***'").count() == 2


def test_pipeline_without_executions_and_with_too_many_columns(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Report Name,Number of Times Executed,Last Run Date,Owner\nHeadcount Summary,3,2026-01-01,Ann\nPayroll List,,,\n")
    out = run_pipeline(spark, str(tmp_path / "1.csv"), None, None, str(tmp_path / "out"))
    assert {r.report_uid: r.run_count for r in out.reports.collect()} == {0: 0, 1: 0}
    (tmp_path / "wide.csv").write_text(",".join(f"c{k}" for k in range(1100)) + "\n" + ",".join("x" * 1100) + "\n")
    with pytest.raises(guards.RejectedFile):
        run_pipeline(spark, str(tmp_path / "wide.csv"), None, None, str(tmp_path / "out2"))


def test_pipeline_compares_names_in_blocks_above_400(spark):
    one = [(k, f"Staff {w} Overview") for k, w in enumerate(f"{a}{b}" for a in "bcdfghjklmnpqrstvwxz" for b in "bcdfghjklmnpqrstvwxyz")] + [(900, "Staff Headcount Listing"), (901, "Staff Headcount Listings")]
    reports = spark.createDataFrame(one, "row_id long, report_name string").selectExpr("*", "'1' AS times_run", "'' AS last_run_date", "'' AS shared", "'' AS owner", "'' AS created_by")
    runs = spark.createDataFrame([], "row_id long, t2_report_name string, t2_report_owner string, t2_requested_by string, t2_requested_id string, t2_exec_mode string, t2_start_date string")
    assert len(one) > 400
    got = {(r.a, r.b) for r in analyse(spark, reports, runs, None).pairs.collect()}
    assert (900, 901) in got


def test_pipeline_compares_names_that_share_a_business_object(spark):
    names = ["Headcount Summary Listing", "Geadcount Summary Listing", "Feadcount Summary Listing"]
    reports = spark.createDataFrame(list(enumerate(names)), "row_id long, report_name string").selectExpr("*", "'1' AS times_run", "'' AS last_run_date", "'' AS shared", "'' AS owner", "'' AS created_by")
    runs = spark.createDataFrame([], "row_id long, t2_report_name string, t2_report_owner string, t2_requested_by string, t2_requested_id string, t2_exec_mode string, t2_start_date string")
    fields = spark.createDataFrame([(k, f"f{k}", o, n) for k, (o, n) in enumerate(zip(["Worker", " worker", "Pay"], names))], "row_id long, t3_field_name string, t3_business_object string, t3_where_used string")
    assert [(r.a, r.b, r.name_match, r.shared) for r in analyse(spark, reports, runs, fields).pairs.collect()] == [(0, 1, True, None)]

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import names, rules
from ledgerloom.functions.similarity import common_subsequence, token_sort_ratio


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw, want", [("  ACTIVE   employee\tReport ", "active employee report"), ("Ove​rtime﻿", "overtime"), ("Straße ΣΟΦΟΣ", "strasse σοφοσ"), (None, ""), ("", "")])
def test_name_key(spark, raw, want):
    assert one(spark, names.name_key, raw) == want


@pytest.mark.parametrize("raw, want", [("2019 Annual Performance (Copy)", "annual performance"), ("Annual Performance v2", "annual performance"), (None, ""), ("Copy of Report", "")])
def test_denoised(spark, raw, want):
    assert one(spark, names.denoised_name, raw) == want


def test_cleaning(spark):
    assert one(spark, names.clean_text, "  N/A ") is None and one(spark, names.clean_text, " a  b ") == "a b"
    assert one(spark, names.to_number, " $1,234 ") == 1234.0 and one(spark, names.to_number, "abc") is None
    assert [one(spark, names.to_bool, x) for x in ("Yes", " f ", "???", None)] == [True, False, None, None]
    assert one(spark, names.field_set, "Worker_ID; worker id|*|Plan-Name\r\n") == ["plan name", "worker id"]
    assert one(spark, names.field_set, None) == []


def test_rules(spark):
    bounds = lambda c: rules.tier(c, [(365, 1), (1095, 3), (730, 2)], 9)
    assert [one(spark, bounds, x, "int") for x in (None, 365, 366, 731, 1096)] == [9, 0, 1, 2, 3]
    assert one(spark, lambda c: rules.label_at_least(c, {0: "low", 60: "mid", 80: "high"}), 79, "int") == "mid"
    assert one(spark, lambda c: rules.label_at_most(c, {14: "keep", 29: "look"}), 14, "int") == "keep"
    assert one(spark, rules.spreadsheet_safe, "=1+1") == "'=1+1" and one(spark, rules.mask, "Ann") == "***" and one(spark, rules.mask, " ") == " "
    t = lambda c: rules.render_trail(rules.trail([("a", F.lit("old"), F.lit(30)), ("b", c, F.lit(-4)), ("c", F.lit("note"), F.lit(None))]))
    assert one(spark, t, "shared") == "+30 old; -4 shared; note" and one(spark, t, None) == "+30 old; note"


def brute(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("a, b", [("active worker list", "active worker listing"), ("", "x"), ("annual review 2017", "annual review 2018"), ("äöü", "öüä"), ("a" * 300, "a" * 299 + "b")])
def test_common_subsequence(a, b):
    assert common_subsequence(a, b) == brute(a, b) == common_subsequence(b, a)


def test_token_sort_ratio():
    assert token_sort_ratio("", "") == 100.0 and token_sort_ratio("list worker", "worker list") == 100.0
    assert round(token_sort_ratio("active worker list", "active worker listing"), 1) == 92.3

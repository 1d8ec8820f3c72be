from pyspark.sql import functions as F

from ledgerloom.functions import evidence
from ledgerloom.sources.labels import checked_pairs, repeated_pairs


def test_sets_and_values(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d", "e"], " Advanced ", "advanced"), ([], ["a"], " ", "x"), (None, ["a"], None, "x")], "a array<string>, b array<string>, x string, y string")
    got = [tuple(r) for r in df.select(evidence.set_jaccard(F.col("a"), F.col("b")), evidence.set_containment(F.col("a"), F.col("b")), evidence.same_value(F.col("x"), F.col("y"))).collect()]
    assert (got[0][0], round(got[0][1], 3), got[0][2]) == (40.0, 66.667, 100.0) and got[1:] == [(None, None, None)] * 2


def test_weights_renormalise(spark):
    w = {"f": 0.6, "n": 0.3, "s": 0.1}
    df = spark.createDataFrame([(50.0, 100.0, 0.0), (None, 100.0, None), (None, None, None), (0.0, None, None)], "f double, n double, s double")
    sig = {k: F.col(k) for k in w}
    got = [r[0] for r in df.select(F.round(evidence.weighted(sig, w), 6)).collect()]
    assert got == [60.0, 100.0, None, 0.0]
    top = [r[0] for r in df.select(F.round(evidence.ceiling(sig, w, ["f"]), 6)).collect()]
    assert top == [70.0, 100.0, 100.0, 40.0]
    assert df.select(evidence.evidence_text(sig)).first()[0] == "f=50%; n=100%; s=0%"
    assert df.select(evidence.evidence_text(sig)).collect()[1][0] == "f=n/a; n=100%; s=n/a"


def test_relation(spark):
    df = spark.createDataFrame([(95.0, 100.0), (85.0, 96.0), (85.0, 50.0), (75.0, 99.0), (None, None)], "o double, c double")
    got = [r[0] for r in df.select(evidence.relation(F.col("o"), F.col("c"), {90: "near", 80: "strong", 70: "possible"}, "contained", 95, 80, "apart")).collect()]
    assert got == ["near", "contained", "strong", "possible", "apart"]


def test_labels(spark):
    df = spark.createDataFrame([(1, 2, "yes", 5.0), (1, 1, "yes", 5.0), (None, 1, "yes", 5.0), (3, 4, "maybe so", 5.0), (3, 4, None, 500.0), (2, 1, "no", None)], "a long, b long, l string, p double")
    out = checked_pairs(df, F.col("a"), F.col("b"), F.col("l"), F.col("l").isin("yes", "no"), ["p"])
    assert [r.error for r in out.collect()] == [None, "same record", "missing end", "unknown label", "p out of range", None]
    assert sorted(tuple(r) for r in repeated_pairs(df, F.col("a"), F.col("b")).collect()) == [(1, 2, 2), (3, 4, 2)]

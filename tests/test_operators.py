import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import token_sort_ratio
from ledgerloom.operators.lookup import looked_up
from ledgerloom.operators import blocking, bursts, metrics, ordering, pair_model, rollups
from ledgerloom.operators.components import components
from ledgerloom.operators.similar_names import similar_names


def collapse(times, window):
    kept = []
    for t in sorted(set(times)):
        if not kept or t - kept[-1] > window:
            kept.append(t)
    return kept


@pytest.mark.parametrize("seed, spread", [(1, 40), (2, 400), (3, 4000)])
def test_bursts_against_the_sequential_rule(spark, seed, spread):
    r = random.Random(seed)
    rows = [(r.choice("abc"), r.randrange(-spread, spread) * 7) for _ in range(400)] + [("hot", 5 * k) for k in range(600)] + [(None, 1), ("a", None)]
    df = spark.createDataFrame(rows, "k string, t long")
    got = {}
    for x in bursts.burst_starts(df, "k", "t", 30, blocks_of=4).collect():
        got.setdefault(x.k, []).append(x.t)
    for k in (*"abc", "hot"):
        assert sorted(got[k]) == collapse([t for a, t in rows if a == k and t is not None], 30)
    assert None not in got
    assert bursts.burst_starts(df.limit(0), "k", "t", 30).count() == 0


DAY = 86_400_000_000


@pytest.mark.parametrize(
    "days, want",
    [([0, 1, 2, 3, 4, 5], ("daily", "Strong")), ([0, 7, 14, 21, 28], ("weekly", "Strong")), ([0, 7, 14], ("weekly", "Moderate")), ([0, 7], (None, "Insufficient History")), ([0, 3, 50, 90], (None, "No Recurring Pattern")), ([0, 28, 61, 91, 125], ("monthly", "Strong"))],
)
def test_recurrence(spark, days, want):
    df = spark.createDataFrame([("r", d * DAY) for d in days], "k string, t long")
    row = bursts.recurrence(df, "k", "t").first()
    assert (row.cadence, row.classification) == want and row.occurrences == len(days)


def union_find(edges):
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        p[max(x, y)] = min(x, y)
    return {v: find(v) for v in p}


def test_components(spark):
    r = random.Random(5)
    ids = r.sample(range(1000), 60)
    edges = list(zip(ids, ids[1:])) + [(2000 + r.randrange(80), 2000 + r.randrange(80)) for _ in range(60)] + [(5000, x) for x in range(5001, 5100)] + [(1, 1)]
    df = spark.createDataFrame(edges + [(None, 3), (4, None)], "a long, b long")
    got = {x.node: x.component for x in components(df, "a", "b").collect()}
    want = union_find([e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(df.limit(0), "a", "b").count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1), (None, 0.5), (1, None)], "y int, s double")
    assert metrics.ranking_metrics(df, "s", "y").first()[2:] == (0.75, round(5 / 6, 6))
    c = metrics.confusion(df, "s", "y", 0.75).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.f1) == (1, 1, 1, 1, 0.5)
    assert metrics.best_threshold(df, "s", "y", 0.9).first().threshold == 0.9
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double")
    assert metrics.ranking_metrics(ties, "s", "y").first().roc_auc == 0.5
    none = metrics.ranking_metrics(ties.where("y = 0"), "s", "y").first()
    assert none.roc_auc is None and none.average_precision is None


def test_global_rank_and_partners(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert sorted((r.x, r.rank) for r in ordering.global_rank(df, ["x"]).collect()) == [(i, i + 1) for i in range(1000)]
    pairs = spark.createDataFrame([(1, 2, 5.0), (1, 3, 5.0), (2, 3, 1.0), (4, 4, 9.0), (None, 1, 9.0)], "a long, b long, s double")
    ends = ordering.both_directions(pairs, "a", "b", ["s"])
    assert sorted(tuple(r) for r in ordering.best_partner(ends, F.col("s")).collect()) == [(1, 2, 5.0, 2), (2, 1, 5.0, 2), (3, 1, 5.0, 2)]
    assert ordering.top_partners(ends, "s", 1).count() == 3


def test_blocking_and_overlap(spark):
    sets = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "d"]), (3, ["z"])], "u long, f array<string>")
    items = sets.select("u", F.explode("f").alias("i"))
    p = blocking.with_overlap(blocking.shared_counts(items, "u", "i"), sets, "u", "f").collect()
    assert [tuple(x) for x in p] == [(1, 2, 2, 50.0, 66.7)]
    assert blocking.shared_counts(items, "u", "i", most=1).count() == 0


def test_linked_sets_in_blocks_of_any_size(spark):
    r = random.Random(6)
    rows = [(k, sorted(r.sample("abcdefghij", r.randrange(1, 7)))) for k in range(450)] + [(900, ["a"]), (901, []), (902, None), (903, ["only"])]
    sets = spark.createDataFrame(rows, "u long, f array<string>")
    for j, c in ((50, 80), (90, 100), (0, 0)):
        got = {(x.a, x.b): (x.shared, x.jaccard, x.containment) for x in blocking.linked_sets(sets, "u", "f", j, c).collect()}
        want = set()
        for a, x in rows:
            for b, y in rows:
                if x and y and a < b and (n := len({*x} & {*y})) and (round(100 * n / len({*x, *y}), 1) >= j or round(100 * n / min(len(x), len(y)), 1) >= c):
                    want.add((a, b))
        assert set(got) == want and len(want) > 1000
    items = sets.select("u", F.explode("f").alias("i"))
    assert blocking.shared_counts(items, "u", "i", 100).count() == 0  # every block is above a cap of 100


@pytest.mark.parametrize("least", [90.0, 75.0, 50.0])
def test_similar_names_against_all_pairs(spark, least):
    r = random.Random(7)
    words = ["staff", "pay", "list", "2024", "q1", "a", "headcount", "cost", "x"]
    names = {" ".join(r.choice(words) for _ in range(r.randrange(1, 5))) for _ in range(70)}
    names |= {"".join(c for c in n if r.random() > 0.08) for n in names} | {"ab", "abc", "abcd"}
    digits = lambda n: {*re.findall(r"\d+", n)}
    want = {(a, b) for a in names for b in names if a and b and a < b and digits(a) == digits(b) and token_sort_ratio(a, b) >= least}
    got = similar_names(spark.createDataFrame([(n,) for n in [*names, "", None]], "n string"), "n", least).collect()
    assert len(got) == len({tuple(x) for x in got}) and {tuple(x) for x in got} == want and want


def test_rollups(spark):
    runs = spark.createDataFrame([("a", 2, None, "p", "m1", None), ("a", 1, None, "q", "m2", "o2"), ("a", 3, None, "p", "m1", "o1"), ("", 4, None, "p", "m", "o")], "k string, r long, t timestamp, q string, m string, o string")
    row = rollups.runs_rollup(runs, "k", "r", "t", F.col("q"), F.col("m"), F.col("o")).collect()
    assert len(row) == 1 and tuple(row[0]) == ("a", 3, None, 3, "m1, m2", "o2", 2)
    assert {r.field: r.pct for r in rollups.coverage(runs, ["k", "o"]).collect()} == {"k": 75.0, "o": 75.0}


def test_pair_model(spark, tmp_path):
    rows = [(i, (i % 100) / 100, 0.0, int(i % 100 > 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, x double, z double, y int")
    model = pair_model.fit_sample(df, ["x", "z"], "y", "id")
    out = df.select("y", pair_model.score(model, "x", "z").alias("p"))
    assert out.where((F.col("p") >= 0.5).cast("int") != F.col("y")).count() < 60
    path = str(tmp_path / "m.json")
    pair_model.save(model, path)
    again = pair_model.load(path, ["x", "z"])
    assert abs(again.probability(__import__("numpy").array([[0.9, 0.0]]))[0] - model.probability(__import__("numpy").array([[0.9, 0.0]]))[0]) < 1e-12
    with pytest.raises(ValueError):
        pair_model.load(path, ["z", "x"])


def test_looked_up_with_hot_keys(spark):
    big = spark.createDataFrame([(k, 1 if k % 3 else k) for k in range(300)], "u long, key long")
    small = spark.createDataFrame([(1, "hot", 200), (3, "c", 1), (6, None, 1)], "key long, v string, n long")
    got = {r.u: r.v for r in looked_up(big, small, "key", "u", "n", limit=50, salts=4).collect()}
    assert got == {k: "hot" if k % 3 else "c" if k == 3 else None for k in range(300)}


def test_choose_threshold(spark):
    from ledgerloom.operators.metrics import choose_threshold

    def pick(rows, floor):
        return tuple(choose_threshold(spark.createDataFrame(rows, "s double, y int"), "s", "y", floor).first())

    assert pick([], 0.9) == (0.5, "no rows") and pick([(0.2, 0), (None, 1)], 0.9) == (1.0, "no positives")
    assert pick([(0.9, 1), (0.8, 1), (0.4, 0)], 0.9) == (0.8, "floor")
    assert pick([(0.9, 0), (0.4, 1), (0.4, 0)], 0.9) == (0.4, "no floor")
    assert pick([(0.9, 1), (0.2, 0)], 0.9)[0] == 0.9
    with pytest.raises(ValueError):
        pick([], 2)


def test_clean_lines(spark):
    from ledgerloom.functions.names import clean_lines

    df = spark.createDataFrame([(" a \t b \r\nc\rd  ",), ("n/a",), (None,), ("\n\n",)], "t string")
    assert [r[0] for r in df.select(clean_lines(F.col("t"))).collect()] == ["a b\nc\nd", None, None, None]

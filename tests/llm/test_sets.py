import random

import numpy as np
import pytest

from ledgerloom.llm.set_similarity import choose_small, needed, record_pairs, similar_between, similar_sets, subset_keys


def test_needed_is_the_exact_bound():
    for s in range(1, 40):
        for p in range(1, 40):
            for o in range(1, min(s, p) + 1):
                assert (4 * o >= 3 * (s + p - o)) == (o >= needed(s, p, 3, 4))


def test_equal_subsets_have_equal_keys():
    a, b = np.array([[1, 2, 3, 9]], dtype=np.uint64), np.array([[9, 1, 2, 7]], dtype=np.uint64)
    ka = {(lo, hi): set(k.ravel().tolist()) for lo, hi, k in subset_keys(a, 8, 3, 5)}
    kb = {(lo, hi): set(k.ravel().tolist()) for lo, hi, k in subset_keys(b, 8, 3, 5)}
    assert ka[4, 4] & kb[4, 4]


@pytest.mark.parametrize("seed, threshold, small", [(1, (3, 4), 8), (2, (3, 4), 3), (3, (1, 2), 5), (4, (9, 10), None), (5, (1, 2), 0), (6, (3, 4), None)])
def test_against_all_pairs(spark, seed, threshold, small):
    r = random.Random(seed)
    base = [[f"t{r.randrange(60)}" for _ in range(r.choice([1, 2, 3, 5, 8, 9, 12, 20, 30]))] for _ in range(60)]
    rows = []
    for i in range(260):
        s = list(r.choice(base))
        for _ in range(r.randrange(4)):
            s[r.randrange(len(s))] = f"t{r.randrange(60)}"
        if r.random() < 0.3:
            s.append("hot")
        rows.append((i, s))
    rows += [(900, []), (901, None), (902, [None]), (903, ["hot"]), (904, ["hot", "hot"]), (903, ["hot"])]
    sets = {i: {x for x in s or [] if x is not None} for i, s in rows}
    sets = {i: s for i, s in sets.items() if s}
    t = threshold[0] / threshold[1]
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12}
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "u long, f array<string>, cls string")
    got = [(x.a, x.b) for x in record_pairs(*similar_sets(df, "u", "f", threshold, small)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty(spark):
    members, pairs = similar_sets(spark.createDataFrame([], "u long, f array<string>"), "u", "f")
    assert members.count() == 0 and pairs.count() == 0
    assert similar_between(spark.createDataFrame([], "u long, f array<string>"), spark.createDataFrame([(1, ["a"])], "u long, f array<string>"), "u", "f").count() == 0


@pytest.mark.parametrize("seed, small", [(1, None), (2, 4), (3, 0)])
def test_between_two_tables(spark, seed, small, monkeypatch):
    from ledgerloom.llm import set_similarity

    monkeypatch.setattr(set_similarity, "EXPAND", 7)  # large classes go in parts
    r = random.Random(seed)
    base = [frozenset(r.sample([f"t{k}" for k in range(40)], r.choice([1, 2, 4, 6, 9, 15]))) for _ in range(25)]

    def some(n):
        out = []
        for i in range(n):
            s = set(r.choice(base))
            if r.random() < 0.6:
                s ^= {f"t{r.randrange(40)}"}
            out.append((i - 5, sorted(s)))
        return [*out, (9_000_000_000_000_000_000, sorted(base[0])), (7000, None), (None, ["t1"])]

    left, right = some(120), some(90) + [(k + 500, ["one"]) for k in range(60)]
    left += [(k + 600, ["one"]) for k in range(30)]
    ok = lambda x, y: x and y and 4 * len({*x} & {*y}) >= 3 * len({*x} | {*y})
    want = {(a, b) for a, x in left for b, y in right if a is not None and b is not None and ok(x, y)}
    ld, rd = spark.createDataFrame(left, "u long, f array<string>"), spark.createDataFrame([(*x, 1) for x in right], "u long, f array<string>, side int")
    got = [(x.a, x.b) for x in similar_between(ld, rd, "u", "f", (3, 4), small).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_boundary_follows_the_data():
    assert choose_small({3: (1000, 10**9), 20: (10, 100)}, 3, 4) >= 3
    assert choose_small({3: (1000, 10), 9: (1000, 10)}, 3, 4) == 0
    assert choose_small({}, 3, 4) == 0

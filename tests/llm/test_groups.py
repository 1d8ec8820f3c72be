import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.graph import canonical_edges, contract
from ledgerloom.llm.match_groups import match_groups, peel
from ledgerloom.llm.ranks import ranked_within
from ledgerloom.llm.related_splits import QUARANTINE, SplitStore, plan_by_size, split_pairs
from ledgerloom.llm.survivors import keepers, survivors
from ledgerloom.storage import Workspace


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


def graph(seed):
    r = random.Random(seed)
    chain = r.sample(range(10_000, 11_000), 120)
    hub = [(5, x) for x in range(20_000, 20_300)]
    loose = [(r.randrange(100, 260), r.randrange(100, 260)) for _ in range(90)]
    return list(zip(chain, chain[1:])) + hub + [(20_100, 20_400), (20_400, 20_500)] + loose + [(7, 7), (5, 20_001), (20_001, 5)]


@pytest.mark.parametrize("full", [True, False])
def test_contract(spark, full):
    ws = Workspace(spark, "t")
    edges = graph(1)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.ptr for r in contract(ws, ws.write(canonical_edges(df, "a", "b"), "e"), full).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])


def test_match_groups(spark):
    edges = graph(2)
    df = spark.createDataFrame([(*e, "x") for e in edges] + [(None, 1, "x"), (2, None, "x")], "a long, b long, id string")
    want = union_find([e for e in edges if e[0] != e[1]])
    got = match_groups(df, "a", "b").collect()
    assert {r.id: r.group_id for r in got} == want and len(got) == len(want)
    assert all(r.member_count == sum(v == r.group_id for v in want.values()) for r in got)
    assert match_groups(df.limit(0), "a", "b").count() == 0


def test_search_that_is_cut_short_keeps_groups_whole(spark):
    ws = Workspace(spark, "t")
    edges = [(k, k + 1) for k in range(60)] + [(30, x) for x in range(100, 110)]
    df = spark.createDataFrame(edges, "a long, b long")
    e = ws.write(canonical_edges(df, "a", "b"), "e")
    members, root, ended = peel(ws, e, max_rounds=3)
    assert not ended and members.count() == 17 and root == 27
    import ledgerloom.llm.match_groups as mg

    whole, mg.peel = mg.peel, lambda ws, e: whole(ws, e, 3)
    try:
        assert {r.group_id for r in match_groups(df, "a", "b").collect()} == {0}
    finally:
        mg.peel = whole


def test_ranked_within(spark):
    df = spark.createDataFrame([(k, "hot" if k % 3 else f"c{k % 7}") for k in range(500)], "id long, c string")
    ranks = {}
    for r in ranked_within(df, "c", "id", salts=8).collect():
        ranks.setdefault(r.c, []).append(r._rank)
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


def test_plan_by_size():
    plan = plan_by_size([(1, 1000), (50, 3), (400, 1)], {"train": 0.7, "validation": 0.15, "test": 0.15}, {})
    total = {"train": 0, "validation": 0, "test": 0}
    for size, split, lo, hi in plan:
        total[split] += size * (hi - lo)
    assert sum(total.values()) == 1550 and abs(total["train"] - 1085) <= 2 and abs(total["test"] - 232.5) <= 2
    assert plan_by_size([], {"train": 1.0}, {}) == []


def test_splits_over_batches(spark):
    r = random.Random(3)
    first = [(2 * k, 2 * k + 1) for k in range(400)]
    second = [(r.randrange(800), r.randrange(800, 1200)) for _ in range(150)] + [(0, 2), (2, 4), (4, 6), (6, 8), (None, 3)]
    ws = Workspace(spark, "t")
    store = SplitStore(ws)
    before = {x.uid: x for x in store.ingest(spark.createDataFrame(first, "a long, b long"), "a", "b").collect()}
    share = sum(x.split == "train" for x in before.values()) / len(before)
    assert abs(share - 0.7) < 0.02 and {x.split for x in before.values()} == {"train", "validation", "test"}
    after = {x.uid: x for x in store.ingest(spark.createDataFrame(second, "a long, b long"), "a", "b").collect()}
    edges = first + [e for e in second if e[0] is not None]
    want = union_find(edges)
    assert {u: x.root for u, x in after.items()} == want
    pairs = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "pair_id long, a long, b long")
    home = {}
    for x in split_pairs(pairs, "pair_id", "a", "b", store.records).collect():
        a, b = edges[x.pair_id]
        assert x.group_uid == want[a]
        if x.split != QUARANTINE:
            assert home.setdefault(a, x.split) == x.split and home.setdefault(b, x.split) == x.split
    assert all(x.split in (before[u].split, QUARANTINE) for u, x in after.items() if u in before)
    with pytest.raises(ValueError):
        SplitStore(ws, {"train": 0.5})
    assert SplitStore(ws).ingest(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_store_over_sessions(spark, tmp_path):
    path = f"file://{tmp_path}/splits"
    pairs = lambda rows: spark.createDataFrame(rows, "a long, b long")
    store = SplitStore.open(spark, path)
    store.ingest(pairs([(2 * k, 2 * k + 1) for k in range(40)]), "a", "b")
    assert store.commit() == 1
    kept = {x.uid: x.split for x in store.records.collect()}
    # a session that dies before its commit leaves the store as it was
    SplitStore.open(spark, path).ingest(pairs([(0, 77)]), "a", "b")
    (tmp_path / "splits" / "v00000002").mkdir()
    again = SplitStore.open(spark, path)
    assert {x.uid: x.split for x in again.records.collect()} == kept
    # the same pairs once more change nothing; a merge of two splits is quarantined
    again.ingest(pairs([(2 * k, 2 * k + 1) for k in range(40)]), "a", "b")
    assert {x.uid: x.split for x in again.records.collect()} == kept
    other = next(u for u in range(2, 80, 2) if kept[u] != kept[0])
    again.ingest(pairs([(0, other), (500, 501)]), "a", "b")
    assert again.commit() == 2
    third = {x.uid: x for x in SplitStore.open(spark, path).records.collect()}
    assert third[other].root == 0 and sorted({third[u].split for u in (0, 1, other, other + 1)} - {QUARANTINE}) in ([kept[0]], [kept[other]])
    assert sum(third[u].split == QUARANTINE for u in (0, 1, other, other + 1)) == 2
    assert third[500].split == third[501].split and all(third[u].split == kept[u] for u in kept if u not in (0, 1, other, other + 1))
    with pytest.raises(ValueError):
        SplitStore(Workspace(spark, "t")).commit()


def test_keepers_and_survivors(spark):
    rows = [("g", 1, 5, None, "x"), ("g", 2, 5, "v", "n/a"), ("g", 3, 7, "w", "z"), ("alone", 4, 1, "q", "q"), (None, 5, 0, "q", "q"), ("t", 7, 1, " ", None), ("t", 6, 1, "-", None)]
    df = spark.createDataFrame(rows, "g string, id long, score int, a string, member_count string")
    got = {r.g: (r.id, r[2]) for r in keepers(df.drop("member_count"), "g", "id", [F.col("score")]).collect()}
    assert got == {"g": (1, 3), "t": (6, 2)}
    built = {r.g: r for r in survivors(df, "g", "id", F.struct("score", "id"), ["a"]).collect()}
    assert (built["g"].keeper_uid, built["g"].a, built["t"].a) == (1, "v", None)
    assert keepers(df.limit(0), "g", "id", [F.col("score")]).count() == 0

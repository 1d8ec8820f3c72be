import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.leaks import PassageIndex, leaked_passages, near_passages
from ledgerloom.llm.packing import pack, plan, token_counts
from ledgerloom.llm.words import words


def test_words():
    assert words("Ｈｅｌｌｏ, wor­ld_foo STRASSE straße ﬁx") == ["hello", "world", "foo", "strasse", "strasse", "fix"]
    assert words(None) == [] == words("") == words("... _ !")


def longest_run(doc, item, shift):
    best = run = 0
    for k, w in enumerate(item):
        p = k + shift
        run = run + 1 if 0 <= p < len(doc) and doc[p] == w else 0
        best = max(best, run)
    return best


def brute(docs, items, n):
    out = {}
    for d, t in docs:
        for i, x in items:
            dw, iw = words(t), words(x)
            best = max([0, *(longest_run(dw, iw, s) for s in range(-len(iw), len(dw)))])
            if d is not None and best >= n:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_leaks_against_every_shift(spark):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.randrange(8, 30))) for k in range(12)] + [(50, "same " * 14), (51, None), (52, "absent " * 12 + "nowhere"), (53, "short item")]
    docs = []
    for k in range(60):
        t = text(r.randrange(0, 40))
        if k % 2:
            w = words(r.choice(items[:12])[1])
            a = r.randrange(max(1, len(w) - 10))
            t += ", " + "; ".join(w[a : a + r.randrange(9, 24)]).upper() + ". " + text(3)
        docs.append((k, t))
    docs += [(100, "x same " * 3 + "same " * 13), (101, None), (102, ""), (None, items[0][1]), (103, items[0][1]), (103, items[0][1] * 2)]
    want = brute(docs, items, 12)
    assert len(want) > 10
    dd = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    ii = spark.createDataFrame(items, "item_id long, item_text string")
    got = {(x.doc_id, x.item_id): x.n_words for x in leaked_passages(dd, "doc_id", "text", ii, "item_id", "item_text").collect()}
    assert got == want
    assert leaked_passages(dd.limit(0), "doc_id", "text", ii, "item_id", "item_text").count() == 0
    assert leaked_passages(dd, "doc_id", "text", ii.limit(0), "item_id", "item_text").count() == 0
    near = {(x.doc_id, x.item_id) for x in near_passages(dd, "doc_id", "text", ii, "item_id", "item_text").collect()}
    assert (103, 0) in near


def test_index_outlives_queries_and_grows(spark, tmp_path, monkeypatch):
    from ledgerloom.llm import leaks

    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(20)) for k in range(6)]
    docs = [(k, text(10) + " " + " ".join(words(items[k % 6][1])[3 : 3 + 10 + k % 5]) + " " + text(k % 30)) for k in range(80)]
    ii = spark.createDataFrame(items, "item_id long, item_text string")
    path = f"file://{tmp_path}/index"
    index = PassageIndex.build(spark.createDataFrame(docs[:50], "doc_id long, text string"), "doc_id", "text", path)
    assert {(x.doc_id, x.item_id): x.n_words for x in leaked_passages(index, "", "", ii, "item_id", "item_text").collect()} == brute(docs[:50], items, 12)
    PassageIndex.open(spark, path).append(spark.createDataFrame(docs[50:], "doc_id long, text string"), "doc_id", "text")
    monkeypatch.setattr(leaks, "MAX_BLOCK_WORDS", 1)
    again = PassageIndex.open(spark, path)
    assert {(x.doc_id, x.item_id): x.n_words for x in leaked_passages(again, "", "", ii, "item_id", "item_text").collect()} == brute(docs, items, 12)
    t = again.table().where("term is not null").collect()
    assert sum(x.n for x in t) == sum(len(words(x)) for _, x in docs)
    with pytest.raises(Exception):
        PassageIndex.build(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", path)


def test_near_words_wherever_they_stand(spark):
    item = "alpha beta gamma delta epsilon zeta"
    gap = lambda k: " ".join(["filler"] * k)
    # four rare words over 20 positions, from every start; over 25 they are too far apart
    docs = [(k, f"{gap(k)} alpha {gap(6)} beta {gap(6)} gamma {gap(4)} delta") for k in range(24)] + [(100 + k, f"{gap(k)} alpha {gap(8)} beta {gap(8)} gamma {gap(5)} delta") for k in range(24)]
    docs += [(200, "alpha beta"), (200, "gamma delta"), (201, "epsilon zeta alpha")]
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame([(1, item)], "item_id long, item_text string")
    got = {(x.doc_id, x.item_id, x.n_terms) for x in near_passages(dd, "doc_id", "text", ii, "item_id", "item_text").collect()}
    assert got == {(k, 1, 4) for k in range(24)}


def test_near_finds_parts_of_items(spark):
    r = random.Random(9)
    rare, usual = [f"rare{k}" for k in range(8)], [f"usual{k}" for k in range(30)]
    items = [(1, " ".join(rare + usual)), (2, "same " * 14), (3, "on and on " * 5)]
    docs = [(k, " ".join(usual[k % 15 : k % 15 + 12])) for k in range(20)]  # a part without the item's rarest words
    docs += [(30, " ".join(usual[3:8] + ["other"] + usual[9:14])), (31, "same " * 12), (32, "on and on " * 4), (33, "same on and"), (34, " ".join(rare))]
    docs += [(40 + k, " ".join(r.sample(usual, 3))) for k in range(10)]
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    near = {(x.doc_id, x.item_id) for x in near_passages(dd, "doc_id", "text", ii, "item_id", "item_text").collect()}
    exact = {(x.doc_id, x.item_id) for x in leaked_passages(dd, "doc_id", "text", ii, "item_id", "item_text").collect()}
    assert exact == {(k, 1) for k in range(20)} | {(31, 2), (32, 3)}
    assert near == exact | {(30, 1), (34, 1)}


def check_plan(sizes, capacity):
    bins, seen = {}, {}
    for size, lo, hi, first, each, at in plan(sizes, capacity):
        seen.setdefault(size, []).append((lo, hi))
        for k in range(hi - lo):
            bins.setdefault(first + k // each, []).append((at + k % each, size))
    assert {s: sum(h - lo for lo, h in v) for s, v in seen.items()} == {s: n for s, n in sizes.items() if n}
    for b in bins.values():
        assert sum(s for _, s in b) <= capacity and sorted(p for p, _ in b) == list(range(len(b)))
        assert sum(3 * s > capacity for _, s in b) <= 2
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 40), max_size=20), st.integers(50, 60))
def test_plan(sizes, capacity):
    n = check_plan(sizes, capacity)
    total = sum(s * k for s, k in sizes.items())
    assert n <= 2 * total / capacity + 1


def test_pack(spark):
    r = random.Random(8)
    rows = [(k, r.choice([0, 1, 5, 33, 34, 50, 99, 100, 101, 250, 300])) for k in range(600)] + [(1000 + k, 34) for k in range(400)] + [(2000, None)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, n long, place string")
    got = pack(df, "doc_id", "n", 100).collect()
    whole, bins = {}, {}
    for x in got:
        whole[x.doc_id] = whole.get(x.doc_id, 0) + x.n_tokens
        if x.container is not None:
            bins.setdefault(x.container, []).append(x)
    assert whole == {k: n or 0 for k, n in rows}
    assert sorted(bins) == list(range(len(bins)))
    for b in bins.values():
        assert sum(x.n_tokens for x in b) <= 100 and sorted(x.place for x in b) == list(range(len(b)))
    assert len(got) == sum(max(1, -(-(n or 0) // 100)) for _, n in rows)
    assert pack(df.limit(0), "doc_id", "n", 100).count() == 0


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a " * 50_000)], "doc_id long, text string")
    got = {x.doc_id: x.n_tokens for x in token_counts(df, "text").collect()}
    assert got[1] == 2 and got[2] == 0 == got[3] and got[4] > 40_000

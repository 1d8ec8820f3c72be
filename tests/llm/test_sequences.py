import random

import pytest

from ledgerloom.llm.runs_of_events import collapse_runs


def brute(rows, gap):
    seqs = {}
    for who, at, i, k in rows:
        if None not in (who, at, i, k):
            seqs.setdefault(who, []).append((at, i, k))
    out = set()
    for s in seqs.values():
        s.sort()
        cur = [s[0]]
        for x in s[1:] + [(None, None, None)]:
            if x[0] is not None and x[2] == cur[-1][2] and x[0] - cur[-1][0] <= gap:
                cur.append(x)
            else:
                if len(cur) > 1:
                    out.add((cur[0][1], len(cur), cur[0][0], cur[-1][0]))
                cur = [x]
    return out


@pytest.mark.parametrize("seed, gap", [(1, 10), (2, 0), (3, 300)])
def test_against_the_sequential_rule(spark, seed, gap):
    r = random.Random(seed)
    rows = [(r.choice("ab"), r.randrange(-2000, 2000), i, r.choice("xy")) for i in range(900)]
    rows += [("hot", 3 * k, 10_000 + k, "z") for k in range(700)]  # one run longer than any block
    rows += [("tie", 5, 20_000 + k, "z") for k in range(40)] + [(None, 1, 30_000, "x"), ("a", None, 30_001, "x"), ("a", 3, 30_002, None)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "who string, at long, id long, k string, ptr string")
    got = {tuple(x) for x in collapse_runs(df, ["who"], "at", "id", ["k"], gap).collect()}
    assert got == brute(rows, gap)


def test_empty(spark):
    df = spark.createDataFrame([], "who string, at long, id long, k string")
    assert collapse_runs(df, ["who"], "at", "id", ["k"], 10).count() == 0


def test_a_requester_with_a_third_of_all_events_and_all_times_tied(spark):
    rows = [("hot", 7, k, "z") for k in range(3000)] + [(f"u{k % 600}", 1000 * k, 10_000 + k, "z" if k % 3 else "y") for k in range(6000)]
    df = spark.createDataFrame(rows, "who string, at long, id long, k string")
    got = {tuple(x) for x in collapse_runs(df, ["who"], "at", "id", ["k"], 600_000).collect()}
    assert got == brute(rows, 600_000) and (0, 3000, 7, 7) in got


def test_every_matching_event_is_linked(spark, monkeypatch):
    from ledgerloom.llm import runs_of_events as op

    monkeypatch.setattr(op, "BLOCK_EVENTS", 50)  # many blocks: links across their borders
    r = random.Random(4)
    rows = sorted((r.choice("ab"), r.randrange(4000), i, r.choice("xy")) for i in range(800))
    df = spark.createDataFrame(rows, "q0 string, at long, id long, k0 string")
    ws = op.Workspace(spark, "test")
    got = {(x["id"], x["ptr"]) for x in op.links(ws, ws.write(df, "events"), ["q0"], ["k0"], 20).collect()}
    assert got == {(b[2], a[2]) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and a[3] == b[3] and b[1] - a[1] <= 20}

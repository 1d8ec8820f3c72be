"""All pairs of similar sets, within a table or between two: a size-aware overlap join (p2).

Records with equal sets are one class (by 128 bits of hash) and compared once. A value is replaced by its number, one
to one, so sets are compared by their values. Two sets of sizes s and p are similar (Jaccard at least t) exactly if
they share c = ceil(t (s + p) / (1 + t)) values. Among small sets every c-sized subset is enumerated, for each
size p that can match, and equal subsets meet in an equi-join. A pair with a large set is found by scanning inverted
lists: each set is listed under its rarest values only (by the pigeonhole principle similar sets share one of these).
Lists hold class, size and place only; sets are fetched once for the pairs that pass the size and place tests, and
compared. Which sets are small is chosen from the data: where enumerating is cheaper than scanning.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.lookup import looked_up
from ledgerloom.storage import Workspace

#: The largest sets whose subsets may be enumerated: a set of 12 has at most 924 subsets of one size.
MOST_SMALL = 12
#: Members of one class that are expanded in one task, about.
EXPAND = 2_000
LEFT, RIGHT = 1, 2


def needed(s: int, p: int, t_num: int, t_den: int) -> int:
    """Least overlap of similar sets of sizes s and p, in whole numbers: no rounding error at the threshold."""
    return -((-t_num * (s + p)) // (t_num + t_den))


@lru_cache(maxsize=512)
def _combinations(s: int, c: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(s), c)), dtype=np.int64).reshape(-1, c)


def subset_keys(values: np.ndarray, small: int, t_num: int, t_den: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(smaller size, larger size, keys n x subsets) for sets of one size; ``values`` (n x s) are 64-bit hashes.

    A key is the wrapped sum of the hashes of a subset's values: equal subsets have equal keys.
    """
    s = values.shape[1]
    for p in range(1, small + 1):
        if p * t_den < s * t_num or s * t_den < p * t_num:
            continue
        c = needed(s, p, t_num, t_den)
        if c > min(s, p):
            continue
        yield min(s, p), max(s, p), values[:, _combinations(s, c)].sum(axis=2, dtype=np.uint64)


_KEYS = T.StructType([T.StructField("cls", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("k", T.LongType())])


def _small_keys(small: int, t_num: int, t_den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, part in b.groupby("n"):
                values = np.stack([np.asarray(x, dtype=np.int64).view(np.uint64) for x in part["h"]])
                for lo, hi, keys in subset_keys(values, small, t_num, t_den):
                    m = keys.shape[1]
                    yield pd.DataFrame({"cls": np.repeat(part["cls"].to_numpy(), m), "lo": np.int32(lo), "hi": np.int32(hi), "k": keys.reshape(-1).view(np.int64)})

    return run


def _similar(shared: Column, na: Column, nb: Column, t_num: int, t_den: int) -> Column:
    return shared * t_den >= (na + nb - shared) * t_num


def subset_count(s: int, small: int, t_num: int, t_den: int) -> int:
    """Keys that ``subset_keys`` gives for a set of s values."""
    out = 0
    for p in range(1, small + 1):
        if p * t_den >= s * t_num and s * t_den >= p * t_num and (c := needed(s, p, t_num, t_den)) <= min(s, p):
            out += math.comb(s, c)
    return out


def choose_small(histogram: dict[int, tuple[int, int]], t_num: int, t_den: int, most: int = MOST_SMALL) -> int:
    """The boundary with the least work. ``histogram``: {size: (sets, list entries that their prefixes meet)}."""

    def work(small: int) -> int:
        keys = sum(n * subset_count(s, small, t_num, t_den) for s, (n, _) in histogram.items() if s <= small)
        return keys + sum(met for s, (_, met) in histogram.items() if s > small)

    return min(range(most + 1), key=lambda b: (work(b), b))


def similar_classes(ws: Workspace, sets: DataFrame, t_num: int, t_den: int, small: int | None = None, between: bool = False) -> DataFrame:
    """Similar pairs (a, b, shared, na, nb) of distinct sets, a < b. ``sets``: (cls long, items array, sides int).

    ``between``: only pairs with a left member in one class and a right member in the other.
    """
    items = sets.select("cls", F.explode("items").alias("v"))
    numbered = ws.write(items.groupBy("v").agg(F.count("*").alias("f")).withColumn("h", F.monotonically_increasing_id()), "values")
    ordered = items.join(numbered, "v").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("o"))
    prefix_length = (F.col("n") - F.ceil(F.col("n") * t_num / t_den) + 1).cast("int")
    lists_met = F.aggregate(F.slice("o", F.lit(1), prefix_length), F.lit(0).cast("long"), lambda acc, x: acc + x["f"])
    sized = ws.write(ordered.withColumn("n", F.size("o")).withColumn("met", lists_met).select("cls", F.transform("o", lambda x: x["h"]).alias("h"), "n", "met").join(sets.select("cls", "sides"), "cls"), "sets")
    if small is None:
        # one entry per set size
        small = choose_small({r["n"]: (r["c"], r["m"]) for r in sized.groupBy("n").agg(F.count("*").alias("c"), F.sum("met").alias("m")).collect()}, t_num, t_den)
    sides_fit = (F.col("s1").bitwiseOR(F.col("s2")) == LEFT | RIGHT) if between else F.lit(True)

    tiny = sized.where(F.col("n") <= small).select("cls", "n", F.transform("h", lambda x: F.xxhash64(x)).alias("h"))
    keys = ws.write(tiny.mapInPandas(_small_keys(small, t_num, t_den), _KEYS), "subsets")
    if between:
        keys = keys.join(sized.select("cls", "sides"), "cls")
    else:
        keys = keys.withColumn("sides", F.lit(LEFT | RIGHT))
    # sets that share such a subset are similar by definition, so this join gives no idle candidates
    x = keys.select("lo", "hi", "k", F.col("cls").alias("a"), F.col("sides").alias("s1"))
    y = keys.select("lo", "hi", "k", F.col("cls").alias("b"), F.col("sides").alias("s2"))
    near = x.join(y, ["lo", "hi", "k"]).where("a < b").where(sides_fit).select("a", "b")

    # inverted lists: the prefix leaves out so many frequent values that similar sets must share one of the rest
    reach = F.col("n") * t_den > small * t_num  # smaller sets match no large one
    lists = sized.where(reach).select("cls", "n", "sides", F.posexplode(F.slice("h", F.lit(1), prefix_length)).alias("pos", "v"))
    big = lists.where(F.col("n") > small).select("v", F.col("cls").alias("c1"), F.col("n").alias("n1"), F.col("pos").alias("p1"), F.col("sides").alias("s1"))
    other = lists.select("v", F.col("cls").alias("c2"), F.col("n").alias("n2"), F.col("pos").alias("p2"), F.col("sides").alias("s2"))
    sizes_fit = (F.col("n2") * t_den >= F.col("n1") * t_num) & (F.col("n2") <= F.col("n1"))
    each_once = (F.col("n2") < F.col("n1")) | (F.col("c1") < F.col("c2"))
    # values left after this position bound the overlap: most candidates of frequent values end here
    most = 1 + F.least(F.col("n1") - F.col("p1") - 1, F.col("n2") - F.col("p2") - 1) + F.least("p1", "p2")
    hopeful = _similar(most, F.col("n1"), F.col("n2"), t_num, t_den)
    met = big.join(other, "v").where(sizes_fit & each_once & hopeful & sides_fit).select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b"))
    candidates = near.unionByName(met).distinct()
    sa = sized.select(F.col("cls").alias("a"), F.col("h").alias("ha"), F.col("n").alias("na"))
    sb = sized.select(F.col("cls").alias("b"), F.col("h").alias("hb"), F.col("n").alias("nb"))
    compared = candidates.join(sa, "a").join(sb, "b").select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("shared"), "na", "nb")
    return compared.where(_similar(F.col("shared"), F.col("na"), F.col("nb"), t_num, t_den))


def _sets(records: DataFrame, uid: str, items: str, side: int) -> DataFrame:
    values = F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))
    return records.where(F.col(uid).isNotNull()).select(F.col(uid).cast("long").alias("uid"), values.alias("items"), F.lit(side).alias("side")).where(F.size("items") > 0).distinct()


def _classes(ws: Workspace, sets: DataFrame, threshold: tuple[int, int], small: int | None, between: bool) -> tuple[DataFrame, DataFrame]:
    keyed = ws.write(sets.withColumns({"h1": F.xxhash64("items"), "h2": F.xxhash64(F.lit(7), "items")}), "records")
    classes = keyed.groupBy("h1", "h2").agg(F.min(F.struct("uid", "side")).alias("first"), F.bit_or("side").alias("sides"))
    named = ws.write(classes.withColumn("cls", F.monotonically_increasing_id() if between else F.col("first.uid")), "classes")
    members = ws.write(keyed.select("uid", "side", "h1", "h2").join(named.select("h1", "h2", "cls", "sides"), ["h1", "h2"]).select("uid", "side", "cls", "sides"), "members")
    # the class' first record brings its set
    heads = named.select("h1", "h2", "cls", "sides", F.col("first.uid").alias("uid"), F.col("first.side").alias("side"))
    distinct_sets = keyed.join(heads, ["uid", "side", "h1", "h2"]).select("cls", "items", "sides")
    pairs = similar_classes(ws, distinct_sets, *threshold, small, between)
    return members, ws.write(pairs.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("similarity")), "pairs")


def similar_sets(records: DataFrame, uid: str, items: str, threshold: tuple[int, int] = (3, 4), small: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (uid, cls) name the class of equal sets of each record; pairs join classes.

    ``threshold`` is a fraction of whole numbers. Empty and null sets match nothing and are in no class;
    repeated values count once, repeated rows of a uid once. Class ids are the smallest uid of the class; a uid
    names one record.
    ``pairs``: (a, b, similarity), a < b, classes of different sets. Members of one class are equal.
    """
    ws = Workspace(records.sparkSession, "set-similarity")
    members, pairs = _classes(ws, _sets(records, uid, items, LEFT), threshold, small, False)
    return members.select("uid", "cls"), pairs


def similar_between(left: DataFrame, right: DataFrame, uid: str, items: str, threshold: tuple[int, int] = (3, 4), small: int | None = None) -> DataFrame:
    """(a, b, similarity) of every record a of ``left`` and b of ``right`` whose sets are similar, equal sets included.

    Both tables have ``uid`` and ``items``; a uid may stand in both, meaning different records. Otherwise as ``similar_sets``.
    """
    ws = Workspace(left.sparkSession, "set-similarity")
    both = _sets(left, uid, items, LEFT).unionByName(_sets(right, uid, items, RIGHT))
    members, pairs = _classes(ws, both, threshold, small, True)
    lm, rm = members.where(F.col("side") == LEFT), members.where(F.col("side") == RIGHT)
    ways = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "similarity").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "similarity"))
    equal = members.where(F.col("sides") == LEFT | RIGHT).select(F.col("cls").alias("x"), F.col("cls").alias("y"), F.lit(1.0).alias("similarity")).distinct()
    return _expanded(ways.unionByName(equal), lm, rm)


def _salted(members: DataFrame, cls: str, uid: str) -> tuple[DataFrame, DataFrame]:
    """Members in parts of about ``EXPAND``, and (class, part) of all parts: no class is expanded in one task."""
    parts = members.groupBy("cls").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / EXPAND).cast("int"))
    salted = looked_up(members.select("uid", "cls"), parts, "cls", "uid", "n").select(F.col("cls").alias(cls), F.col("uid").alias(uid), F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias(f"part_{cls}"))
    return salted, parts.select(F.col("cls").alias(cls), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{cls}"))


def _expanded(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, similarity) of the members of each pair (x, y) of classes."""
    mx, px = _salted(left, "x", "a")
    my, py = _salted(right, "y", "b")
    cells = pairs.join(px, "x").join(py, "y")
    return cells.join(mx, ["x", "part_x"]).join(my, ["y", "part_y"]).select("a", "b", "similarity")


def record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of records, a < b: links of different classes and of equal sets, all of them."""
    several = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1")
    same = several.select(F.col("cls").alias("x"), F.col("cls").alias("y"), F.lit(1.0).alias("similarity"))
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "similarity").unionByName(same)
    out = _expanded(both, members, members).where((F.col("similarity") < 1) | (F.col("a") < F.col("b")))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")

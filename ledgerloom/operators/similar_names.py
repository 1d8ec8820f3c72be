"""All pairs of similar names: a join on the rarest letter pairs, without blocks that are left out.

A ratio of r needs a common subsequence of C = ceil(r (l + m) / 2) letters in names of l and m letters. At most
l + m - 2 C letters are then unmatched; each breaks at most two letter pairs of its own name and one of the
other, so the names share at least 3 C - 1 - (l + m) letter pairs, and meet on one of their rarest. Names too
short for that bound to say anything meet on an empty key. Only candidates are left out, never a result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import name_ratio, strong_name_match


@lru_cache(maxsize=65536)
def shared_pairs(n: int, least: float) -> tuple[int, bool]:
    """(letter pairs that a name of n letters shares at least with a similar one, if a bound holds; else n; whether for some length none does)."""
    r = least / 100
    if r <= 2 / 3:
        return n, True
    best, short = n, False
    for m in range(max(1, math.ceil(n * r / (2 - r) - 1e-9)), math.floor(n * (2 - r) / r + 1e-9) + 1):
        bound = 3 * math.ceil(r * (n + m) / 2 - 1e-9) - 1 - (n + m)
        if bound >= 1:
            best = min(best, bound)
        else:
            short = True
    return best, short


def letter_pairs(text: str) -> list[str]:
    """Letter pairs of the name with its words sorted, numbered where they repeat."""
    x = " ".join(sorted(text.split()))
    seen: Counter[str] = Counter()
    out = []
    for k in range(len(x) - 1):
        g = x[k : k + 2]
        seen[g] += 1
        out.append(f"{g}{seen[g]}")
    return out


def similar_names(names: DataFrame, name: str, least: float = 90.0) -> DataFrame:
    """(na, nb) of different names that match strongly (see ``strong_name_match``), na < nb; null and empty names match nothing."""
    distinct = names.select(F.col(name).alias("n")).where("n <> ''").distinct()

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n in b["n"].tolist():
                size = len(" ".join(sorted(n.split())))
                out.append((n, size, *shared_pairs(size, least), letter_pairs(n)))
            yield pd.DataFrame(out, columns=["n", "size", "shared", "short", "grams"])

    each = distinct.mapInPandas(grams, "n string, size int, shared int, short boolean, grams array<string>")
    listed = each.select("n", F.explode("grams").alias("g"))
    frequency = listed.groupBy("g").agg(F.count("*").alias("f"))
    ordered = listed.join(frequency, "g").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("o"))
    keys = each.select("n", "size", "shared", "short").join(ordered, "n", "left")
    rarest = F.transform(F.slice("o", F.lit(1), F.greatest(F.lit(0), F.size("o") - F.col("shared") + 1)), lambda x: x["g"])
    both = F.concat(F.coalesce(rarest, F.array().cast("array<string>")), F.when(F.col("short"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    digits = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("n", F.lit(r"(\d+)")))), ",")
    x = keys.select("n", "size", digits.alias("d"), F.explode(both).alias("k"))
    a, b = x.withColumnsRenamed({"n": "na", "size": "la"}), x.withColumnsRenamed({"n": "nb", "size": "lb"})
    fits = F.least("la", "lb") * 200 >= F.lit(least - 1e-6) * (F.col("la") + F.col("lb"))
    met = a.join(b, ["d", "k"]).where("na < nb").where(fits).select("na", "nb").distinct()
    return met.where(strong_name_match(F.col("na"), F.col("nb"), name_ratio("na", "nb"), least))

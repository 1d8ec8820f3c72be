"""Texts into containers of fixed token capacity (p8).

Only the histogram of token counts is planned on the driver: it has at most ``capacity`` entries whatever
the number of texts. Sizes above a third of the capacity go at most two to a container, the largest
with the largest that still fits; smaller sizes then fill the smallest gap that holds them. Texts longer than
the capacity are cut into full containers and one rest. Every text then finds its container by its rank
within its size, so the plan is global although no task sees all texts.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.ranks import ranked_within
from ledgerloom.storage import Workspace, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, text: str, path: str = TOKENIZER, out: str = "n_tokens") -> DataFrame:
    """``docs`` plus the number of tokens of its text; null texts have none.

    The tokenizer file is read once per Python worker; its path must exist on every executor.
    """

    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        enc = _encoding(path)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s.tolist()], dtype="int64")

    return spread(docs).withColumn(out, count(F.col(text)))


def plan(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, end rank, first container, items of the size per container, first place) per range.

    ``sizes`` {size: items} with 1 <= size <= capacity. Items ranked in [first, end) of a size go, so many
    to a container, into consecutive containers.
    """
    left = {s: n for s, n in sizes.items() if n > 0}
    used: dict[int, int] = {}
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int, int]]] = {}  # gap -> (first container, end, next place)
    n_bins = 0

    def place(size: int, bins: int, first: int, each: int, at: int) -> None:
        start = used.get(size, 0)
        out.append((size, start, start + bins * each, first, each, at))
        used[size] = start + bins * each
        left[size] -= bins * each

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        n = left[s]
        k = bisect.bisect_right(large, capacity - s) - 1
        if k < 0:
            place(s, n, n_bins, 1, 0)
            gaps.setdefault(capacity - s, []).append((n_bins, n_bins + n, 1))
            n_bins += n
        else:
            p = large[k]
            m = n // 2 if p == s else min(n, left[p])
            if p == s and m == 0:
                if k == 0:
                    place(s, 1, n_bins, 1, 0)
                    gaps.setdefault(capacity - s, []).append((n_bins, n_bins + 1, 1))
                    n_bins += 1
                    large.pop()
                    continue
                p, m = large[k - 1], 1
            if p == s:
                place(s, m, n_bins, 2, 0)
            else:
                place(s, m, n_bins, 1, 0)
                place(p, m, n_bins, 1, 1)
                if not left[p]:
                    large.remove(p)
            gaps.setdefault(capacity - s - p, []).append((n_bins, n_bins + m, 2))
            n_bins += m
        if not left[s]:
            large.remove(s)
    open_gaps = sorted(g for g in gaps if g > 0)
    for s in sorted((x for x in left if left[x]), reverse=True):
        while left[s]:
            i = bisect.bisect_left(open_gaps, s)
            if i == len(open_gaps):
                each = capacity // s
                full = left[s] // each
                if full:
                    place(s, full, n_bins, each, 0)
                    rest, bins, per = capacity - each * s, full, each
                else:
                    per = left[s]
                    place(s, 1, n_bins, per, 0)
                    rest, bins = capacity - per * s, 1
                span = (n_bins, n_bins + bins, per)
                n_bins += bins
            else:
                g = open_gaps[i]
                lo, hi, at = gaps[g].pop()
                if not gaps[g]:
                    open_gaps.pop(i)
                take = min(hi - lo, left[s])
                place(s, take, lo, 1, at)
                if lo + take < hi:
                    if not gaps[g]:
                        bisect.insort(open_gaps, g)
                    gaps[g].append((lo + take, hi, at))
                rest, span = g - s, (lo, lo + take, at + 1)
            if rest > 0:
                if not gaps.get(rest):
                    gaps[rest] = []
                    bisect.insort(open_gaps, rest)
                gaps[rest].append(span)
    return out


_PLACED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("container", T.LongType()), T.StructField("place", T.IntegerType())])


def pack(sized: DataFrame, doc_id: str, n_tokens: str, capacity: int) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, container, place) of every text; ``doc_id`` is unique.

    A text of more than ``capacity`` tokens has pieces 0, 1, ... of which all but the last fill a container;
    any other is piece 0, whole. A piece holds the tokens from ``first_token`` (counted from 0) on. Texts without tokens have one piece of 0 tokens and no container. Containers
    count from 0 without gaps; the full containers of cut texts come after those of the plan.
    """
    spark = sized.sparkSession
    ws = Workspace(spark, "packing")
    base = sized.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(n_tokens), F.lit(0)).cast("long").alias("n"))
    parts = ws.write(base.select("doc_id", "n", F.pmod("n", F.lit(capacity)).cast("int").alias("size"), ((F.col("n") - F.pmod("n", F.lit(capacity))) / capacity).cast("int").alias("cuts")), "sizes")
    histogram = {r["size"]: r["c"] for r in parts.where("size > 0").groupBy("size").agg(F.count("*").alias("c")).collect()}
    steps = sorted(plan(histogram, capacity))
    table = spark.sparkContext.broadcast(np.array(steps, dtype=np.int64).reshape(-1, 6))
    n_bins = max([0, *(first + (end - start) // each for _, start, end, first, each, _ in steps)])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table.value
        key = (t[:, 0] << 44) + t[:, 1]
        for b in batches:
            r = np.searchsorted(key, (b["size"].to_numpy(np.int64) << 44) + b["_rank"].to_numpy(np.int64), side="right") - 1
            at = b["_rank"].to_numpy(np.int64) - t[r, 1]
            yield pd.DataFrame({"doc_id": b["doc_id"], "piece": b["cuts"].astype("int32"), "first_token": b["cuts"].astype("int64") * capacity, "n_tokens": b["size"].astype("int32"), "container": t[r, 3] + at // t[r, 4], "place": (t[r, 5] + at % t[r, 4]).astype("int32")})

    rest = ranked_within(parts.where("size > 0"), "size", "doc_id").select("doc_id", "size", "cuts", "_rank").mapInPandas(assign, _PLACED)
    # full pieces: the texts that are cut are numbered in parts of a hash, then given as many containers as pieces
    cut = parts.where("cuts > 0").withColumn("one", F.pmod(F.xxhash64("doc_id"), F.lit(1024)))
    total = cut.groupBy("one").agg(F.sum("cuts").alias("c"))
    before = total.select("one", (F.sum("c").over(Window.orderBy("one")) - F.col("c")).alias("b"))
    inner = cut.withColumn("i", F.sum("cuts").over(Window.partitionBy("one").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("cuts")).join(before, "one")
    whole = inner.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("piece"), (F.lit(n_bins) + F.col("b") + F.col("i")).alias("s")).select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece").cast("long") * capacity).alias("first_token"), F.lit(capacity).alias("n_tokens"), (F.col("s") + F.col("piece")).alias("container"), F.lit(0).alias("place"))
    none = parts.where("n = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), F.lit(0).alias("n_tokens"), F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("place"))
    return rest.unionByName(whole).unionByName(none)

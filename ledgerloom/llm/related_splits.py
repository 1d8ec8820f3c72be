"""Train, validation and test splits that never part related records (p1).

A persisted table holds the component and split of every record. A batch of pairs is mapped to the roots
of the components it touches; pointer jumping merges roots. Components that have a split keep it; new ones
fill the splits' deficits, largest first. If a merge joins components of different splits, the split with
most records wins and the other records are quarantined: they were published elsewhere and may not move, so
pairs that touch them belong to no split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.graph import canonical_edges, contract, relabel
from ledgerloom.llm.ranks import ranked_within
from ledgerloom.operators.lookup import looked_up
from ledgerloom.storage import Workspace, tables_below

PROPORTIONS = {"train": 0.70, "validation": 0.15, "test": 0.15}
QUARANTINE = "quarantine"


def plan_by_size(sizes: list[tuple[int, int]], proportions: dict[str, float], have: dict[str, int]) -> list[tuple[int, str, int, int]]:
    """(size, split, first rank, end rank): components of each size dealt to the splits, largest first.

    ``sizes`` is a histogram (size, components): its length is at most the square root of twice the
    records. A class is dealt at once.
    """
    total = sum(s * n for s, n in sizes) + sum(have.values())
    lack = {k: p * total - have.get(k, 0) for k, p in proportions.items()}
    out: list[tuple[int, str, int, int]] = []
    for size, n in sorted(sizes, reverse=True):
        # pour the class into the deficits down to one common level, then deal the few left over singly
        order = sorted(lack, key=lambda k: (-lack[k], k))
        level, need = -float("inf"), n * size
        for i in range(1, len(order) + 1):
            level = (sum(lack[k] for k in order[:i]) - need) / i
            if i == len(order) or level >= lack[order[i]]:
                break
        shares = {k: min(n, max(0, int((lack[k] - level) // size))) for k in order}
        for k in shares:
            lack[k] -= shares[k] * size
        for _ in range(n - sum(shares.values())):
            k = min(order, key=lambda x: (-lack[x], x))
            shares[k] += 1
            lack[k] -= size
        at = 0
        for k in sorted(shares):
            if shares[k]:
                out.append((size, k, at, at + shares[k]))
            at += shares[k]
    return out


_RECORDS = "uid long, root long, split string"


class SplitStore:
    """The persisted component table: (uid, root, split). ``ingest`` takes one batch of related pairs, ``commit`` keeps the result.

    A store lives below ``path`` in numbered versions, each a whole table. A version counts once its write has
    succeeded (the marker is written last, in one step), so a session that dies leaves the last version as it
    was; an unfinished version is written over by the next commit. ``open`` reads the newest version. Without a
    path the store ends with the session.
    """

    def __init__(self, ws: Workspace, proportions: dict[str, float] | None = None, records: DataFrame | None = None, path: str | None = None):
        self.ws, self.spark, self.path = ws, ws.spark, path
        self.proportions = proportions or PROPORTIONS
        if abs(sum(self.proportions.values()) - 1) > 1e-9 or min(self.proportions.values()) < 0:
            raise ValueError("proportions must be positive and sum to 1")
        self.records = records if records is not None else ws.write(self.spark.createDataFrame([], _RECORDS), "records")

    @classmethod
    def open(cls, spark: SparkSession, path: str, proportions: dict[str, float] | None = None) -> SplitStore:
        """The store at ``path``, empty if there is none."""
        done = [n for n in tables_below(spark, path) if n.startswith("v")]
        records = spark.read.schema(_RECORDS).parquet(f"{path}/{max(done)}") if done else None
        return cls(Workspace(spark, "splits"), proportions, records, path)

    def commit(self) -> int:
        """Keep the records as a new version; returns its number."""
        if self.path is None:
            raise ValueError("a store without a path can't be kept")
        done = [n for n in tables_below(self.spark, self.path) if n.startswith("v")]
        version = 1 + max([0, *(int(n[1:]) for n in done)])
        self.records.write.mode("overwrite").parquet(f"{self.path}/v{version:08d}")
        self.records = self.spark.read.schema(_RECORDS).parquet(f"{self.path}/v{version:08d}")
        return version

    def ingest(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """Add the pairs' links; return the new record table. Pairs with a missing end link nothing."""
        ws = self.ws
        x, y = F.col(a).cast("long"), F.col(b).cast("long")
        present = pairs.where(x.isNotNull() & y.isNotNull())
        uids = present.select(F.explode(F.array(x, y)).alias("uid")).distinct()
        old = self.records.select(F.col("uid").alias("id"), F.col("root").alias("ptr"))
        edges = ws.write(relabel(canonical_edges(present, a, b), old), "root-edges")
        merged = ws.write(contract(ws, edges, full_jumps=True), "merges")
        known = self.records.unionByName(uids.join(self.records, "uid", "left_anti").select("uid", F.col("uid").alias("root"), F.lit(None).cast("string").alias("split")))
        held_by = self.records.groupBy("root").agg(F.count("*").alias("n"))
        top = merged.select(F.col("id").alias("root"), F.col("ptr").alias("top")).join(held_by, "root", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        moved = ws.write(looked_up(known, top, "root", "uid", "n").select("uid", F.coalesce("top", "root").alias("root"), "split"), "moved")
        # one row per component: how many records each split holds there (quarantined records don't vote)
        votes = moved.groupBy("root").agg(F.count("*").alias("size"), *[F.count_if(F.col("split") == k).alias(f"n_{k}") for k in sorted(self.proportions)])
        held = F.array_max(F.array(*[F.struct(F.col(f"n_{k}").alias("n"), F.lit(k).alias("k")) for k in sorted(self.proportions)]))
        comps = ws.write(votes.select("root", "size", held.alias("h")).select("root", "size", F.when(F.col("h.n") > 0, F.col("h.k")).alias("held")), "components")
        have = {r["held"]: r["n"] for r in comps.where("held is not null").groupBy("held").agg(F.sum("size").alias("n")).collect()}
        fresh = comps.where("held is null").select("root", "size")
        histogram = [(r["size"], r["n"]) for r in fresh.groupBy("size").agg(F.count("*").alias("n")).collect()]
        rows = plan_by_size(histogram, self.proportions, have)
        plan = self.spark.createDataFrame(rows, "size long, split string, lo long, hi long")
        placed = ranked_within(fresh, "size", "root").join(plan, "size").where("_rank >= lo and _rank < hi").select("root", F.col("split").alias("given"), "size")
        chosen = comps.where("held is not null").select("root", F.col("held").alias("given"), "size").unionByName(placed)
        final = looked_up(moved, chosen, "root", "uid", "size").select("uid", "root", F.when(F.col("split").isNull() | (F.col("split") == F.col("given")), F.col("given")).otherwise(F.lit(QUARANTINE)).alias("split"))
        self.records = ws.write(final, "records")
        return self.records


def split_pairs(pairs: DataFrame, pair_id: str, a: str, b: str, records: DataFrame) -> DataFrame:
    """(pair_id, group_uid, split) of each pair with both ends; quarantined if an end is."""
    ends = pairs.select(F.col(pair_id).alias("pair_id"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    ra = records.select(F.col("uid").alias("a"), F.col("root").alias("group_uid"), F.col("split").alias("sa"))
    rb = records.select(F.col("uid").alias("b"), F.col("split").alias("sb"))
    return ends.join(ra, "a").join(rb, "b").select("pair_id", "group_uid", F.when(F.col("sa") == F.col("sb"), F.col("sa")).otherwise(F.lit(QUARANTINE)).alias("split"))

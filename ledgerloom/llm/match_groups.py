"""Pairwise matches consolidated into groups (p4).

The giant group, if there is one, is peeled first: a breadth-first search by joins starts at the vertex of
highest degree, whose edges (perhaps a third of all) are then met by a one-row frontier instead of a hot
shuffle key. The peeled vertices are anti-joined away; the small groups that remain are labelled by
minimum propagation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.graph import both_ways, canonical_edges, contract, relabel
from ledgerloom.operators.lookup import looked_up
from ledgerloom.storage import Workspace


def peel(ws: Workspace, edges: DataFrame, max_rounds: int = 12) -> tuple[DataFrame | None, int | None, bool]:
    """(vertices reached from the highest-degree vertex, their smallest id, whether the search ended).

    A search that has not ended after ``max_rounds`` is only cut short: its vertices are then one label in
    what remains, so groups stay whole.
    """
    degree = both_ways(edges).groupBy("s").agg(F.count("*").alias("n"))
    top = degree.agg(F.max(F.struct("n", (-F.col("s")).alias("neg"))).alias("m")).first()["m"]
    if top is None:
        return None, None, True
    seen = [ws.write(ws.spark.range(1).select(F.lit(-top["neg"]).alias("id")), "frontier")]
    ended = False
    for _ in range(max_rounds):
        near = both_ways(edges).join(seen[-1].withColumnRenamed("id", "s"), "s", "left_semi").select(F.col("t").alias("id")).distinct()
        # an edge leads at most one level back, so the last two levels are all that can be met again
        for level in seen[-2:]:
            near = near.join(level, "id", "left_anti")
        near = ws.write(near, "frontier")
        if near.isEmpty():
            ended = True
            break
        seen.append(near)
    members = ws.write(reduce(DataFrame.unionByName, seen), "peeled")
    return members, members.agg(F.min("id")).first()[0], ended


def match_groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(id, group_id, member_count): every record with a link, the smallest id of its group, the group's size.

    Pairs may come in either order and repeatedly; pairs with a missing end and pairs of one record with
    itself link nothing. No pairs give an empty result. Other columns of ``pairs`` are not read.
    """
    ws = Workspace(pairs.sparkSession, "match-groups")
    edges = ws.write(canonical_edges(pairs, a, b), "pairs")
    peeled, root, ended = peel(ws, edges)
    if peeled is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("group_id"), F.lit(0).cast("long").alias("member_count"))
    giant = peeled.select("id", F.lit(root).alias("ptr"))
    if ended:
        rest = edges.join(peeled.withColumnRenamed("id", "a"), "a", "left_anti")
        labels = giant.unionByName(contract(ws, ws.write(rest, "rest"), full_jumps=False))
    else:
        small = contract(ws, ws.write(relabel(edges, giant), "rest"), full_jumps=False)
        top = small.where(F.col("id") == F.lit(root)).select(F.col("id").alias("ptr"), F.col("ptr").alias("top"))
        labels = giant.join(top, "ptr", "left").select("id", F.coalesce("top", "ptr").alias("ptr")).unionByName(small.where(F.col("id") != F.lit(root)))
    labels = ws.write(labels, "labels")
    sizes = labels.groupBy("ptr").agg(F.count("*").alias("member_count"))
    sizes = sizes.withColumn("n", F.col("member_count"))
    return looked_up(labels, sizes, "ptr", "id", "n").select("id", F.col("ptr").alias("group_id"), "member_count")

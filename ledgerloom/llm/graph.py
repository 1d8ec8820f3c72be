"""Connected groups of an edge list, without gathering it anywhere.

All steps are equi-joins and partial aggregations on written tables. Each round hooks every vertex to its
smallest neighbour, shortens the pointers and relabels the edges, which at least halves the vertices that
still have a neighbour; chains thus take a logarithmic number of rounds, not their length. Labels never
grow, so a group ends up with its smallest member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.storage import Workspace


def canonical_edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) with a < b; rows with a missing end and self-links drop out."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), x.alias("_x"), y.alias("_y")).where("_x is not null and _y is not null and a < b").select("a", "b").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("b").alias("s"), F.col("a").alias("t")))).alias("e")).select("e.s", "e.t")


def jump(pointers: DataFrame) -> DataFrame:
    """Every pointer replaced by its target's pointer; ``pointers`` (id, ptr) holds every target as an id."""
    return pointers.join(pointers.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2")), "ptr").select("id", F.col("p2").alias("ptr"))


def relabel(edges: DataFrame, pointers: DataFrame) -> DataFrame:
    """Edges between labels; ends without a pointer stay as they are."""
    fa = pointers.select(F.col("id").alias("a"), F.col("ptr").alias("pa"))
    fb = pointers.select(F.col("id").alias("b"), F.col("ptr").alias("pb"))
    moved = edges.join(fa, "a", "left").join(fb, "b", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
    return moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def contract(ws: Workspace, edges: DataFrame, full_jumps: bool) -> DataFrame:
    """(id, ptr): the smallest member of the group of each vertex of ``edges`` (a < b, distinct, written).

    ``full_jumps``: pointers are doubled until they all reach a root before the edges are relabelled;
    otherwise each round propagates the minimum one hook and one jump far.
    """
    levels: list[DataFrame] = []
    while True:
        hook = both_ways(edges).groupBy(F.col("s").alias("id")).agg(F.min("t").alias("t")).select("id", F.least("id", "t").alias("ptr"))
        pointers = ws.write(hook, "hook")
        while True:
            shorter = ws.write(jump(pointers), "jump")
            settled = not full_jumps or shorter.join(pointers.withColumnRenamed("ptr", "old"), "id").where("ptr <> old").isEmpty()
            ws.drop(pointers)
            pointers = shorter
            if settled:
                break
        levels.append(pointers)
        rest = ws.write(relabel(edges, pointers), "edges")
        if len(levels) > 1:
            ws.drop(edges)
        edges = rest
        if rest.isEmpty():
            break
    labels = levels.pop()
    while levels:
        up = labels.select(F.col("id").alias("ptr"), F.col("ptr").alias("top"))
        labels = levels.pop().join(up, "ptr", "left").select("id", F.coalesce("top", "ptr").alias("ptr"))
    return labels

"""Burst collapse and recurrence of event series.

A burst opens with an event that is kept; events at most ``window`` after the kept one belong to it, and the next
later event opens the next burst. The rule is sequential, yet no series is walked in one task: all events are put
into one order (series, time) by range partitioning, so blocks are equally large whatever the series. An event more
than ``window`` after the one before is always kept, and from there on a block is settled by one pass. Only the
events of a block before its first such event depend on the block before: from any kept event the next kept one is the
first event later by more than ``window``, and these pointers are followed by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.storage import Workspace

#: Events in one block of the common order, about.
BLOCK_EVENTS = 1_000_000


def _settle(window: int, key_type: pa.DataType):
    """Rows of a sorted block to (k, t, block, kind): 0 kept, 1 open, 2 the last event, 3 the last kept event of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        last_key = last_t = last_kept = None
        settled = False

        def out(keys: pa.Array, t: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, pa.array(t, pa.int64()), pa.array(np.full(len(t), block, dtype=np.int32)), pa.array(kinds, pa.int32())], names=["k", "t", "block", "kind"])

        for b in batches:
            if not b.num_rows:
                continue
            keys, t = b.column(0), b.column(1).to_numpy()
            sure = np.ones(len(t), dtype=bool)
            if len(t) > 1:
                other = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False).astype(bool)
                sure[1:] = other | (t[1:] - t[:-1] > window)
            sure[0] = last_t is not None and (keys[0].as_py() != last_key or t[0] - last_t > window)
            kinds = np.where(sure, 0, -1).astype(np.int32)
            starts = np.flatnonzero(sure)
            if not settled:
                kinds[: starts[0] if len(starts) else len(t)] = 1
            at = int(starts[0]) if len(starts) and not settled else 0
            kept = last_kept
            # only events close to the one before have to be walked
            for k in np.flatnonzero(kinds[at:] == -1) + at if settled or len(starts) else []:
                if k and sure[k - 1]:
                    kept = t[k - 1]
                if t[k] - kept > window:
                    kinds[k], kept = 0, t[k]
            settled = settled or bool(len(starts))
            if settled:
                kept_rows = np.flatnonzero(kinds == 0)
                if len(kept_rows):
                    last_kept = int(t[kept_rows[-1]])
            last_key, last_t = keys[len(keys) - 1].as_py(), int(t[-1])
            keep = np.flatnonzero(kinds >= 0)
            if len(keep):
                yield out(keys.take(pa.array(keep)), t[keep], kinds[keep])
        if last_t is not None:
            tail = [(last_t, 2)] + ([(last_kept, 3)] if settled else [])
            yield out(pa.array([last_key] * len(tail), key_type), np.array([x for x, _ in tail]), np.array([x for _, x in tail]))

    return run


def _by_doubling(ws: Workspace, marked: DataFrame, window: int, blocks_of: int) -> DataFrame:
    """(k, t) kept among ``marked`` (k, t, sure): the sure events and all that pointers lead to from them."""
    block = (window + 1) * blocks_of

    def home(c: Column) -> Column:
        return ((c - F.pmod(c, F.lit(block))) / F.lit(block)).cast("long")

    # an event serves its own block and, as successor within two windows, the blocks before
    near = F.array_distinct(F.array(home(F.col("t")), home(F.col("t") - 2 * window - 2)))
    blocked = marked.select("k", "t", "sure", home(F.col("t")).alias("home"), F.explode(near).alias("blk"))
    w = Window.partitionBy("k", "blk").orderBy("t")
    nodes = ws.write(blocked.withColumn("nxt", F.min("t").over(w.rangeBetween(window + 1, 2 * window + 1))).where("home = blk").select("k", "t", "sure", "nxt"), "nodes")
    kept = ws.write(nodes.where("sure").select("k", "t"), "kept")
    hops = nodes.where("nxt is not null").select("k", "t", F.col("nxt").alias("n"))
    while True:
        reached = kept.join(hops, ["k", "t"]).select("k", F.col("n").alias("t")).join(kept, ["k", "t"], "left_anti")
        grown = ws.write(reached.distinct(), "reached")
        if grown.isEmpty():
            return kept
        kept = ws.write(kept.unionByName(grown), "kept")
        further = hops.select("k", F.col("t").alias("n"), F.col("n").alias("n2"))
        hops = ws.write(hops.join(further, ["k", "n"]).select("k", "t", F.col("n2").alias("n")), "hops")


def burst_starts(events: DataFrame, key: str, micros: str, window: int, blocks_of: int = 48) -> DataFrame:
    """(key, micros) of the kept events. Equal times of one key are one event; nulls take no part.

    Kept events lie more than ``window`` apart, so their number per key is bounded by the time spanned.
    """
    ws = Workspace(events.sparkSession, "bursts")
    times = ws.write(events.select(F.col(key).alias("k"), F.col(micros).cast("long").alias("t")).where("k is not null and t is not null").distinct(), "times")
    blocks = max(events.sparkSession.sparkContext.defaultParallelism, -(-times.count() // BLOCK_EVENTS))
    schema = T.StructType([*times.schema.fields, T.StructField("block", T.IntegerType()), T.StructField("kind", T.IntegerType())])
    key_type = pa.int64() if dict(times.dtypes)["k"] in ("bigint", "int") else pa.string()
    if key_type == pa.int64():
        schema["k"].dataType = T.LongType()
    typed = times.select(F.col("k").cast(schema["k"].dataType if key_type == pa.int64() else T.StringType()).alias("k"), "t")
    schema["k"].dataType = typed.schema["k"].dataType
    done = ws.write(typed.repartitionByRange(blocks, "k", "t").sortWithinPartitions("k", "t").mapInArrow(_settle(window, key_type), schema), "settled")
    # two rows per block tell how the next block's open events stand to it
    tails = done.where("kind in (2, 3)").groupBy("block").agg(F.max("k").alias("k"), F.max(F.when(F.col("kind") == 2, F.col("t"))).alias("last"), F.max(F.when(F.col("kind") == 3, F.col("t"))).alias("kept"))
    before = tails.withColumns({"pk": F.lag("k").over(Window.orderBy("block")), "pl": F.lag("last").over(Window.orderBy("block"))}).select("block", "pk", "pl")
    opened = done.where("kind = 1")
    first = opened.groupBy("block").agg(F.min("t").alias("t")).join(before, "block").join(opened.select("block", "t", "k"), ["block", "t"])
    sure_first = first.where(F.col("pk").isNull() | (F.col("pk") != F.col("k")) | (F.col("t") - F.col("pl") > window)).select("k", "t")
    marks = tails.where("kept is not null").select("k", F.col("kept").alias("t")).unionByName(sure_first).distinct().withColumn("sure", F.lit(True))
    rest = opened.select("k", "t").join(marks, ["k", "t"], "left_anti").withColumn("sure", F.lit(False))
    late = _by_doubling(ws, ws.write(marks.unionByName(rest), "open"), window, blocks_of)
    kept = done.where("kind = 0").select("k", "t").unionByName(late.join(opened.select("k", "t"), ["k", "t"], "left_semi"))
    return kept.select(F.col("k").cast(events.schema[key].dataType).alias(key), F.col("t").alias(micros))


#: Cadences in days, inclusive, in order of preference at equal fit.
CADENCES = {"daily": (1, 2), "weekly": (5, 9), "biweekly": (11, 17), "monthly": (25, 36)}


def recurrence(starts: DataFrame, key: str, micros: str, cadences: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(key, occurrences, cadence, match_share, classification) of kept events.

    Strong: four occurrences and three quarters of the intervals in one cadence. Moderate: all of at least
    two intervals. Fewer than three occurrences: Insufficient History. Otherwise no pattern and no cadence.
    """
    cad = cadences or CADENCES
    w = Window.partitionBy(key).orderBy(micros)
    gaps = starts.withColumn("_gap", (F.col(micros) - F.lag(micros).over(w)) / 86_400_000_000)
    fits = [F.count_if(F.col("_gap").between(lo, hi)).alias(f"_f{i}") for i, (lo, hi) in enumerate(cad.values())]
    agg = gaps.groupBy(key).agg(F.count("*").alias("occurrences"), *fits)
    best = F.array_max(F.array(*[F.struct(F.col(f"_f{i}").alias("n"), F.lit(-i).alias("pref"), F.lit(name).alias("name")) for i, name in enumerate(cad)]))
    out = agg.select(key, "occurrences", best.alias("b"), (F.col("occurrences") - 1).alias("intervals"))
    share = F.when(F.col("intervals") > 0, F.col("b.n") / F.col("intervals")).otherwise(F.lit(0.0))
    out = out.withColumn("_s", share)
    label = (
        F.when(F.col("occurrences") < 3, "Insufficient History")
        .when((F.col("occurrences") >= 4) & (F.col("_s") >= 0.75), "Strong")
        .when((F.col("_s") >= 1) & (F.col("intervals") >= 2), "Moderate")
        .otherwise("No Recurring Pattern")
    )
    out = out.withColumn("classification", label)
    found = F.col("classification").isin("Strong", "Moderate")
    return out.select(key, "occurrences", F.when(found, F.col("b.name")).alias("cadence"), F.when(found, F.round("_s", 4)).alias("match_share"), "classification")

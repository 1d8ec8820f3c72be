"""Repeated consecutive events collapsed into one event each, by pointer doubling (p5).

Sequences may be arbitrarily long, so none is ever sorted or walked as a whole: all events are put into one
order (sequence, time, tie) by range partitioning, so a block holds about as many events as any other, whatever
the sequences' lengths. Inside its block every event is held against the one before it; the blocks' first events
are held against the last ones of the blocks before. Each matching event then points to its predecessor, and
self-joins replace pointers by their targets' pointers until all reach the start of their run: a logarithmic
number of rounds. In one round no two open pointers share a target, so these joins have no hot keys however
long a run is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.storage import Workspace

#: Events in one block of the common order, about.
BLOCK_EVENTS = 1_000_000

_LINK = [T.StructField("id", T.LongType()), T.StructField("ptr", T.LongType()), T.StructField("at", T.LongType()), T.StructField("before", T.LongType())]


def links(ws: Workspace, events: DataFrame, keys: list[str], same: list[str], max_gap: int) -> DataFrame:
    """(id, ptr, at, before): every event that goes on with its predecessor's run, the predecessor and both times.

    ``events`` is written and holds ``keys`` (the sequence), ``at``, ``id`` and ``same``, all without nulls.
    """
    n = events.count()
    blocks = max(events.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK_EVENTS))
    names = [*keys, "at", "id", *same]
    equal = [*keys, *same]

    def step(rows: pa.Table) -> pa.Table:
        """The links among rows in order; the first row is context only."""
        at, ids = rows["at"].to_numpy(), rows["id"].to_numpy()
        ok = at[1:] - at[:-1] <= max_gap
        for c in equal:
            col = rows[c]
            ok &= pc.equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False).astype(bool)
        k = np.flatnonzero(ok)
        return pa.table({"id": ids[k + 1], "ptr": ids[k], "at": at[k + 1], "before": at[k]})

    schema = T.StructType([*_LINK, T.StructField("block", T.IntegerType()), T.StructField("edge", T.IntegerType()), T.StructField("row", events.select(*names).schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        last: pa.Table | None = None

        def edge(row: pa.Table, which: int) -> pa.RecordBatch:
            none = pa.nulls(1, pa.int64())
            value = pa.array([row.to_pylist()[0]], type=row_type)
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array([block], pa.int32()), pa.array([which], pa.int32()), value], names=[*[f.name for f in _LINK], "block", "edge", "row"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).select(names).combine_chunks()
            row_type = pa.struct([pa.field(f.name, f.type) for f in t.schema])
            if last is None:
                yield edge(t.slice(0, 1), 0)
            out = step(pa.concat_tables([last, t]).combine_chunks() if last is not None else t)
            m = out.num_rows
            if m:
                cols = [out[c].combine_chunks() for c in ("id", "ptr", "at", "before")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(m, block, dtype=np.int32)), pa.nulls(m, pa.int32()), pa.nulls(m, row_type)], names=[*[f.name for f in _LINK], "block", "edge", "row"])
            last = t.slice(t.num_rows - 1, 1)
        if last is not None:
            yield edge(last, 1)

    order = [*keys, "at", "id"]
    found = ws.write(events.select(*names).repartitionByRange(blocks, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "links")
    inner = found.where("edge is null").select("id", "ptr", "at", "before")
    # two rows per block, in the order of the blocks
    edges = found.where("edge is not null").withColumn("prev", F.lag("row").over(Window.orderBy("block", "edge"))).where("edge = 0 and prev is not null")
    goes_on = F.col("row.at") - F.col("prev.at") <= F.lit(max_gap)
    for c in equal:
        goes_on = goes_on & (F.col(f"row.{c}") == F.col(f"prev.{c}"))
    across = edges.where(goes_on).select(F.col("row.id").alias("id"), F.col("prev.id").alias("ptr"), F.col("row.at").alias("at"), F.col("prev.at").alias("before"))
    return inner.unionByName(across)


def run_starts(ws: Workspace, pointers: DataFrame) -> DataFrame:
    """(id, ptr): every pointer of ``pointers`` (id, ptr; no cycles) doubled until it reaches an id that has none itself."""
    ids = pointers.select(F.col("id").alias("ptr"), F.lit(False).alias("done"))
    current = ws.write(pointers.join(ids, "ptr", "left").select("id", "ptr", F.coalesce("done", F.lit(True)).alias("done")), "pointers")
    while not current.where("not done").isEmpty():
        onward = current.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("done").alias("d2"))
        moved = current.where("not done").select("id", "ptr").join(onward, "ptr").select("id", F.col("p2").alias("ptr"), F.col("d2").alias("done"))
        longer = ws.write(current.where("done").unionByName(moved), "pointers")
        ws.drop(current)
        current = longer
    return current.select("id", "ptr")


def collapse_runs(events: DataFrame, sequence: list[str], micros: str, tie: str, same: list[str], max_gap: int) -> DataFrame:
    """One row per run of two or more: first_id, run_count, first_micros, last_micros.

    ``events`` has one row per event: ``sequence`` names its sequence, ``micros`` (long) its time, ``tie`` a
    unique long that orders equal times, ``same`` the columns that must be equal in neighbours, and two
    neighbours may lie at most ``max_gap`` microseconds apart (inclusive). Rows with a null in any of these
    columns take no part. Other columns may have any names. An empty input gives an empty result.
    """
    ws = Workspace(events.sparkSession, "runs-of-events")
    used = [*sequence, micros, tie, *same]
    seq, eq = [f"q{i}" for i in range(len(sequence))], [f"k{i}" for i in range(len(same))]
    clean = events.where(" and ".join(f"`{c}` is not null" for c in used)).select(*[F.col(c).alias(q) for c, q in zip(sequence, seq)], F.col(micros).cast("long").alias("at"), F.col(tie).cast("long").alias("id"), *[F.col(c).alias(k) for c, k in zip(same, eq)])
    found = links(ws, ws.write(clean, "events"), seq, eq, max_gap)
    starts = run_starts(ws, found.select("id", "ptr"))
    # the first link of a run knows when its start was; members are counted by partial sums, so long runs are no hot keys
    members = found.join(starts.withColumnRenamed("ptr", "root"), "id")
    runs = members.groupBy("root").agg(F.count("*").alias("n"), F.min("before").alias("first_micros"), F.max("at").alias("last_micros"))
    return runs.select(F.col("root").alias("first_id"), (F.col("n") + 1).alias("run_count"), "first_micros", "last_micros")

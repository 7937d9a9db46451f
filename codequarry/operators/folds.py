"""Folds along ordered rows - prefix sums, greedy chunks, budgets - that no task does alone.

Rows are dealt into ranges of (key, order), so a key with many rows spans many
ranges; a range is worked on by itself, and only a row per key and range passes
between ranges. Where a fold is no sum, a block of BLOCK rows becomes a map from
the states in which it can be entered to those in which it is left, and the maps
of a key are composed by pointer doubling, in as many rounds as its number of
blocks has bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codequarry.operators.lineage import checkpointed

BLOCK = 4096


def running(rows: DataFrame, by: tuple, order: tuple, what: dict) -> DataFrame:
    """rows with name -> (F.sum or F.max, column) for all names of what, over the rows of their key before them in order.

    A sum of nothing is 0, a maximum of nothing null. Nulls in keys are equal,
    and come first in order; rows that are equal in order go in any.
    """
    ends_of = {F.sum: lambda here, before: F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)), F.max: F.greatest}
    inner = {name: f"_in_{name}" for name in what}
    placed = rows.withColumns({inner[name]: column for name, (_, column) in what.items()})
    placed = checkpointed(placed.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    ends = placed.groupBy(*by, "_part").agg(*[f(inner[name]).alias(name) for name, (f, _) in what.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"_key_{i}") for i, c in enumerate(by)]
    carried = ends.select(*keys, F.col("_part").alias("_key_part"), F.lag("_part").over(Window.partitionBy(*by).orderBy("_part")).alias("_previous"), *[f(name).over(earlier).alias(f"_carried_{name}") for name, (f, _) in what.items()])
    carried = carried.where("_previous is not null").drop("_previous")  # where a key goes on from an earlier range
    local = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = placed.withColumns({f"_here_{name}": f(inner[name]).over(local) for name, (f, _) in what.items()})
    on = F.col("_part") == F.col("_key_part")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_key_{i}"))
    full = here.join(carried, on, "left")
    return full.select(*rows.columns, *[ends_of[f](F.col(f"_here_{name}"), F.col(f"_carried_{name}")).alias(name) for name, (f, _) in what.items()])


def _with_scan(placed: DataFrame, ddl: str) -> StructType:
    """The scan's columns as they are, then ddl's."""
    return StructType([placed.schema["_scan"], *StructType.fromDDL(ddl)])


# --- greedy chunks --------------------------------------------------------------


def _next_starts(before: np.ndarray, max_size: int, chunk_size: int) -> np.ndarray:
    """For a chunk that begins at each row, the row at which the next one does; before: sizes before each row, and after the last."""
    at = np.arange(len(before))
    fits = np.searchsorted(before, before + max_size, "right") - 1
    return np.minimum(np.minimum(at + chunk_size, np.maximum(fits, at + 1)), len(before) - 1)


def _sorted(t: pa.Table):
    """Rows in order; how many are the block's own; whether the last is the end of the scan."""
    t = t.take(pa.array(np.argsort(t["_pos"].to_numpy(), kind="stable")))
    return t, int(t["_own"].to_numpy(zero_copy_only=False).sum())


def _exits(max_size: int, chunk_size: int):
    """For every row of a block at which a chunk that comes from outside can begin: where the next block is entered, after how many chunks."""

    def run(t: pa.Table) -> pa.Table:
        t, own = _sorted(t)
        pos = t["_pos"].to_numpy()
        nxt = _next_starts(t["_before"].to_numpy(), max_size, chunk_size).tolist()
        to, count = [0] * own, [1] * own
        for i in range(own - 1, -1, -1):
            if nxt[i] < own:
                to[i], count[i] = to[nxt[i]], count[nxt[i]] + 1
            else:
                to[i] = nxt[i]
        n = min(chunk_size, own)
        leaves = np.array(to[:n], np.int64)
        over = t["_end"].to_numpy(zero_copy_only=False)[leaves].astype(bool) if n else np.zeros(0, bool)
        return pa.table({"_scan": t["_scan"].slice(0, n), "_pos": pos[:n], "_exit": np.where(over, -1, pos[leaves]) if n else pos[:0], "_count": np.array(count[:n], np.int64)})

    return run


def _labels(max_size: int, chunk_size: int):
    """The chunk of each row of a block that is entered at _entry with chunk _chunk."""

    def run(t: pa.Table) -> pa.Table:
        t, own = _sorted(t)
        nxt = _next_starts(t["_before"].to_numpy(), max_size, chunk_size).tolist()
        begins = np.zeros(own, np.int64)
        if own:
            i = t["_entry"][0].as_py() - t["_pos"][0].as_py()
            while i < own:
                begins[i] = 1
                i = nxt[i]
        chunk = (t["_chunk"][0].as_py() if own else 0) - 1 + np.cumsum(begins)
        return t.slice(0, own).select(["_scan", "_order"]).append_column("chunk", pa.array(chunk, pa.int32()))

    return run


def fold_chunks(files: DataFrame, by: tuple, order: str, max_size: int, chunk_size: int, size: str = "size") -> DataFrame:
    """Greedy chunks of a scan's files in order: (by..., order, chunk).

    A chunk closes when the next file would take it past max_size (unless it is
    empty) or it holds chunk_size files. A null or negative size counts as 0.
    Where a chunk that begins at a file ends is found by binary search in the
    sums of sizes; from which files on blocks are entered, by pointer doubling.
    """
    width = max(BLOCK, chunk_size)
    counted = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    rows = files.select(*by, F.col(order).alias("_order"), counted.alias("_size"))
    placed = running(rows, by, ("_order",), {"_pos": (F.sum, F.lit(1)), "_before": (F.sum, F.col("_size"))})
    placed = placed.select(F.struct(*by).alias("_scan"), "_order", "_size", "_pos", "_before", F.lit(False).alias("_end"))
    placed = checkpointed(placed)
    ends = placed.groupBy("_scan").agg(F.count("*").alias("_pos"), F.sum("_size").alias("_before")).withColumn("_end", F.lit(True))
    every = placed.drop("_size").unionByName(ends, allowMissingColumns=True).withColumn("_block", F.floor(F.col("_pos") / width))
    # A block also sees the first rows of the next one, as far as a chunk can reach.
    seen = every.withColumn("_own", ~F.col("_end")).unionByName(every.where((F.col("_pos") % width < chunk_size) & (F.col("_block") > 0)).withColumns({"_block": F.col("_block") - 1, "_own": F.lit(False)}))
    blocks = placed.agg((F.max("_pos") / width).cast("long")).first()[0]
    entries = checkpointed(placed.where("_pos = 0").select("_scan", F.col("_pos").alias("_entry"), F.lit(0).cast("long").alias("_chunk")))
    if blocks:
        jumps = seen.groupBy("_scan", "_block").applyInArrow(_exits(max_size, chunk_size), _with_scan(placed, "_pos long, _exit long, _count long"))
        jumps, reach = checkpointed(jumps.where("_exit >= 0")), 1
        while reach <= blocks:
            far = entries.join(jumps.withColumnRenamed("_pos", "_entry"), ["_scan", "_entry"]).select("_scan", F.col("_exit").alias("_entry"), (F.col("_chunk") + F.col("_count")).alias("_chunk"))
            entries = checkpointed(entries.union(far))
            reach *= 2
            if reach <= blocks:
                second = jumps.select("_scan", F.col("_pos").alias("_exit"), F.col("_exit").alias("_to"), F.col("_count").alias("_more"))
                jumps = checkpointed(jumps.join(second, ["_scan", "_exit"]).select("_scan", "_pos", F.col("_to").alias("_exit"), (F.col("_count") + F.col("_more")).alias("_count")))
    entered = seen.join(entries.withColumn("_block", F.floor(F.col("_entry") / width)), ["_scan", "_block"])
    kind = files.schema[order].dataType.simpleString()
    found = entered.groupBy("_scan", "_block").applyInArrow(_labels(max_size, chunk_size), _with_scan(placed, f"_order {kind}, chunk int"))
    return found.select(*[F.col(f"_scan.`{c}`").alias(c) for c in by], F.col("_order").alias(order), "chunk")


# --- budgets --------------------------------------------------------------------


def _spend(t: pa.Table) -> pa.Table:
    """Which rows of a block fit what is left, in order, and (as row -1) what is left then."""
    t = t.take(pa.array(np.argsort(t["_pos"].to_numpy(), kind="stable")))
    left, took = t["_room"][0].as_py(), []
    for pos, n in zip(t["_pos"].to_pylist(), t["_n"].to_pylist()):
        if n <= left:
            left -= n
            took.append(pos)
    scan = t["_scan"].take(pa.array([0] * (len(took) + 1)))
    return pa.table({"_scan": scan, "_pos": pa.array([*took, -1], pa.int64()), "_left": pa.array([left] * (len(took) + 1), pa.int64())})


def admit(chunks: DataFrame, by: tuple, order: str, budget: int, reserve: int = 4000, size: str = "tokens") -> DataFrame:
    """Which chunks run under a token budget: one that does not fit is skipped, later ones may still fit.

    Returns (by..., order, size, admitted). A budget of 0 admits all; a null or
    negative size counts as 0. A round admits, by prefix sums over blocks, all
    chunks no larger than what is left up to the block in which they exceed it;
    that block is folded row by row, and what is larger than what is left then
    goes for good. So rounds depend on how often what is left shrinks, not on the
    number of chunks.
    """
    counted = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    if budget == 0:
        return chunks.select(*by, order, size, F.lit(True).alias("admitted"))
    rows = chunks.select(*by, F.col(order).alias("_order"), F.col(size).alias("_size"), counted.alias("_n"))
    placed = running(rows, by, ("_order",), {"_pos": (F.sum, F.lit(1))})
    placed = checkpointed(placed.select(F.struct(*by).alias("_scan"), "_order", "_size", "_n", "_pos", F.floor(F.col("_pos") / BLOCK).alias("_block")))
    live = placed.where((F.col("_n") > 0) & (F.col("_n") <= budget - reserve)).select("_scan", "_block", "_pos", "_n", F.lit(budget - reserve).cast("long").alias("_left"))
    took = None
    while True:
        sums = live.groupBy("_scan", "_block", "_left").agg(F.sum("_n").alias("_sum"))
        before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_scan").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = sums.withColumn("_before", before).where("_before <= _left and _before + _sum > _left")
        cut = checkpointed(cut.select("_scan", F.col("_block").alias("_cut"), (F.col("_left") - F.col("_before")).alias("_room")))
        met = live.drop("_left").join(cut, "_scan", "left")
        folded = met.where("_block = _cut").groupBy("_scan").applyInArrow(_spend, _with_scan(placed, "_pos long, _left long"))
        folded = checkpointed(folded)
        found = met.where("_cut is null or _block < _cut").select("_scan", "_pos").union(folded.where("_pos >= 0").select("_scan", "_pos"))
        took = checkpointed(found if took is None else took.union(found))
        if cut.isEmpty():
            break
        live = checkpointed(met.where("_block > _cut").drop("_cut", "_room").join(folded.where("_pos = -1").select("_scan", "_left"), "_scan").where("_n <= _left"))
    none = (F.col("_n") == 0) & F.lit(budget >= reserve)
    full = placed.join(took.withColumn("_took", F.lit(True)), ["_scan", "_pos"], "left")
    return full.select(*[F.col(f"_scan.`{c}`").alias(c) for c in by], F.col("_order").alias(order), F.col("_size").alias(size), (none | F.coalesce("_took", F.lit(False))).alias("admitted"))

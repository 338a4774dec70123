"""Chains along walks: from a walk's first visit, each chosen visit points to the next chosen one.

A pointer only goes forwards, so a block of consecutive visits is a small table: where a chain that enters it at
some visit leaves it again. Blocks are done apart, by pointer doubling on arrays. Tables are composed over the blocks of a
long walk by doubling too, for the visits that pointers from other blocks reach, and then each block is
replayed from where its walk's chain enters it. No walk is in one row or one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from walkframe.session import stored

#: Visits of a block.
BLOCK = 1 << 16


def whole_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of batches in the order of ``walk`` and ``block``: tables of whole blocks, and where each begins."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        walk, block = (t.column(c).to_numpy() for c in ("walk", "block"))
        return np.flatnonzero(np.r_[True, (walk[1:] != walk[:-1]) | (block[1:] != block[:-1])])

    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([*held, b]).combine_chunks()
            at = starts(t)
            if len(at) > 1:
                yield t.slice(0, at[-1]), at[:-1]
            held = t.slice(at[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, starts(t)


def inner_pointers(t: pa.Table, at: np.ndarray) -> np.ndarray:
    """The row that each row points to, itself if there is none in its block; positions of a walk have no gaps."""
    pos, to = t.column("pos").to_numpy(), t.column("next").fill_null(-1).to_numpy()
    size = np.diff(np.append(at, len(pos)))
    first, end = np.repeat(at, size), np.repeat(at + size, size)
    row = first + (to - pos[first])
    return np.where((to > pos) & (row < end), row, np.arange(len(pos)))


def doubled(row: np.ndarray) -> Iterator[np.ndarray]:
    """Pointers over 1, 2, 4, ... steps, until nothing moves; the last goes to the end of each chain."""
    while True:
        yield row
        further = row[row]
        if np.array_equal(further, row):
            return
        row = further


def exits_of_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(walk, pos, exit)``: where the chain from each visit is when it leaves the block."""
    for t, at in whole_blocks(batches):
        *_, last = doubled(inner_pointers(t, at))
        out = pa.table({"walk": t.column("walk"), "pos": t.column("pos"), "exit": t.column("next").take(pa.array(last))})
        yield from out.combine_chunks().to_batches()


def marked(batches: Iterable[pa.RecordBatch], keep: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """``(walk, block, pos, nth)``, and the columns to ``keep``, of the visits on the chain from the block's ``entry``, numbered in the block."""
    for t, at in whole_blocks(batches):
        pos = t.column("pos").to_numpy()
        size = np.diff(np.append(at, len(pos)))
        on = np.zeros(len(pos), dtype=bool)
        entry = t.column("entry").to_numpy()[at] - pos[at]
        inside = entry < size
        on[(at + entry)[inside]] = True
        for step in reversed(list(doubled(inner_pointers(t, at)))):
            on[step[on]] = True
        rank = np.cumsum(on)
        nth = rank - 1 - np.repeat(rank[at] - on[at], size)
        rows = np.flatnonzero(on)
        out = pa.table({"walk": t.column("walk").take(pa.array(rows)), "block": t.column("block").take(pa.array(rows)), "pos": pos[rows], "nth": nth[rows], **{c: t.column(c).take(pa.array(rows)) for c in keep}})
        yield from out.combine_chunks().to_batches()


def in_blocks(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    return rows.repartition("walk", "block").sortWithinPartitions("walk", "block", "pos").mapInArrow(run, schema)


def entries(rows: DataFrame, blocks: int) -> DataFrame:
    """``(walk, pos)``: where the chains of walks of several blocks enter each of their blocks."""
    several = rows.join(rows.where("block > 0").select("walk").distinct(), "walk", "left_semi")
    exits = stored(in_blocks(several, exits_of_blocks, "walk long, pos long, exit long").where("exit is not null"))
    reached = exits.select("walk", F.col("exit").alias("pos")).union(exits.select("walk", F.lit(0).cast("long").alias("pos"))).distinct()
    jumps = [stored(exits.join(reached, ["walk", "pos"], "left_semi"))]
    for _ in range(blocks.bit_length() - 1):
        j = jumps[-1]
        jumps.append(stored(j.join(j.select("walk", F.col("pos").alias("exit"), F.col("exit").alias("further")), ["walk", "exit"]).select("walk", "pos", F.col("further").alias("exit"))))
    on = exits.where("pos = 0").select("walk", "pos")
    for j in reversed(jumps):
        on = stored(on.union(on.join(j, ["walk", "pos"]).select("walk", F.col("exit").alias("pos"))))
    # a pointer may go behind the end of its walk
    return on.join(several.select("walk", "pos"), ["walk", "pos"], "left_semi")


def chain(pointers: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(walk, pos, nth)``: the visits on each walk's chain from position 0 on, numbered from 0.

    ``pointers`` has a row ``(walk, pos, next)`` for each visit, positions without gaps; ``next`` is a later position or null, and one
    behind the walk's last ends the chain.
    """
    rows = stored(pointers.select(F.col("walk").cast("long").alias("walk"), "pos", "next", F.call_function("div", F.col("pos"), F.lit(block)).alias("block")))
    last = rows.agg(F.max("block")).first()[0]
    if not last:
        on = in_blocks(rows.withColumn("entry", F.lit(0).cast("long")), marked, "walk long, block long, pos long, nth long")
        return on.select("walk", "pos", "nth")
    reached = entries(rows, last + 1).where("pos > 0").select("walk", F.call_function("div", F.col("pos"), F.lit(block)).alias("block"), F.col("pos").alias("entry"))
    starts = rows.where("pos = 0").select("walk", "block", F.lit(0).cast("long").alias("entry")).union(reached)
    on = stored(in_blocks(rows.join(starts, ["walk", "block"]), marked, "walk long, block long, pos long, nth long"))
    n = on.groupBy("walk", "block").agg(F.count("*").alias("n"))  # a row a block
    before = F.sum("n").over(W.partitionBy("walk").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    n = n.select("walk", "block", F.coalesce(before, F.lit(0)).alias("before"))
    return on.join(n, ["walk", "block"]).select("walk", "pos", (F.col("before") + F.col("nth")).alias("nth"))

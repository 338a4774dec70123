"""Connected components of an edge list, by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from walkframe.session import cut, discard, stored

#: Edges that a task contracts at a time.
CHUNK = 1 << 18


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index connected with each of 0..n-1, by links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def contracted(batches: Iterable[pa.RecordBatch], names: tuple[str, str] = ("u", "v")) -> Iterator[pa.RecordBatch]:
    """Of a task's edges, chunk by chunk: a star for each component, which connects the same nodes."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = roots(len(ids), at[: len(u)], at[len(u) :])
        leaf = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(ids[root[leaf]])], list(names))

    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= CHUNK:
            yield stars(held)
            held, n = [], 0
    if held:
        yield stars(held)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", contract: bool = True) -> DataFrame:
    """Return ``(node, component)``; ``component`` is the smallest node reachable.

    Tasks first contract what they hold. Every round is then two aggregations and two joins over the edge list, whose size
    never grows, so the work is linear in the edges for each of the O(log n)
    rounds. A node's neighbours are never gathered in one row: its minimum comes
    from a (map-side combined) aggregation and goes back to the edges by a join,
    which adaptive execution can split where a hub holds many of them.
    Null and self edges carry nothing and are dropped; nodes without any other
    edge don't appear in the result. ``contract=False`` leaves out the first contraction,
    for edges whose tasks have done it.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col("u") != F.col("v"))
        .select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    )
    # each task leaves stars of what it has, and again with neighbours of near ids in one task (a hub may be in several)
    e = cut(e.mapInArrow(contracted, "u long, v long") if contract else e)
    e = e.repartitionByRange("v", "u").mapInArrow(contracted, "u long, v long").distinct()
    e, before = cut(e), None
    while True:
        found = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if found == before or found[0] == 0:
            break
        before = found
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def labelled(batches: Iterable[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Of a task's edges, ``chunk`` at a time: each node, and the smallest one that these edges connect it with."""

    def labels(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = roots(len(ids), at[: len(u)], at[len(u) :])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["node", "root"])

    held, n = [], 0
    for b in batches:
        while n + b.num_rows >= chunk:
            yield labels([*held, b.slice(0, chunk - n)])
            b, held, n = b.slice(chunk - n), [], 0
        if b.num_rows:
            held, n = [*held, b], n + b.num_rows
    if held:
        yield labels(held)


def contracted_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` as of ``connected_components``, for edges of which many are repeated or soon lie within a component; a self edge makes a node its own.

    Edges of near ids meet in one task, which finds the components of each of its chunks. A node that is in several chunks
    links what they call its component; only these links, distinct, go into rounds, and there are few where ids follow walks.
    """
    ends = [F.col(c).cast("long") for c in (src, dst)]
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.least(*ends).alias("u"), F.greatest(*ends).alias("v")).distinct()
    e, schema = stored(e), "node long, root long"
    if e.count() < CHUNK:
        return stored(e.coalesce(1).mapInArrow(partial(labelled, chunk=CHUNK), schema)).withColumnRenamed("root", "component")
    near = e.repartitionByRange("u", "v").sortWithinPartitions("u", "v")
    every = stored(near.mapInArrow(partial(labelled, chunk=CHUNK), schema))
    discard(e)
    root = stored(every.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other")))
    several = root.where("root <> other").select("node", F.col("root").alias("low"))
    links = every.join(several, "node").where("root <> low").select(F.col("low").alias("u"), F.col("root").alias("v")).distinct()
    label = merged_components(stored(links)).select(F.col("node").alias("root"), "component")
    return root.join(label, "root", "left").select("node", F.coalesce("component", "root").alias("component"))


def merged_components(e: DataFrame) -> DataFrame:
    """``(node, component)`` of the stored, distinct edges ``(u, v)`` between different nodes.

    Each round every node points to the neighbour that comes first in a random order, if before itself, and is merged with
    the node that this one points to. Distinct edges between what is left go on, so nodes and edges get fewer with each
    round, whatever the graph's diameter and the order of its ids, until one task's chunk holds them. The least node of a
    component is carried along, and in the end labels go back round by round, along the pointers.
    """
    spark, merged, low = e.sparkSession, [], None
    while left := e.count():
        if left < CHUNK:
            root = stored(e.coalesce(1).mapInArrow(partial(labelled, chunk=CHUNK), "node long, root long"))
        else:
            root = stored(pointed(e, len(merged)))
            root = root.join(root.select(F.col("node").alias("root"), F.col("root").alias("further")), "root").select("node", F.col("further").alias("root"))
        root = root.withColumn("low", F.col("node")) if low is None else root.join(low.select(F.col("root").alias("node"), "low"), "node")
        merged.append(stored(root))
        if left < CHUNK:
            break
        low = merged[-1].groupBy("root").agg(F.min("low").alias("low"))
        side = lambda c: merged[-1].select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        apart = e.join(side("u"), "u").join(side("v"), "v").where("u_root <> v_root")
        before, e = e, stored(apart.select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v")).distinct())
        discard(before)
    label = spark.createDataFrame([], "root long, final long")
    for m in reversed(merged):
        lowest = m.groupBy("root").agg(F.min("low").alias("low"))
        known = lowest.join(label, "root", "left").select("root", F.coalesce("final", "low").alias("final"))
        label = m.join(known, "root").select(F.col("node").alias("root"), "final")
    return label.select(F.col("root").alias("node"), F.col("final").alias("component"))


def pointed(e: DataFrame, turn: int) -> DataFrame:
    """``(node, root)``: of a node and its neighbours, the one that comes first in the ``turn``-th random order."""
    place = lambda c: F.xxhash64(c, F.lit(turn))
    both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
    first = both.groupBy(F.col("e.u").alias("node")).agg(F.min_by("e.v", place("e.v")).alias("first"))
    return first.select("node", F.when(place("first") < place("node"), F.col("first")).otherwise(F.col("node")).alias("root"))


def join_components(labels: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` after new edges, from the ``labels`` before them; edges that made those aren't read again.

    New edges become edges between labels, whose components say which labels change; a node without a label is its own.
    """
    ends = edges.select(F.explode(F.array(*[F.col(c).cast("long") for c in (src, dst)])).alias("node")).where("node is not null").distinct()
    new = ends.join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    known = labels.select("node", "component").union(new)
    side = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    links = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).join(side("a"), "a").join(side("b"), "b")
    change = contracted_components(links.where("a_label <> b_label"), "a_label", "b_label")
    change = change.select(F.col("node").alias("component"), F.col("component").alias("lower")).where("component <> lower")
    return known.join(change, "component", "left").select("node", F.coalesce("lower", "component").alias("component"))

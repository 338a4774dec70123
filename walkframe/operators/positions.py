"""Base pairs along walks: lengths, offsets, DNA, sampled reference positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from walkframe.functions.dna import oriented
from walkframe.functions.handles import id_of
from walkframe.operators.chains import BLOCK, chain
from walkframe.session import stored


def with_lengths(visit: DataFrame, node: DataFrame) -> DataFrame:
    """Visits with ``bp``, the length of the node."""
    bp = node.select("node_id", F.length("seq").cast("long").alias("bp"))
    return visit.withColumn("node_id", id_of("g")).join(bp, "node_id").drop("node_id")


def path_lengths(visit: DataFrame, node: DataFrame) -> DataFrame:
    return with_lengths(visit, node).groupBy("path_id").agg(F.count("*").alias("nodes"), F.sum("bp").alias("bp"))


def path_offsets(visit: DataFrame, node: DataFrame) -> DataFrame:
    """``(path_id, pos, g, offset)``: bases before each visit on its walk."""
    before = W.partitionBy("path_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return with_lengths(visit, node).select("path_id", "pos", "g", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("offset"))


def path_dna(visit: DataFrame, node: DataFrame) -> DataFrame:
    """``(path_id, dna)``: sequences of all visits in order, reverse visits complemented."""
    pieces = visit.withColumn("node_id", id_of("g")).join(node, "node_id").select("path_id", F.struct("pos", oriented("seq", "g").alias("dna")).alias("p"))
    walk = F.sort_array(F.collect_list("p"))
    return pieces.groupBy("path_id").agg(F.array_join(F.transform(walk, lambda x: x["dna"]), "").alias("dna"))


def text_offsets(lengths: DataFrame) -> DataFrame:
    """``(path_id, bp, offset)``: where each path starts in a text of all, one end after each."""
    from walkframe.operators.prefix import running_sum

    return running_sum(lengths.withColumn("_unit", F.col("bp") + 1), "path_id", "_unit", "offset").select("path_id", "bp", "offset")


def reference_positions(offsets: DataFrame, interval: int, width: int = 1 << 16, block: int = BLOCK) -> DataFrame:
    """``(path_id, pos, offset)``: of each walk, greedily, the first node start at ``interval`` or more after the one before.

    ``offsets`` are those of the paths to index (reference and generic samples);
    interval 0 takes every node start. Each visit points to the first that is far enough behind it, and the chain of these pointers is
    what is taken. That visit is looked up in ranges of ``width`` bases.
    """
    if interval == 0:
        return offsets.select("path_id", "pos", "offset")
    width = max(width, interval)
    rows = stored(offsets.select("path_id", "pos", "offset"))
    part = F.call_function("div", F.col("x"), F.lit(width)).alias("part")
    none = F.lit(None).cast("struct<offset:bigint,pos:bigint>")
    marks = rows.select("path_id", "pos", F.col("offset").alias("x"), F.lit(1).alias("kind"), F.struct("offset", "pos").alias("start"))
    marks = marks.union(rows.select("path_id", "pos", F.col("offset") + interval, F.lit(0), none)).withColumn("part", part)
    # from the end backwards, so that the last seen is the next one
    falling = W.partitionBy("path_id", "part").orderBy(F.desc("x"), F.desc("kind"), F.desc("pos"))
    here = F.last("start", ignorenulls=True).over(falling.rowsBetween(W.unboundedPreceding, W.currentRow))
    later = F.last("start", ignorenulls=True).over(W.partitionBy("path_id").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1))
    parts = marks.groupBy("path_id", "part").agg(F.min("start").alias("start")).select("path_id", "part", later.alias("later"))
    found = marks.withColumn("here", here).where("kind = 0").join(parts, ["path_id", "part"])
    pointers = found.select(F.col("path_id").alias("walk"), "pos", F.coalesce("here", "later")["pos"].alias("next"))
    on = chain(pointers, block).select(F.col("walk").alias("path_id"), "pos")
    return rows.join(on, ["path_id", "pos"]).select("path_id", "pos", "offset")

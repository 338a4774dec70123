"""Tag arrays: for each suffix of all path sequences, in suffix-array order, the place in the graph where it starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from walkframe.functions.dna import tag
from walkframe.operators.positions import path_offsets, with_lengths


def tags_of_text(visit: DataFrame, node: DataFrame, starts: DataFrame) -> DataFrame:
    """``(text_offset, tag)`` for each base of each path, and 0 for the end after it.

    ``starts`` are ``(path_id, bp, offset)``: where each path begins in the text.
    """
    at = path_offsets(visit, node).withColumnRenamed("offset", "in_path")
    bases = with_lengths(at, node).join(starts.select("path_id", "offset"), "path_id")
    each = bases.select("g", (F.col("offset") + F.col("in_path")).alias("base"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bp") - 1)).alias("i"))
    ends = starts.select((F.col("offset") + F.col("bp")).alias("text_offset"), F.lit(0).cast("long").alias("tag"))
    return each.select((F.col("base") + F.col("i")).alias("text_offset"), tag("g", "i").alias("tag")).union(ends)


def tag_array(tags: DataFrame, suffix_array: DataFrame) -> DataFrame:
    """``(rank, tag)``: tags joined with ``(rank, text_offset)``."""
    return suffix_array.join(tags, "text_offset").select("rank", "tag")


def count_runs(values: DataFrame, order: str, value: str, width: int = 1 << 20) -> DataFrame:
    """Number of runs of equal values in the order of a dense rank, without one global window.

    A row starts a run unless the row of the rank before has the same value: that
    row is found by an equi-join of neighbouring ranges.
    """
    part = F.floor(F.col(order) / width)
    rows = values.select(F.col(order).alias("o"), F.col(value).alias("v"), part.alias("p"))
    # the last row of a range is also handed to the next one
    handed = rows.where((F.col("o") + 1) % width == 0).select("o", "v", (F.col("p") + 1).alias("p"), F.lit(1).alias("extra"))
    both = rows.withColumn("extra", F.lit(0)).union(handed)
    new = ~F.col("v").eqNullSafe(F.lag("v").over(W.partitionBy("p").orderBy("o"))) | (F.col("o") == 0)
    return both.withColumn("new", new).where("extra = 0").agg(F.sum(F.col("new").cast("long")).alias("runs"))

"""Weakly connected components of the graph, and the paths of a contig's components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from walkframe.functions.handles import id_of
from walkframe.operators.components import contracted_components
from walkframe.operators.navigation import steps
from walkframe.operators.prefix import running_sum
from walkframe.session import stored


def node_links(visit: DataFrame) -> DataFrame:
    """``(src, dst)`` of adjacent visits; the last visit of a walk is a link with itself, so every node has one and walks are read once."""
    last, node = F.col("next_g") == 0, id_of("g")
    return steps(visit).select(node.alias("src"), F.when(last, node).otherwise(id_of("next_g")).alias("dst"))


def node_components(visit: DataFrame) -> DataFrame:
    """``(node_id, component)``, the smallest node of each component, for every visited node."""
    return contracted_components(node_links(visit)).withColumnRenamed("node", "node_id")


def numbered_components(components: DataFrame) -> DataFrame:
    """``(component_no, member_no, node_id)``: components by their smallest node and members by id, both numbered from 0.

    Members are numbered in ranges of the whole order, so a component that has most nodes isn't one task's work.
    """
    rows = components.select("component", "node_id").repartitionByRange("component", "node_id").sortWithinPartitions("component", "node_id")
    rows = running_sum(stored(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("one", F.lit(1))), "at", "one", "place", 1 << 33)
    first = rows.groupBy("component").agg(F.min("place").alias("first"))
    no = running_sum(first.withColumn("one", F.lit(1)), "component", "one", "component_no").select("component", "component_no", "first")
    return rows.join(no, "component").select("component_no", (F.col("place") - F.col("first")).alias("member_no"), "node_id")


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("nodes"), F.max("node_id").alias("last_node"))


def paths_of_contig(visit: DataFrame, path: DataFrame, contig_id: int, components: DataFrame) -> DataFrame:
    """``(path_id)``: every path that starts in a component where a path of the contig starts."""
    first = visit.where("pos = 0").select("path_id", id_of("g").alias("node_id")).join(components, "node_id").select("path_id", "component")
    chosen = first.join(path.where(F.col("contig_id") == contig_id), "path_id", "left_semi").select("component").distinct()
    return first.join(chosen, "component", "left_semi").select("path_id")

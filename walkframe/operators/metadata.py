"""Names of paths, samples, contigs; tags; reference samples; fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from walkframe.functions.names import GENERIC_SAMPLE, display_name, fragment_name, pansn_name
from walkframe.model import PathGraph, names_of_paths
from walkframe.operators.prefix import running_sum
from walkframe.session import cut

REFERENCE_SAMPLES = "reference_samples"


def path_names(graph: PathGraph) -> DataFrame:
    """``(path_id, sample, contig, phase, fragment, name, pansn)``"""
    n = names_of_paths(graph)
    return n.select(
        "path_id", "sample", "contig", "phase", "fragment",
        display_name("sample", "phase", "contig", "fragment").alias("name"),
        pansn_name("sample", "phase", "contig").alias("pansn"),
    )


def fragment_names(graph: PathGraph, lengths: DataFrame) -> DataFrame:
    """``(path_id, name)`` with the end of the fragment, from path lengths in bases."""
    n = names_of_paths(graph).join(lengths.select("path_id", "bp"), "path_id")
    return n.select("path_id", fragment_name("sample", "phase", "contig", "fragment", F.col("fragment") + F.col("bp")).alias("name"))


def find_path(graph: PathGraph, queries: DataFrame) -> DataFrame:
    """Of ``(query_id, sample, contig, phase, fragment)``: the first path of that name, or null."""
    s = graph.sample.withColumnRenamed("name", "sample")
    c = graph.contig.withColumnRenamed("name", "contig")
    q = queries.join(s, "sample", "left").join(c, "contig", "left")
    # a name is one row, however many paths have it
    key = ["sample_id", "contig_id", "phase", "fragment"]
    first = graph.path.groupBy(*key).agg(F.min("path_id").alias("path_id"))
    hits = q.join(first, key).groupBy("query_id").agg(F.min("path_id").alias("path_id"))
    return queries.select("query_id").join(hits, "query_id", "left")


def find_fragment(graph: PathGraph, queries: DataFrame) -> DataFrame:
    """The last fragment at or before the one asked for, of the same haplotype (ties: the lowest path).

    An as-of join in one pass: fragments and queries of a haplotype are sorted
    together, and each query takes the last fragment before it.
    """
    s = graph.sample.withColumnRenamed("name", "sample")
    c = graph.contig.withColumnRenamed("name", "contig")
    key = ["sample_id", "contig_id", "phase"]
    known = graph.path.groupBy(*key, "fragment").agg(F.min("path_id").alias("path_id"))
    asked = queries.join(s, "sample").join(c, "contig").select(*key, "fragment", F.lit(None).cast("long").alias("path_id"), "query_id")
    both = known.withColumn("query_id", F.lit(None).cast(queries.schema["query_id"].dataType)).select(*key, "fragment", "path_id", "query_id").union(asked)
    w = W.partitionBy(*key).orderBy("fragment", F.col("query_id").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    best = both.withColumn("found", F.last("path_id", ignorenulls=True).over(w)).where("query_id is not null")
    return queries.select("query_id").join(best.select("query_id", F.col("found").alias("path_id")), "query_id", "left")


def paths_per_contig(graph: PathGraph) -> DataFrame:
    return graph.path.groupBy("contig_id").agg(F.count("*").alias("n_paths"), F.min("path_id").alias("first_path"), F.max("path_id").alias("last_path"))


def haplotypes(graph: PathGraph) -> DataFrame:
    """One row of counts: paths, samples, haplotypes (sample and phase) and contigs in use."""
    return graph.path.agg(
        F.count("*").alias("paths"), F.countDistinct("sample_id").alias("samples"),
        F.countDistinct("sample_id", "phase").alias("haplotypes"), F.countDistinct("contig_id").alias("contigs"),
    )


def normalised_tags(tag: DataFrame) -> DataFrame:
    """Keys are case-insensitive; of equal keys the greatest value stays."""
    return tag.groupBy("scope", F.lower("key").alias("key")).agg(F.max("value").alias("value"))


def set_tags(tag: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or overwrite ``(scope, key, value)``."""
    new = normalised_tags(new)
    old = tag.select("scope", F.lower("key").alias("key"), "value")
    return old.join(new, ["scope", "key"], "left_anti").select("scope", "key", "value").union(new.select("scope", "key", "value"))


def remove_tags(tag: DataFrame, *keys: str) -> DataFrame:
    return tag.where(~F.lower("key").isin(*[k.lower() for k in keys]))


def reference_samples(graph: PathGraph, also_generic: bool = False) -> DataFrame:
    """``(ordinal, sample_id, name)`` in the order of the tag; names without a sample are left out, generic comes last."""
    value = normalised_tags(graph.tag).where((F.col("scope") == "index") & (F.col("key") == REFERENCE_SAMPLES))
    names = value.select(F.posexplode(F.split("value", " ")).alias("ordinal", "name"))
    if also_generic:
        last = graph.sample.where(F.col("name") == GENERIC_SAMPLE).select(F.lit(2**31 - 1).alias("ordinal"), "name")
        names = names.union(last)
    return names.join(graph.sample, "name").select("ordinal", "sample_id", "name")


def set_reference_samples(graph: PathGraph, names: DataFrame) -> DataFrame:
    """``(value, n)``: the tag for a set of names: those with a sample, but the generic one, sorted; no row if none."""
    known = names.select("name").distinct().join(graph.sample, "name", "left_semi").where(F.col("name") != GENERIC_SAMPLE)
    found = known.agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("value"), F.count("*").alias("n"))
    return found.where("n > 0")


def duplicates(names: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that occur more than once: a dictionary of them can't be built."""
    return names.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dictionary(names: DataFrame, name: str = "name") -> DataFrame:
    """``(id, name)``: distinct names numbered in byte order."""
    placed = names.select(name).distinct().repartitionByRange(name).sortWithinPartitions(name)
    placed = cut(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_one", F.lit(1)))
    return running_sum(placed, "_at", "_one", "id").select("id", name)

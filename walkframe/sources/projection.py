"""Path graphs made of the star-schema test tables: orders as walks over chopped segments, events as walks of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from walkframe.functions.handles import encode
from walkframe.functions.names import GENERIC_SAMPLE
from walkframe.model import PathGraph
from walkframe.operators.prefix import large, running_sum

#: Bases a node, at most.
NODE_BP = 10
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def tables(spark: SparkSession, sf_dir: str):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seg_id, name, seq, node_lo, node_hi)``: one segment for each region and part, with derived DNA."""
    t = tables(spark, sf_dir)
    # one integer for the whole query: how far apart the segments of two regions are
    p = t("part").agg(F.max("p_partkey")).first()[0] + 1
    regions = F.sequence(F.lit(0), F.lit(t("region").agg(F.max("r_regionkey")).first()[0]))
    seg = t("part").select(F.explode(regions).alias("r"), "p_partkey", F.col("p_size").cast("long").alias("bp"))
    seg = seg.select((F.col("r") * p + F.col("p_partkey")).cast("long").alias("seg_id"), "bp").withColumn("nn", F.floor((F.col("bp") + NODE_BP - 1) / NODE_BP))
    text = F.col("seg_id").cast("string")
    letters = F.concat(F.md5(F.concat(F.lit("a"), text)), F.md5(F.concat(F.lit("b"), text)))
    seq = F.substring(F.translate(letters, "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(1), F.col("bp").cast("int"))
    low = running_sum(seg, "seg_id", "nn", "before")
    return large(low).select("seg_id", F.concat(F.lit("s"), text).alias("name"), seq.alias("seq"), (F.col("before") + 1).alias("node_lo"), (F.col("before") + 1 + F.col("nn")).alias("node_hi"))


def segment_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path_id, sv, seg_id, is_rev)``: lines of an order, in order, over the segments of the customer's region."""
    t = tables(spark, sf_dir)
    p = t("part").agg(F.max("p_partkey")).first()[0] + 1
    home = large(t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))).select("c_custkey", "n_regionkey")
    region = t("orders").join(home, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_regionkey")
    lines = t("lineitem").join(region, F.col("l_orderkey") == F.col("o_orderkey"))
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return lines.select(
        F.col("l_orderkey").alias("path_id"),
        (F.row_number().over(order) - 1).cast("long").alias("sv"),
        (F.col("n_regionkey") * F.lit(p) + F.col("l_partkey")).cast("long").alias("seg_id"),
        (F.col("l_returnflag") == "R").alias("is_rev"),
    )


def order_visits(visits: DataFrame, segment: DataFrame) -> DataFrame:
    """``(path_id, pos, g)``: segment visits taken apart into node visits."""
    seg = segment.select("seg_id", "node_lo", (F.col("node_hi") - F.col("node_lo")).alias("nn"))
    before = W.partitionBy("path_id").orderBy("sv").rowsBetween(W.unboundedPreceding, -1)
    steps = (
        visits.join(seg, "seg_id")
        .withColumn("before", F.coalesce(F.sum("nn").over(before), F.lit(0)))
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nn") - 1)))
    )
    node = F.when(F.col("is_rev"), F.col("node_lo") + F.col("nn") - 1 - F.col("i")).otherwise(F.col("node_lo") + F.col("i"))
    return steps.select("path_id", (F.col("before") + F.col("i")).cast("long").alias("pos"), encode(node, "is_rev").alias("g"))


def nodes_of(segment: DataFrame, visits: DataFrame) -> DataFrame:
    """``(node_id, seq)`` of the visited nodes: of those segments that ``visits`` go over, as they go over whole ones."""
    used = large(segment.join(visits.select("seg_id").distinct(), "seg_id", "left_semi"))
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.col("node_hi") - F.col("node_lo") - 1)).alias("i")
    parts = used.select("node_lo", "seq", i)
    piece = F.substring("seq", (F.col("i") * NODE_BP + 1).cast("int"), F.lit(NODE_BP))
    return parts.select((F.col("node_lo") + F.col("i")).alias("node_id"), piece.alias("seq"))


def order_graph(spark: SparkSession, sf_dir: str) -> PathGraph:
    """The graph of orders, with names: customers as samples, regions as contigs.

    Customers with a key that divides by 20 have plainly named paths, of the generic sample 0.
    """
    t = tables(spark, sf_dir)
    segment = segments(spark, sf_dir)
    lines = segment_visits(spark, sf_dir)
    visit = order_visits(lines, segment)
    home = large(t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").cast("long").alias("contig_id")))
    generic = F.col("o_custkey") % 20 == 0
    day = F.datediff(F.col("o_orderdate"), F.to_date(F.lit("1995-01-01"))).cast("long")
    path = t("orders").join(home, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("path_id"),
        F.when(generic, 0).otherwise(F.col("o_custkey")).cast("long").alias("sample_id"),
        "contig_id",
        F.when(generic, 0).otherwise(1 + F.col("o_orderkey") % 2).cast("long").alias("phase"),
        F.when(generic, 0).otherwise(day).cast("long").alias("fragment"),
    )
    walked = lines.join(segment.where("node_lo < node_hi"), "seg_id", "left_semi").select("path_id").distinct()
    path = path.join(walked, "path_id", "left_semi")
    key = F.col("c_custkey")
    sample = large(t("customer")).where((key % 20 != 0) | (key == 0)).select(
        key.alias("sample_id"), F.when(key == 0, GENERIC_SAMPLE).otherwise(F.concat(F.lit("c"), key.cast("string"))).alias("name")
    )
    contig = t("region").select(F.col("r_regionkey").cast("long").alias("contig_id"), F.col("r_name").alias("name"))
    tag = spark.createDataFrame([("index", "reference_samples", "c3 c7 c3 nobody c11 c20"), ("graph", "Source", "projection")], "scope string, key string, value string")
    return PathGraph(visit, nodes_of(segment, lines), segment, path, sample, contig, tag)


def event_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path_id, pos, g)``: events of a user over 40 nodes (type, and the property k in eight classes); large values are reverse."""
    e = tables(spark, sf_dir)("events")
    kind = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1
    k = F.get_json_object("props", "$.k").cast("long")
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("path_id"), pos.cast("long").alias("pos"), encode(1 + 8 * kind + k % 8, F.col("value") > 150).alias("g"))


def event_graph(spark: SparkSession, sf_dir: str) -> PathGraph:
    """Long, repetitive walks: node ``n`` has the first ``1 + n % 7`` letters of derived DNA."""
    visit = event_visits(spark, sf_dir)
    text = F.col("node_id").cast("string")
    seq = F.substring(F.translate(F.md5(F.concat(F.lit("e"), text)), "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(1), (1 + F.col("node_id") % 7).cast("int"))
    node = visit.select(F.shiftright("g", 1).alias("node_id")).distinct().select("node_id", seq.alias("seq"))
    return PathGraph(visit, node)

"""Reading graphs from GFA text, walks from lists of handles, and small files that go with text indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from walkframe.functions.handles import encode
from walkframe.functions.names import GENERIC_SAMPLE
from walkframe.model import PathGraph
from walkframe.operators.prefix import running_sum
from walkframe.sources.raw import read_numbers


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)``: lines of text in file order (numbers grow, with gaps between partitions)."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def dense(df: DataFrame, order: str, out: str) -> DataFrame:
    """Number rows from 0 in the order of a long column."""
    return running_sum(df.withColumn("_one", F.lit(1)), order, "_one", out, 1 << 33).drop("_one")


def read_gfa(spark: SparkSession, path: str, node_bp: int = 1024) -> PathGraph:
    """Segments, P and W lines of a GFA file as a graph.

    Segments with integer names are nodes of that id. Otherwise they are chopped
    into nodes of ``node_bp`` bases at most, numbered from 1 in file order, used or
    not. Paths are P lines and then W lines, in file order; P lines belong to the
    generic sample. Nodes that no path visits are not in the graph.
    """
    lines = numbered_lines(spark, path)
    part = F.split("value", "\t")
    field = lambda i: F.get(part, F.lit(i))
    s = lines.where(F.col("value").startswith("S\t")).select("line_no", field(1).alias("name"), field(2).alias("seq"))
    s = dense(s, "line_no", "seg_id").select("seg_id", "name", "seq")
    by_number = s.where(~F.col("name").rlike("^[1-9][0-9]*$")).isEmpty()
    if by_number:
        seg = s.select("seg_id", "name", "seq", F.col("name").cast("long").alias("node_lo"), (F.col("name").cast("long") + 1).alias("node_hi"))
        node = seg.select(F.col("node_lo").alias("node_id"), "seq")
    else:
        sized = s.withColumn("nn", F.greatest(F.lit(1), F.ceil(F.length("seq") / node_bp)).cast("long"))
        seg = running_sum(sized, "seg_id", "nn", "before").select(
            "seg_id", "name", "seq", (F.col("before") + 1).alias("node_lo"), (F.col("before") + 1 + F.col("nn")).alias("node_hi")
        )
        i = F.explode(F.expr("sequence(0L, node_hi - node_lo - 1)")).alias("i")
        node = seg.select("node_lo", "seq", i).select(
            (F.col("node_lo") + F.col("i")).alias("node_id"), F.substring("seq", (F.col("i") * node_bp + 1).cast("int"), F.lit(node_bp)).alias("seq")
        )
    p = lines.where(F.col("value").startswith("P\t")).select(
        F.lit(0).alias("kind"), "line_no", F.lit(GENERIC_SAMPLE).alias("sample"), field(1).alias("contig"), F.lit(0).cast("long").alias("phase"), F.lit(0).cast("long").alias("fragment"),
        F.transform(F.filter(F.split(field(2), ","), lambda x: x != ""), lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).alias("name"), x.endswith("-").alias("rev"))).alias("walk"),
    )
    w = lines.where(F.col("value").startswith("W\t")).select(
        F.lit(1).alias("kind"), "line_no", field(1).alias("sample"), field(3).alias("contig"), field(2).cast("long").alias("phase"), field(4).cast("long").alias("fragment"),
        F.transform(F.regexp_extract_all(field(6), F.lit("[<>][^<>]+"), F.lit(0)), lambda x: F.struct(F.substring(x, F.lit(2), F.length(x)).alias("name"), x.startswith("<").alias("rev"))).alias("walk"),
    )
    order = (F.col("kind").cast("long") * (1 << 62) + F.col("line_no")).alias("place")
    paths = dense(p.union(w).select(order, "sample", "contig", "phase", "fragment", "walk"), "place", "path_id").drop("place")
    names = lambda c: dense(paths.groupBy(c).agg(F.min("path_id").alias("at")).select(F.col(c).alias("name"), "at"), "at", f"{c}_id").drop("at")
    sample, contig = names("sample"), names("contig")
    path_table = (
        paths.join(sample.withColumnRenamed("name", "sample"), "sample")
        .join(contig.withColumnRenamed("name", "contig"), "contig")
        .select("path_id", "sample_id", "contig_id", "phase", "fragment")
    )
    steps = paths.select("path_id", F.posexplode("walk").alias("sv", "x")).select("path_id", F.col("sv").cast("long").alias("sv"), F.col("x.name").alias("name"), F.col("x.rev").alias("is_rev"))
    from walkframe.sources.projection import order_visits

    visit = order_visits(steps.join(seg.select("name", "seg_id"), "name").select("path_id", "sv", "seg_id", "is_rev"), seg)
    used = visit.select(F.shiftright("g", 1).alias("node_id")).distinct()
    header = lines.where(F.col("value").startswith("H\t")).select(F.explode(F.slice(part, F.lit(2), F.size(part))).alias("f"))
    refs = header.where(F.col("f").startswith("RS:Z:")).select(F.lit("index").alias("scope"), F.lit("reference_samples").alias("key"), F.expr("substring(f, 6)").alias("value"))
    return PathGraph(
        visit, node.join(used, "node_id", "left_semi"), None if by_number else seg, path_table,
        sample.select("sample_id", "name"), contig.select("contig_id", "name"), refs,
    )


def read_walks(spark: SparkSession, path: str) -> DataFrame:
    """``(path_id, handles)``: one walk a line, handles separated by commas; an empty line is an empty walk."""
    lines = dense(numbered_lines(spark, path), "line_no", "path_id")
    handles = F.transform(F.filter(F.split("value", ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))
    return lines.select("path_id", handles.alias("handles"))


def visits_of_walks(walks: DataFrame) -> DataFrame:
    return walks.select("path_id", F.posexplode("handles").alias("pos", "g")).select("path_id", F.col("pos").cast("long").alias("pos"), "g")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """``(path_id, bp, offset)`` of a names file: tab-separated, the length last; each path is followed by one end."""
    schema = "path_id long, sample string, contig string, phase long, fragment long, bp long"
    rows = spark.read.csv(path, schema, sep="\t")
    from walkframe.operators.positions import text_offsets

    return text_offsets(rows.select("path_id", "bp"))


def read_suffix_array(spark: SparkSession, path: str, skip: int = 1) -> DataFrame:
    """``(rank, text_offset)``: little-endian 64-bit integers, the first ``skip`` left out; tasks read ranges of bytes."""
    return read_numbers(spark, path, skip=skip).select(F.col("at").alias("rank"), F.col("value").alias("text_offset"))


def read_bwt(spark: SparkSession, path: str, skip: int = 1) -> DataFrame:
    """``(rank, symbol)``: one byte a suffix, the first ``skip`` left out."""
    return read_numbers(spark, path, width=1, skip=skip).select(F.col("at").alias("rank"), F.col("value").alias("symbol"))

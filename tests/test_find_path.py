"""A name that very many paths have is looked up once, not by all of its paths for each query."""

from pyspark.sql import functions as F

from walkframe.model import PathGraph
from walkframe.operators import metadata


def test_one_name_for_all(spark):
    n = 200_000
    path = spark.range(n).select(F.col("id").alias("path_id"), *[F.lit(0).cast("long").alias(c) for c in ("sample_id", "contig_id", "phase", "fragment")])
    sample = spark.createDataFrame([(0, "s"), (1, "t")], "sample_id long, name string")
    contig = spark.createDataFrame([(0, "c")], "contig_id long, name string")
    graph = PathGraph(path, path, None, path, sample, contig)
    asked = path.select(F.col("path_id").alias("query_id"), F.when(F.col("path_id") == 7, "t").otherwise("s").alias("sample"), F.lit("c").alias("contig"), "phase", "fragment")
    got = metadata.find_path(graph, asked).groupBy("path_id").agg(F.count("*").alias("n")).collect()
    assert {r.path_id: r.n for r in got} == {0: n - 1, None: 1}

"""Walks that keep arriving: running counts of subpaths over a folder of walk files.

Each line of a file is a walk of comma-separated handles. Counts are a stateful
aggregation, so every batch costs what is new; both orientations are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from walkframe.functions.handles import reverse_path


def arriving_walks(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of ``(handles)``, one row a walk."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(folder)
    handles = F.transform(F.filter(F.split("value", ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))
    return lines.select(handles.alias("handles"))


def subpath_counts(walks: DataFrame, k: int) -> DataFrame:
    """``(pattern, n)``: occurrences of every subpath of ``k`` handles so far, for the update or complete mode."""
    n = F.size("handles") - k + 1
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    grams = walks.select(F.explode(F.transform(starts, lambda i: F.slice("handles", i, k))).alias("gram"))
    both = grams.select(F.explode(F.array("gram", reverse_path("gram"))).alias("pattern"))
    return both.groupBy("pattern").agg(F.count("*").alias("n"))

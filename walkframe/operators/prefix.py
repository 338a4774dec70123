"""Running sums over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W


def large(table: DataFrame) -> DataFrame:
    """The same rows, never broadcast by the joins right above: for tables that Spark takes for far smaller than they are.

    An exploded table counts as large as the one before, a semi-join as its left side, so a guess below the broadcast
    threshold says nothing of what would go through the driver. Selections and groupings keep the mark, joins drop it.
    """
    return table.hint("merge")


def running_sum(df: DataFrame, order: str, value: str, out: str, width: int = 1 << 16) -> DataFrame:
    """Add ``out``: the sum of ``value`` over rows with a smaller ``order`` (a long, no two equal).

    Rows are cut in ranges of ``width``; each range sums apart, and only the sums
    of ranges (one row for ``width`` values of ``order``) go through one task.
    """
    part = F.floor(F.col(order) / width)
    rows = df.withColumn("_part", part)
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_part", before.alias("_before"))
    inside = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    total = F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    # the window needs rows by range anyway
    return large(rows).join(sums, "_part").withColumn(out, total.cast("long")).drop("_part", "_before")

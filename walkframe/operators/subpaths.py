"""Distinct subpaths of every length at once, and how far neighbouring visits agree.

In the order of visits, those that end the same subpath are next to each other. So a visit begins a new
subpath of length k unless it agrees with the one before over k handles, and the number of distinct subpaths of all
lengths follows from the common lengths of neighbours. These are read from the ranks that
prefix doubling leaves: two visits agree over 2^r handles if their ranks of round r are equal, so from the longest
step down each round's ranks decide one bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from walkframe.operators.order import doubling_rounds
from walkframe.operators.prefix import running_sum
from walkframe.session import stored


def common_lengths(seqs: DataFrame) -> DataFrame:
    """``(seq_id, pos, g, common)`` of every visit: over how many handles, backwards from its own, it agrees with the visit before it in order; 0 for the first of a handle."""
    rounds = doubling_rounds(seqs)
    last = rounds[-1].where("pos >= 0")
    other = last.select((F.col("rank") + 1).alias("rank"), "g", F.col("seq_id").alias("other_id"), F.col("pos").alias("other_pos"))
    zero = F.lit(0).cast("long")
    pairs = last.join(other, ["rank", "g"], "left").select("seq_id", "pos", "g", "other_id", "other_pos", zero.alias("common"))
    alone, pairs = pairs.where("other_id is null"), stored(pairs.where("other_id is not null"))
    for r in reversed(range(len(rounds) - 1)):
        here = rounds[r].select("seq_id", F.col("pos").alias("at"), F.col("rank").alias("here"))
        there = rounds[r].select(F.col("seq_id").alias("other_id"), F.col("pos").alias("other_at"), F.col("rank").alias("there"))
        placed = pairs.withColumn("at", F.col("pos") - F.col("common")).withColumn("other_at", F.col("other_pos") - F.col("common"))
        found = placed.join(here, ["seq_id", "at"], "left").join(there, ["other_id", "other_at"], "left")
        # ranks are unique for each end of a sequence, so equal ones agree over real handles only
        more = F.when(F.col("here") == F.col("there"), F.lit(1 << r)).otherwise(0)
        pairs = stored(found.select("seq_id", "pos", "g", "other_id", "other_pos", (F.col("common") + more).cast("long").alias("common")))
    both = pairs.select("seq_id", "pos", "g", "common")
    return both.union(alone.select("seq_id", "pos", "g", "common"))


def distinct_subpaths(seqs: DataFrame) -> DataFrame:
    """``(k, n)``: how many distinct subpaths of ``k`` handles there are, for every length up to the longest walk.

    A visit adds one to each length from its common length + 1 to the number of handles up to it.
    """
    common = common_lengths(seqs)
    change = F.explode(F.array(F.struct((F.col("common") + 1).alias("k"), F.lit(1).alias("d")), F.struct((F.col("pos") + 2).alias("k"), F.lit(-1).alias("d")))).alias("c")
    changes = stored(common.select(change).groupBy(F.col("c.k").alias("k")).agg(F.sum("c.d").alias("d")))
    longest = changes.agg(F.max("k")).first()[0]
    lengths = changes.sparkSession.range(1, longest or 1).withColumnRenamed("id", "k")
    steps = lengths.join(changes, "k", "left").select("k", F.coalesce("d", F.lit(0)).alias("d"))
    return running_sum(steps, "k", "d", "before").select("k", (F.col("before") + F.col("d")).alias("n"))

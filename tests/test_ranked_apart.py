"""Ranks of keys that all differ, without a table of keys."""

import random

from pyspark.sql import functions as F

from walkframe.operators import order


def test_same_ranks(spark):
    rng = random.Random(14)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 9))), i % 50) for i in range(3000)]
    table = spark.createDataFrame(rows, "at long, suffix string, path_id long").select("at", F.struct("suffix", "path_id", "at").alias("key")).repartition(7)
    got = order.ranked_apart(table)
    assert got.columns == ["at", "rank"]
    found = {r.at: r.rank for r in got.collect()}
    assert found == {r.at: r.rank for r in order.ranked(table).collect()}
    assert [i for i, _ in sorted(found.items(), key=lambda x: x[1])] == [i for i, *_ in sorted(rows, key=lambda r: (r[1], r[2], r[0]))]

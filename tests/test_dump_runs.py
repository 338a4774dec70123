"""The dump is written from runs of visits, in order, without a place for each visit."""

import random

import pytest
from pyspark.sql import functions as F

from walkframe.plans import catalog
from walkframe.sources import gfa, raw, sinks


def slow(walks, seq, end):
    flip = str.maketrans("ACGT", "TGCA")
    other = lambda s: "".join(x if x in "ACGT" else "N" for x in s.upper()).translate(flip)[::-1]
    return "".join("".join(other(seq[g // 2]) if g % 2 else seq[g // 2] for g in w) + end for _, w in sorted(walks.items())).encode()


@pytest.mark.parametrize("width", [1, 3, 64])
def test_dump(spark, tmp_path, width):
    rng = random.Random(width)
    seq = {n: "".join(rng.choice("ACGTacgtR") for _ in range(rng.randint(0, 5))) for n in range(1, 40)}
    walks = {}
    for p in range(50):
        w = []
        for _ in range(rng.randint(0, 6)):
            i, r = rng.randint(1, 39), rng.randint(0, 1)
            run = [2 * n + r for n in range(i, min(40, i + rng.randint(1, 9)))]
            w += run[::-1] if r else run
        walks[3 * p] = w
    visit = spark.createDataFrame([(p, i, g) for p, w in walks.items() for i, g in enumerate(w)], "path_id long, pos long, g long").repartition(3)
    path = spark.createDataFrame([(p,) for p in walks if p != 9], "path_id long")
    graph = gfa.PathGraph(visit, spark.createDataFrame(list(seq.items()), "node_id long, seq string").repartition(2), path=path)
    some = path.where("path_id % 2 = 0")
    for paths, want in ((None, {p: w for p, w in walks.items() if p != 9}), (some, {p: w for p, w in walks.items() if p % 2 == 0})):
        rows = sorted(map(tuple, sinks.dump_runs(graph, paths, "$", width).collect()))
        assert b"".join(bytes(x) for *_, x in rows) == slow(want, seq, "$")
        sinks.write_dump(graph, out := str(tmp_path / f"{paths is None}-{width}"), paths, "$")
        got = raw.read_blocks(spark, out, block=64).orderBy("at").collect()
        assert b"".join(bytes(r.data) for r in got) == slow(want, seq, "$")


def test_runs_are_dealt(spark, data):
    g = catalog.order_graph(spark, data)
    n = sinks.dump_runs(g, end="$").where(F.octet_length("data") > 0).count()
    # fewer pieces than visits and ends
    assert n < g.visit.count()

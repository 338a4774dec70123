"""Walks taken to their segments in pieces: runs are cut at segments and ranges, and joined again; links and lines come from them."""

import random
import re

import pytest
from test_chains import slow_walk

from walkframe.model import PathGraph
from walkframe.operators import segments
from walkframe.plans import catalog
from walkframe.sources import sinks


def made(spark, seed):
    """Segments with gaps, some of one node, some over ranges of ids; walks over whole ones, with jumps, turns and doubled steps."""
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(1, 60), 18))
    table = [(i, f"s{i}", "ACGT"[: 1 + i % 4], lo, hi) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if i % 7 != 4]
    walks = {}
    for p in range(60):
        w = []
        for _ in range(rng.randint(1, 12)):
            i = rng.randrange(len(table))
            r = rng.randint(0, 1)
            # as a rule over neighbours, so that runs go over several segments
            run = [2 * n + r for _, _, _, lo, hi in table[i : i + rng.randint(1, 3)] for n in range(lo, hi)]
            w += run[::-1] if r else run
        if p % 3:
            i = rng.randrange(len(w))
            w = [w[i:], w[:i] + w[i : i + 1] * 2 + w[i + 1 :], w[: i + 1] + [2 * rng.randint(1, 59)] + w[i + 1 :]][p // 3 % 3]
        walks[p] = w
    visit = spark.createDataFrame([(p, i, g) for p, w in walks.items() for i, g in enumerate(w)], "path_id long, pos long, g long")
    return walks, table, visit, spark.createDataFrame(table, "seg_id long, name string, seq string, node_lo long, node_hi long")


@pytest.mark.parametrize("width", [1, 7, 1 << 10])
def test_pieces_are_the_visits(spark, width):
    walks, table, visit, segment = made(spark, width)
    of = {n: (i, lo, hi) for i, _, _, lo, hi in table for n in range(lo, hi)}
    got = {}
    for r in segments.segment_pieces(visit.repartition(3), segment, (), width).collect():
        whole = r.seg_id is not None and r.n is None
        for i in range(r.len):
            got[r.path_id, r.pos + i] = (r.seg_id, r.is_rev) if r.seg_id is None else (r.seg_id, r.is_rev, (r["index"] or 0) + i, r.len if whole else r.n)
    for p, w in walks.items():
        for pos, g in enumerate(w):
            want = (None, g % 2 == 1)
            if g // 2 in of:
                i, lo, hi = of[g // 2]
                want = (i, g % 2 == 1, hi - 1 - g // 2 if g % 2 else g // 2 - lo, hi - lo)
            assert got.pop((p, pos)) == want
    assert not got


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_lines(spark, seed):
    walks, table, visit, segment = made(spark, seed)
    path = spark.createDataFrame([(p, p % 3, 0, p % 2, p) for p in walks], "path_id long, sample_id long, contig_id long, phase long, fragment long")
    sample, contig = spark.createDataFrame([(0, "_gbwt_ref"), (1, "one")], "sample_id long, name string"), spark.createDataFrame([(0, "c")], "contig_id long, name string")
    tag = spark.createDataFrame([], "scope string, key string, value string")
    seen = {g // 2 for w in walks.values() for g in w}
    node = spark.createDataFrame([(n, "A") for n in sorted(seen)], "node_id long, seq string")
    graph = PathGraph(visit, node, segment, path, sample, contig, tag)
    for mode in ("default", "pan-sn", "ref-only"):
        got = [(r.part, r.a, r.b, r.line) for r in sinks.gfa(graph, mode).collect()]
        parts = {1: sinks.gfa_segments(graph), 2: sinks.gfa_links(graph)}
        if mode == "pan-sn":
            parts[3] = sinks.gfa_pansn(graph)
        else:
            parts[3] = sinks.gfa_paths(graph)
        if mode == "default":
            parts[4] = sinks.gfa_walks(graph)
        for n, lines in parts.items():
            assert sorted(line for part, _, _, line in got if part == n) == sorted(r.line for r in lines.collect())
    of = {n: (i, lo, hi) for i, _, _, lo, hi in table for n in range(lo, hi)}
    assert sorted(map(tuple, segments.segment_paths_exact(visit, segment).collect())) == sorted((p, i, s, r) for p, w in walks.items() for i, (s, r) in enumerate(slow_walk(w, of)))


def test_visits_are_shuffled_in_runs(spark, data):
    # visits are neither joined nor dealt one by one, and links and lines share a shuffle
    plan = catalog.QUERIES["gfa_default"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.findall(r"explode\(sequence\(0, ?\(?nn", plan) and "next_g" in plan
    assert plan.count("MapInArrow lined") == plan.count("MapInArrow links_entered") == 1

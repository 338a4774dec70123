"""Chains over blocks, segment walks and reference positions against loops."""

import random

import pytest
from pyspark.sql import functions as F

from walkframe.operators import chains, positions, segments


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_chain(spark, block):
    rng = random.Random(2)
    walks = {w: [rng.choice([None, i + 1, i + 1, i + 2, i + rng.randint(1, 15)]) if rng.random() < 0.8 else i + 1 for i in range(rng.choice([1, 3, 4, 5, 60, 90]))] for w in range(25)}
    walks[99] = [i + 1 for i in range(70)]
    data = [(w, i, n) for w, ns in walks.items() for i, n in enumerate(ns)]
    rng.shuffle(data)
    want = []
    for w, ns in walks.items():
        at, nth = 0, 0
        while at is not None and at < len(ns):
            want.append((w, at, nth))
            at, nth = ns[at], nth + 1
    got = chains.chain(spark.createDataFrame(data, "walk long, pos long, next long"), block)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert chains.chain(spark.createDataFrame([], "walk long, pos long, next long"), block).count() == 0


def slow_walk(visits, of):
    """A state machine over one walk."""
    expected, found = [], []
    for g in visits:
        node, rev = g // 2, g % 2
        if expected:
            if expected.pop(0) != (node, rev):
                break
        elif node in of:
            seg, lo, hi = of[node]
            found.append((seg, bool(rev)))
            nodes = range(lo, hi)
            expected = [(n, rev) for n in (nodes[::-1] if rev else nodes)][1:]
        else:
            break
    return found


@pytest.mark.parametrize("block", [5, 1 << 16])
def test_segment_walks(spark, block):
    rng = random.Random(4)
    cuts = [1, 2, 5, 6, 10, 17, 18, 19]
    table = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if i != 4]
    of = {n: s for s in table for n in range(s[1], s[2])}
    walks = {}
    for p in range(40):
        w = []
        for _ in range(rng.randint(1, 9)):
            _, lo, hi = rng.choice(table)
            r = rng.randint(0, 1)
            run = [2 * n + r for n in range(lo, hi)]
            w += run[::-1] if r else run
        if p % 2:
            i = rng.randrange(len(w))  # entered in the middle, cut, doubled or off
            w = [w[i:], w[: i + 1], w[:i] + w[i : i + 1] * 2 + w[i + 1 :], w[:i] + [2 * rng.randint(1, 30)] + w[i + 1 :]][p // 2 % 4]
        walks[p] = w
    visit = spark.createDataFrame([(p, i, g) for p, w in walks.items() for i, g in enumerate(w)], "path_id long, pos long, g long")
    segment = spark.createDataFrame(table, "seg_id long, node_lo long, node_hi long")
    got = segments.segment_paths_exact(visit, segment, block)
    assert sorted(map(tuple, got.collect())) == sorted((p, i, s, r) for p, w in walks.items() for i, (s, r) in enumerate(slow_walk(w, of)))


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_segments_of_nodes(spark, width):
    segment = spark.createDataFrame([(0, 1, 4), (1, 4, 5), (2, 9, 10**9), (3, 10**9 + 5, 10**9 + 6)], "seg_id long, node_lo long, node_hi long")
    asked = [0, 1, 3, 4, 5, 8, 9, 700, 10**9 - 1, 10**9, 10**9 + 5, 10**9 + 6]
    nodes = spark.createDataFrame([(n,) for n in [*asked, *asked]], "node_id long")
    got = {r.node_id: r.seg_id for r in segments.segment_of_nodes(segment, nodes, width).collect()}
    assert got == {1: 0, 3: 0, 4: 1, 9: 2, 700: 2, 10**9 - 1: 2, 10**9 + 5: 3}


@pytest.mark.parametrize(("width", "block"), [(1, 4), (1 << 16, 1 << 16)])
def test_reference_positions(spark, width, block):
    rng = random.Random(6)
    rows, walks = [], {}
    for p in range(12):
        at = 0
        for i in range(rng.choice([1, 2, 30, 60])):
            rows.append((p, i, at))
            walks.setdefault(p, []).append(at)
            at += rng.choice([0, 1, 1, 2, 7, 40])
    offsets = spark.createDataFrame(rows, "path_id long, pos long, offset long")
    for interval in (0, 1, 5, 30):
        want = []
        for p, w in walks.items():
            due = 0
            for i, o in enumerate(w):
                if o >= due:
                    want.append((p, i, o))
                    due = o + interval
        assert sorted(map(tuple, positions.reference_positions(offsets, interval, width, block).collect())) == sorted(want)


def test_header_fields_are_all_read(spark, tmp_path):
    from walkframe.sources.gfa import read_gfa

    (tmp_path / "x.gfa").write_text("H\t" + "\t".join(f"xx:i:{i}" for i in range(1500)) + "\tRS:Z:donor\nS\t1\tA\nP\tq\t1+\t*\n")
    tags = read_gfa(spark, str(tmp_path / "x.gfa")).tag
    assert [r.value for r in tags.where(F.col("key") == "reference_samples").collect()] == ["donor"]

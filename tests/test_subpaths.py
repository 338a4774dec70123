"""Distinct subpaths of every length, components that grow and are numbered, handles drawn alike: against loops."""

import random

import pytest

from walkframe.operators import components, contigs, navigation, search, subpaths


@pytest.fixture(scope="module")
def visit(spark):
    rng = random.Random(12)
    walks = [[2 * rng.choice([1, 1, 2, 3]) + rng.randint(0, 1) for _ in range(rng.randint(1, 30))] for _ in range(8)]
    walks += [walks[3], walks[4][2:9], [2] * 21]
    return spark.createDataFrame([(p, i, g) for p, w in enumerate(walks) for i, g in enumerate(w)], "path_id long, pos long, g long")


@pytest.fixture(scope="module")
def walks(visit):
    found = {}
    for r in sorted(visit.collect()):
        found.setdefault(r.path_id, []).append(r.g)
    one_way = list(found.values())
    return one_way + [[g ^ 1 for g in reversed(w)] for w in one_way]


def test_every_length(visit, walks):
    want = {k: len({tuple(w[i : i + k]) for w in walks for i in range(len(w) - k + 1)}) for k in range(1, max(map(len, walks)) + 1)}
    assert {r.k: r.n for r in subpaths.distinct_subpaths(navigation.bidirectional(visit)).collect()} == want


def test_handles_are_drawn_alike(visit, walks):
    got = {tuple(r.pattern): r.query_id for r in search.sample_by_node(visit, 3, digits=0).collect()}
    assert len({p[0] for p in got}) == len(got) <= len({g for w in walks for g in w})
    assert all(any(tuple(w[i : i + 3]) == p for w in walks for i in range(len(w))) for p in got)
    assert got == {tuple(r.pattern): r.query_id for r in search.sample_by_node(visit, 3, digits=0).collect()}


def test_components_grow(spark):
    rng = random.Random(13)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(90, 91), (91, 90), (92, 92), (None, 5)]
    rng.shuffle(edges)
    schema = "src long, dst long"
    whole = {r.node: r.component for r in components.connected_components(spark.createDataFrame([e for e in edges if e[0] != e[1]], schema)).collect()}
    labels = components.connected_components(spark.createDataFrame(edges[:15], schema))
    for part in (edges[15:16], edges[16:40], edges[40:]):
        labels = components.cut(components.join_components(labels, spark.createDataFrame(part, schema)))
    got = {r.node: r.component for r in labels.collect()}
    assert {n: c for n, c in got.items() if n in whole} == whole and all(c == n for n, c in got.items() if n not in whole)
    assert sorted(got) == sorted({n for e in edges for n in e if n is not None} | set(whole)) or set(whole) <= set(got)


def test_numbered(spark):
    rows = [(7, 7), (7, 9), (2, 2), (2, 30), (2, 4), (8, 8)]
    got = contigs.numbered_components(spark.createDataFrame(rows, "component long, node_id long"))
    assert sorted(map(tuple, got.collect())) == [(0, 0, 2), (0, 1, 4), (0, 2, 30), (1, 0, 7), (1, 1, 9), (2, 0, 8)]

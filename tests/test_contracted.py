"""Components by contraction: whole in every form of graph, without a second pass over walks."""

import random
import re

import pytest

from walkframe.operators import components
from walkframe.plans import catalog


def by_union(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("chunk", [1 << 18, 2])
def test_equal_to_union(spark, monkeypatch, chunk):
    # a chunk of two edges keeps the last round from doing it all
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(3)
    line = [(i + 1, i) for i in range(40)]
    some = [(rng.randint(100, 220), rng.randint(100, 220)) for _ in range(80)]
    edges = [*line, *some, *some[:9], (-9, 5), (2**40, -(2**50)), (300, 300), (None, 301), (302, None)]
    got = components.contracted_components(spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == by_union(edges)


@pytest.mark.parametrize("name", ["components", "components_in_batches"])
def test_walks_are_read_once(spark, data, name):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    # what is left to do reads what the rounds have written
    assert not re.findall(r"Relation \[[^\]]*(?:l_orderkey|p_partkey)", plan)

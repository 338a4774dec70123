"""Edges and their mirror images are found in one pass over walks, and nodes without one over visits."""

import random
import re
from collections import Counter

from walkframe.operators import navigation
from walkframe.plans import catalog


def test_both_sides(spark):
    rng = random.Random(22)
    walks = {i: [2 * rng.randint(1, 4) + rng.randint(0, 1) for _ in range(rng.randint(1, 12))] for i in range(60)}
    visit = spark.createDataFrame([(i, pos, g) for i, w in walks.items() for pos, g in enumerate(w)], "path_id long, pos long, g long").repartition(5)
    n = Counter()
    for w in walks.values():
        for way in (w, [g ^ 1 for g in reversed(w)]):
            n.update(zip(way, [*way[1:], 0]))
    assert any(b and a == b ^ 1 for a, b in n)
    assert sorted(map(tuple, navigation.edge_counts(visit).collect())) == sorted((a, b, k) for (a, b), k in n.items())
    assert sorted(map(tuple, navigation.edges(visit).collect())) == sorted(e for e in n if e[1])


def reads(spark, data, name, table):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(rf"Relation \[[^\]]*{table}", plan))


def test_one_pass(spark, data):
    assert reads(spark, data, "predecessors", "l_orderkey") == 1
    assert reads(spark, data, "edge_multiplicity", "l_orderkey") == 1


def test_nodes_without_visits(spark, data):
    plan = catalog.QUERIES["node_scan"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    # the only table taken apart is that of segments
    assert "is_rev" not in plan and plan.count("Generate explode(sequence") == 1


def test_customers_are_not_broadcast(spark, data):
    plan = catalog.QUERIES["record_len"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"BroadcastHashJoin \[[^\]]*custkey", plan)

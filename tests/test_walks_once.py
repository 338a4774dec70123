"""Segment walks: the lookup of nodes stays out of broadcasts, and walks of one block are done in one pass."""

import re

import pytest
from pyspark.sql import functions as F
from oracle import assert_same

from walkframe.operators import segments
from walkframe.plans import catalog
from walkframe.sources.projection import order_graph


def test_lookup_is_not_broadcast(spark, data):
    g = order_graph(spark, data)
    at = g.visit.withColumn("node_id", F.shiftright("g", 1)).join(segments.segment_of_nodes(g.segment, g.node, distinct=True), "node_id", "left")
    plan = at._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"BroadcastHashJoin \[node_id", plan)


@pytest.mark.parametrize("name", ["segment_paths_exact"])
def test_no_chain_over_blocks(spark, data, name, monkeypatch):
    def chain(pointers, block):
        raise AssertionError("a chain over blocks")

    monkeypatch.setattr(segments, "chain", chain)
    assert assert_same(catalog.QUERIES[name](spark, data), catalog.ORACLE_SQL[name], data) > 0

"""Tables that Spark takes for small, because it doesn't count what explode makes, stay out of broadcasts."""

import re

import pytest

from walkframe.plans import catalog

QUERIES = "fragment_names path_lengths path_offsets path_dna names_lines text_offsets unused_nodes node_order used_segments segment_sequences segment_links segment_predecessors gfa_segments gfa_links node_to_segment".split()


@pytest.mark.parametrize("name", QUERIES)
def test_no_broadcast_of_segments_and_nodes(spark, data, name):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    keys = {k for found in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan) for k in re.findall(r"[A-Za-z_]+", found)}
    assert not keys & {"seg_id", "node_id", "node_lo", "sample_id", "g", "next_g", "part", "_part"}

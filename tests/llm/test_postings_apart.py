"""Source divergence: what a packed index is taken apart to stays out of broadcasts, few languages and sources or many."""

import pytest
from test_audit_search_dedup import slow_divergence

from walkframe.llm import divergence


def broadcasts(plan):
    """The lines below each broadcast."""
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i + 1 : end])


@pytest.mark.parametrize("small", [0, divergence.SMALL])
def test_no_broadcast_of_postings(spark, small):
    texts = [(i, f"one {source} {lang} one two", lang, source) for lang in ("a", "b") for source in ("x", "y", "z") for i in range(3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    got = divergence.source_divergence(docs, 2, 5, small)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in broadcasts(plan) if "Generate" in x]
    assert ("BroadcastHashJoin [lang" in plan) == bool(small)
    assert sorted(map(tuple, got.collect())) == slow_divergence(texts, 2, 5)

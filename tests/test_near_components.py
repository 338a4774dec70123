"""Edges of near ids: done within tasks, so that next to nothing goes into rounds."""

import random

import pyarrow as pa
from test_contracted import by_union

from walkframe.operators import components


def test_chunks_of_a_task():
    rng = random.Random(7)
    edges = sorted((rng.randint(0, 60), rng.randint(0, 60)) for _ in range(50))
    batches = [pa.RecordBatch.from_pydict({"u": [a for a, _ in part], "v": [b for _, b in part]}) for part in (edges[:23], [], edges[23:24], edges[24:])]
    got = [(b.num_rows, dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))) for b in components.labelled(batches, 10)]
    assert [labels for _, labels in got] == [by_union(edges[i : i + 10]) for i in range(0, 50, 10)]


def test_no_rounds_where_ids_follow_walks(spark, monkeypatch):
    monkeypatch.setattr(components, "CHUNK", 500)

    def pointed(e, turn):
        raise AssertionError("a round over edges")

    monkeypatch.setattr(components, "pointed", pointed)
    rng = random.Random(8)
    # ten long lines, and edges within them
    edges = [(1000 * k + i, 1000 * k + i + 1) for k in range(10) for i in range(300)]
    edges += [(1000 * k + rng.randint(0, 300), 1000 * k + rng.randint(0, 300)) for k in range(10) for _ in range(100)]
    got = components.contracted_components(spark.createDataFrame(edges, "src long, dst long").repartition(5)).collect()
    assert {r.node: r.component for r in got} == by_union(edges) and len(got) == 3010

"""Vectors in many small blocks, large scores, and blocks that aren't compared."""

import numpy as np
import pytest

from walkframe.llm import vectors


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 12)) * rng.uniform(0.2, 3, (40, 1))
    x = np.concatenate([c + 0.08 * rng.standard_normal((15, 12)) for c in centres])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_links_of_blocks(clustered, monkeypatch):
    x, df = clustered
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r for r in vectors.cosine_components(df, block=32).collect()}
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    label = vectors.roots(len(x), *np.nonzero(u @ u.T >= 0.9))
    assert [got[i].component_id for i in range(len(x))] == label.tolist()


def test_top_of_blocks(clustered, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 16)
    monkeypatch.setattr(vectors, "GROUP", 40)
    monkeypatch.setattr(vectors, "HEAD", 50)
    x, df = clustered
    z = np.floor(1024 * x).astype(int)
    got = vectors.top_inner_products(df, every=7, k=5).collect()
    want = {(q, n + 1): (i, s) for q in range(0, len(x), 7) for n, (s, i) in enumerate((-s, i) for s, i in sorted((-int(z[q] @ z[j]), j) for j in range(len(x)) if j != q)[:5])}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == want


def test_scores_beyond_doubles(spark):
    big = float(1 << 20)
    rows = [(0, [big, 0.5, 1 / 1024]), (1, [big, 0.5, 1 / 1024]), (2, [big, 0.5, 2 / 1024]), (3, [-big, 0.0, 0.0]), (4, [0.0, 0.0, 0.0])]
    got = vectors.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).collect()
    z = [[int(1024 * v) for v in x] for _, x in rows]
    want = sorted((-sum(a * b for a, b in zip(z[0], z[i])), i) for i in range(1, 5))
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(i, -s) for s, i in want]
    rows.append((5, [1e30, 0.0, 0.0]))
    with pytest.raises(Exception, match="more than 64 bits"):
        vectors.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()

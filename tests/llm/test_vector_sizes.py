"""Vectors of several sizes: each compares with all of its own size."""

import numpy as np

from walkframe.llm import vectors


def table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(size).astype(np.float32)) for size, ids in ((8, range(0, 30)), (5, range(30, 50))) for i in ids]
    rows[33] = (33, rows[40][1])
    rows[44] = (44, rows[40][1] * np.float32(1.5))
    return rows, spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>")


def test_cosine_of_each_size(spark):
    _, df = table(spark)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.cosine_components(df, threshold=0.999).collect()}
    want = {i: (0, i, True) for i in range(50)} | {33: (2, 33, True), 40: (2, 33, False), 44: (2, 33, False)}
    assert got == want


def test_top_k_of_each_size(spark):
    rows, df = table(spark)
    q = {i: np.floor(1024 * v.astype(np.float64)).astype(np.int64) for i, v in rows}
    want = []
    for i in range(0, 50, 10):
        score = {j: int(q[i] @ v) for j, v in q.items() if j != i and len(v) == len(q[i])}
        want += [(i, n + 1, j, score[j]) for n, j in enumerate(sorted(score, key=lambda j: (-score[j], j))[:10])]
    got = vectors.top_inner_products(df, every=10)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == sorted(want)

"""Scores of the classifiers: offsets, votes by hand, and the sample that they learn from."""

import math

import numpy as np

from walkframe.llm import quality, toxicity

TAGGER = toxicity.Tagger({"idiot$": 6.0}, -4.0, -4.0, ((0.0, 0.0), (0.0, 0.0)), (-3.0, 6.0, 0.0))


def test_offsets_where_lower_case_is_longer():
    text = "İstanbul what an IDİOT or idiot here"
    _, spans = toxicity.score_text(TAGGER, text, toxicity.Weights(TAGGER))
    assert [text[s:e] for s, e, _ in spans] == ["idiot"]
    _, spans = toxicity.score_text(TAGGER, "İ idiot", toxicity.Weights(TAGGER))
    assert [(s, e) for s, e, _ in spans] == [(2, 7)]


def test_scores_and_spans_of_rows(spark):
    docs = spark.createDataFrame([(1, "an idiot"), (2, None), (None, "x " * 50_000 + "idiot"), (1, "an idiot")], "doc_id long, text string")
    got = toxicity.toxicity_scores(docs, TAGGER).collect()
    assert sorted(len(r.spans) for r in got) == [0, 1, 1, 1]
    assert toxicity.without_toxic(docs, TAGGER).count() == 1
    assert {r.score for r in got} == {toxicity.score_text(TAGGER, t or "", toxicity.Weights(TAGGER))[0] for (_, t) in docs.collect()}


def test_vote_by_hand():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice(list(b"abc .,XY9"), 60)) for _ in range(60)]
    texts[10:20] = [texts[0]] * 10  # ties: equal neighbours with different labels
    voter = quality.fit([(t, i % 2) for i, t in enumerate(texts)], dimensions=8)
    asked = texts[:12] + [bytes(rng.choice(list(b"abc .,XY9"), 200)) for _ in range(20)] + [b"", b"a"]
    got = quality.vote(voter, np.stack([quality.histogram(t) for t in asked]))
    for t, score in zip(asked, got):
        e = quality.embed(quality.histogram(t)[None], voter.idf, voter.directions)[0].astype(float)
        if not e.any():
            assert score == voter.base
            continue
        near = sorted((-round(float(np.dot(e, v.astype(float))), 6), i) for i, v in enumerate(voter.vectors))[: quality.NEIGHBOURS]
        w = [math.exp(12 * (near[0][0] - c)) for c, _ in near]
        assert abs(score - sum(x * voter.votes[i] for x, (_, i) in zip(w, near)) / sum(w)) < 1e-4


def test_sample_is_bounded_by_rows_and_bytes_not_by_length(spark):
    docs = spark.createDataFrame([(i, "w" * (50_000 if i == 1 else 10)) for i in range(200)] + [(1, "again")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows = toxicity.bounded_sample(docs, labels, "toxic", 4, 2, True, 40).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 80 and sum(r.y for r in rows) == 40
    everything = toxicity.bounded_sample(docs, labels, "toxic", 4, 2, True, 200).collect()
    assert {r.text for r in everything if r.doc_id == 1} <= {"again"}  # rows of one id are one document
    few = toxicity.bounded_sample(docs, labels, "toxic", 4, 2, True, 200, size=400).collect()
    assert sum(len(r.text) for r in few) <= 400 and {r.y for r in few} == {0, 1}

"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from walkframe.llm import bpe, html, mixing, pii, quality, simhash, substrings, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, `row` string, key string, part string, draw string, rep string, component string, block string, grp string, taken string, hits string, `new` string, score string, at string, rank string"
LONG = "word number one two three " * 12_000
TEXTS = [
    (1, "a b c d e f g", "src0"), (2, None, "src0"), (3, "", "src1"), (4, " \t\n ", None), (5, LONG, "src1"), (5, LONG, "src1"),
    (7, "a b c d e f g", None), (None, "a b c d e f g", "src2"), (9, "mail me at a.b@corp.org now", "src2"), (10, "x", "src2"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["clash"] * 16) for i, t, s in TEXTS], DOCS)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_mixing(docs, nothing):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS) and mixing.mix(nothing).count() == 0
    assert all(r.taken <= 2 * r["size"] for r in got)
    for s in {r.source for r in got}:
        rows = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and mixing.mixed_documents(nothing).count() == 0
    words = out.select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert words == sum(r.taken for r in got)


def test_pii(docs, nothing):
    got = pii.with_surrogates(docs)
    assert got.columns == [*docs.columns, "n_entities"] and pii.with_surrogates(nothing).count() == 0
    rows = got.collect()
    assert len(rows) == len(TEXTS) and sum(r.n_entities for r in rows) == 1
    of = {r.doc_id: r for r in rows}
    assert of[2].text is None and of[3].text == "" and of[5].text == LONG and of[1].text == "a b c d e f g"
    assert "a.b@corp.org" not in of[9].text and of[9].text.startswith("mail me at ") and of[9].n_chars == len(of[9].text)


def test_bpe(docs, nothing):
    got = bpe.bpe_round_trip(docs).collect()
    assert len(got) == len(TEXTS) and bpe.bpe_round_trip(nothing).count() == 0
    sha = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in TEXTS)
    assert sorted(r.decoded_sha256 for r in got) == sha
    assert [r.n_tokens for r in got if r.doc_id in (2, 3)] == [0, 0]


def test_simhash(docs, nothing):
    got = simhash.simhash_components(docs)
    assert got.count() == len(TEXTS) and simhash.simhash_components(nothing).count() == 0
    of = {r.doc_id: (r.fp, r.component_id) for r in got.collect()}
    assert of[2] == of[3] == of[4] == (0, 2) and of[7][1] == of[1][1] == of[None][1] == 1
    kept = simhash.near_deduplicate(docs)
    assert kept.columns == docs.columns and simhash.near_deduplicate(nothing).count() == 0
    assert {r.doc_id for r in kept.collect()} == {c for _, c in of.values()}


def test_substrings(docs, nothing):
    got = substrings.repeated_bytes_removed(docs)
    assert got.count() == len(TEXTS) and substrings.repeated_bytes_removed(nothing).count() == 0
    of = {r.doc_id: r for r in got.collect()}
    assert of[2].n_bytes == 0 and of[5].n_removed == 0 and of[7].n_removed == 0
    assert of[5].kept_sha256 == hashlib.sha256(LONG.encode()).hexdigest()


def test_toxicity_and_quality(spark, docs, nothing):
    rng = random.Random(1)
    filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(12))
    sample = [(f"plain words {filler()}", 0) for _ in range(60)] + [(f"you idiot {filler()} scum {filler()}", 1) for _ in range(60)]
    tagger = toxicity.fit(sample)
    got = toxicity.toxicity_scores(docs, tagger).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score < toxicity.THRESHOLD for r in got)
    assert toxicity.toxicity_scores(nothing, tagger).count() == 0
    assert toxicity.without_toxic(docs, tagger).count() == len(TEXTS) and toxicity.without_toxic(nothing, tagger).columns == docs.columns
    score, spans = toxicity.score_text(tagger, "What an IDIOT", toxicity.Weights(tagger))
    assert score > 0.5 and [(s, e) for s, e, _ in spans] == [(8, 13)]
    voter = quality.fit([(t.encode(), y) for t, y in sample])
    got = quality.quality_scores(docs, voter).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(nothing, voter).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(docs, toxicity.train(docs, labels)).count() == len(TEXTS)
    assert quality.quality_scores(docs, quality.train(docs, labels)).count() == len(TEXTS)


def test_pages(spark):
    schema = "page_id long, url string, html string, host string, paths string, text string"
    page = "<html><body><nav><a href=x>menu</a></nav><article><p>Main &lt;text&gt;</p></article></body></html>"
    rows = [(1, "http://a.org/1", page), (1, "http://a.org/1", page), (2, None, page), (None, "http://b.org", None), (4, "odd", ""), (5, "http://a.org/2", "<p>" * 3000 + "deep" + "<div>" * 3000), (6, "http://a.org/3", "<" * 5000), (7, "x", f"<article>{'<p>some words</p>' * 30000}</article>")]
    pages = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], schema)
    got = html.main_text(pages).collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.page_id in (1, 2)] == ["Main <text>"] * 3
    assert all(r.n_chars == len(r.text) for r in got) and {r.page_id: r.text for r in got}[None] == ""
    assert {r.page_id: r.text for r in got}[5] == "deep"
    assert {r.page_id: r.n_chars for r in got}[7] == 30000 * 11 - 1
    assert html.main_text(pages.where("false")).count() == 0


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.1, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [nan, 0.0, 1.0]),
        (7, [inf, 0.0, 0.0]), (8, [1.0, 0.0]), (9, []), (None, [1.0, 0.0, 0.0]), (100, [0.0, 0.0, -1.0]), (100, [0.0, 0.0, -1.0]), (200, [1e-30, 0.0, 0.0]), (300, [3e38, 3e38, 0.0]),
    ]
    return spark.createDataFrame([(*r, 1, "c", "c", "c", "c") for r in rows], "vec_id long, embedding array<float>, label int, rep string, n string, block string, x string")


def test_cosine(odd_vectors):
    got = vectors.cosine_components(odd_vectors)
    assert got.count() == 15 and vectors.cosine_components(odd_vectors.where("false")).count() == 0
    of = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()}
    assert of[0] == (3, 0, True) and of[1] == (3, 0, False) and of[2] == (3, 0, False) and of[200] == (3, 0, False)
    assert all(of[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 300)) and of[None] == (0, None, False)
    assert of[100] == (1, 100, True)


def test_top_k(odd_vectors):
    small = odd_vectors.where("vec_id is null or vec_id <> 300")
    got = vectors.top_inner_products(small)
    assert vectors.top_inner_products(odd_vectors.where("false")).count() == 0
    zero = [(r["rank"], r.vec_id, r.score) for r in got.where("query_id = 0").orderBy("rank").collect()]
    assert zero[:3] == [(1, 2, 2048 * 1024), (2, 1, 1024 * 1024), (3, 4, 0)]
    assert got.where("query_id = vec_id").count() == 0 and got.where("vec_id in (3, 5, 6, 7, 8, 9)").count() == 0

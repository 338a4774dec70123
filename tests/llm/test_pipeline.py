"""The corpus pipeline against its stages done by hand."""

import hashlib

import numpy as np

import corpus_pipeline
from walkframe.llm import bpe, mixing, simhash, toxicity


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{data}/labels.parquet")
    tagger = toxicity.train(docs, labels)
    kept = {r.doc_id: r.text for r in docs.collect() if toxicity.score_text(tagger, r.text or "", toxicity.Weights(tagger))[0] < toxicity.THRESHOLD}
    (_, tox), (_, near), (_, hide), (_, mix), (_, code) = corpus_pipeline.STAGES
    a = tox(spark, docs, data).cache()
    assert a.columns == columns and {r.doc_id for r in a.collect()} == set(kept) and len(kept) < docs.count()
    fp = {i: simhash.fingerprint((t or "").encode()) for i, t in kept.items()}
    from test_exact import linked

    one = set(linked(fp, lambda x, y: bin(x ^ y).count("1") <= 3).values())
    b = near(spark, a, data).cache()
    assert b.columns == columns and {r.doc_id for r in b.collect()} == one
    c = hide(spark, b, data).cache()
    assert c.columns == columns and c.count() == b.count() and c.where("text rlike '@mail[0-9]+[.]example[.]com'").join(b, ["doc_id", "text"]).count() == 0
    d = mix(spark, c, data).cache()
    assert d.columns == columns
    taken = {r.doc_id: r.taken for r in mixing.mix(c).collect()}
    words = {}
    for r in d.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").encode().split())
    assert words == {i: n for i, n in taken.items() if n}
    enc = bpe.encoder(bpe.default_vocabulary())
    want = sorted((r.doc_id, hashlib.sha256(np.array(enc.encode_ordinary(r.text), dtype="<u4").tobytes()).hexdigest()) for r in d.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in code(spark, d, data).collect()) == want
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, data).collect()) == want

"""Chunked byte-level BPE against another library that reads the same vocabulary."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from walkframe.llm import bpe


@pytest.fixture(scope="module")
def other():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def sha_of_ids(other, text):
    return hashlib.sha256(np.array(other.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()).hexdigest()


def test_query(spark, data, other):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert sum(len(t) > bpe.CHUNK for t in rows.values()) > 20  # the table itself goes through chunks
    got = {r.doc_id: r for r in bpe.op6_byte_bpe(spark, data).collect()}
    assert {i: r.ids_sha256 for i, r in got.items()} == {i: sha_of_ids(other, t) for i, t in rows.items()}
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in rows.items())


def test_repeated_rows_and_long_runs(spark, other):
    texts = ["word " * 3000, "x" * 20_000 + " end", ("a" * 5000 + " b's  ") * 4, "é日 本\n" * 2500]
    rows = [(i % 3 or None, t) for i, t in enumerate(texts)] * 3
    got = bpe.bpe_round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.ids_sha256 for r in got) == sorted(sha_of_ids(other, t) for _, t in rows)
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for _, t in rows)

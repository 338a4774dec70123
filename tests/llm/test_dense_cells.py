"""SimHash links through neighbouring values and finer grids, and texts cut at a word."""

import random

import pytest
from test_exact import linked

from walkframe.llm import mixing, simhash
from walkframe.operators.components import connected_components


def values(seed):
    rng = random.Random(seed)
    found = {rng.getrandbits(64): 0 for _ in range(40)}
    for b in list(found)[:3]:
        for _ in range(120):
            x = b
            for _ in range(rng.randint(0, 8)):
                x ^= 1 << rng.randrange(64)
            found[x] = 0
    return {i: x for i, x in enumerate(found)}


@pytest.mark.parametrize("most,groups", [(1, None), (20, None), (1 << 19, 7), (1 << 19, 10), (30, 8)])
def test_components(spark, monkeypatch, most, groups):
    monkeypatch.setattr(simhash, "DENSE", most)
    of = values(groups or most)
    df = spark.createDataFrame([(simhash.signed(x), i) for i, x in of.items()], "fp long, rep long")
    got = {r.node: r.component for r in connected_components(simhash.near_links(df, groups), contract=False).collect()}
    assert {i: got.get(i, i) for i in of} == linked(of, lambda a, b: bin(a ^ b).count("1") <= 3)


def test_more_fingerprints_more_groups():
    of = [simhash.groups_for(10**k) for k in (0, 6, 9, 10, 12)]
    assert of == sorted(of) and of[:2] == [6, 6] and of[-1] > 8


def test_first_words(spark):
    text = " \n one\ttwo  three\r\nfour "
    df = spark.createDataFrame([(text, n) for n in range(5)], "t string, n int")
    got = {r.n: r.x for r in df.select("n", mixing.first_words(df.t, df.n).alias("x")).collect()}
    assert got == {0: "", 1: " \n one", 2: " \n one\ttwo", 3: " \n one\ttwo  three", 4: " \n one\ttwo  three\r\nfour"}


def test_mixed_rows_that_are_alike(spark):
    rows = [(1, "a", f"x{i % 3}", "same words here") for i in range(9)] + [(None, None, "y", "other words"), (2, "a", "y", None), (3, "b", "y", "one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    plan, got = mixing.mix(docs).collect(), mixing.mixed_documents(docs).collect()
    assert sum(r.taken for r in plan) == sum(len(r.text.split()) for r in got)
    full = {x: sum(r.lang == x and r.text == "same words here" for r in got) for x in ("x0", "x1", "x2")}
    assert max(full.values()) - min(full.values()) <= 3 and all(r.text in {t for *_, t in rows} or r.text in "same words one two three" for r in got)

"""Source divergence, ranked search and exact dedup against brute force, with rows of every kind."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from walkframe.llm import divergence, exact, lexical

COLS = "doc_id long, text string, lang string, source string, run string, term string, n string, `row` string, at string, digest string, item string, part string, `range` string"
LONG = "Élan vital One two THREE 4four " * 60_000


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["the", "of", "Straße", "naïve", "İx", "x9", "日本", "A", "b2b", *["w" + chr(97 + i) for i in range(20)]]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randrange(1, 30))), rng.choice("ab"), rng.choice("stuv")) for i in range(300)]
    rows += [(i + 400, rows[i % 7][1], "a", "s") for i in range(60)]
    rows += [(500, None, "a", None), (501, "", None, "s"), (502, " \t\n.", "c", "only"), (503, LONG, "b", "s"), (503, LONG, "b", "s"), (None, rows[0][1], "b", "t"), (None, None, "b", "t"), (7, rows[9][1], "a", "s")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*r, *["clash"] * 9) for r in texts], COLS).repartition(5)


def slow_divergence(texts, least, ranks):
    found = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for _, t, l, s in texts]
    df, out = defaultdict(Counter), []
    for l, _, ts in found:
        df[l].update(set(ts))
    for lang in {l for l, _, _ in found}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        count = {s: Counter() for l, s, _ in found if l == lang}
        for l, s, ts in found:
            if l == lang:
                count[s].update(t for t in ts if t in set(kept))
        all_of = sum(count.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q = p(all_of)
        for s, c in count.items():
            own = p(c)
            pairs = sorted(((-sum(abs(own[t] - x) for t, x in p(d).items()), r.encode(), r) for r, d in count.items() if r != s))
            out += [(lang, s, "pair", r, -v, i + 1) for i, (v, _, r) in enumerate(pairs)]
            terms = sorted((q[t] - own[t], t.encode(), t) for t in kept if c[t] and own[t] > q[t])
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:ranks])]
    return sorted(out)


@pytest.mark.parametrize(("least", "ranks"), [(30, 50), (1, 3), (10**6, 50)])
def test_divergence(docs, texts, least, ranks):
    got = divergence.source_divergence(docs, least, ranks).collect()
    assert sorted(map(tuple, got)) == slow_divergence(texts, least, ranks)


def test_divergence_counts_are_handed_on():
    batch = pa.RecordBatch.from_pydict({"lang": ["a"] * 300, "source": ["s", "t"] * 150, "text": pa.array([f"x y z{chr(97 + i % 26)}".encode() for i in range(300)])})
    total = Counter()
    for b in divergence.counted([batch], entries=10):
        for r in b.to_pylist():
            total[r["source"], r["term"]] += r["n"]
    assert total["s", "x"] == total["t", "y"] == 150 and sum(total.values()) == 900


def test_shares_are_exact(spark):
    rows = [(10**12 + 7, 9 * 10**13 - 11, 31), (0, 1, 1), (5, 5, 1)]
    got = spark.createDataFrame(rows, "n long, total long, terms long").select(divergence.share(F.col("n"), F.col("total"), F.col("terms")))
    assert [r[0] for r in got.collect()] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in rows]


def slow_search(texts, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    docs = [(i, Counter(terms(t))) for i, t, *_ in texts]
    docs = [(i, c) for i, c in docs if c]
    n_docs, length, out = len(docs), sum(c.total() for _, c in docs), []
    df = Counter(t for _, c in docs for t in c)
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 50 + 50 * c.total() * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "the of x9"), (2, "Straße STRASSE wa wb wc wd"), (2, "日本 4four"), (4, None), (5, "nowhere"), (6, " ".join("w" + chr(97 + i) for i in range(20)) + " the the"), (None, "a élan vital Élan")]


@pytest.mark.parametrize(("k", "block", "batch"), [(50, 8192, 1 << 23), (3, 64, 40), (400, 100, 1 << 23)])
def test_search(spark, docs, texts, monkeypatch, k, block, batch):
    monkeypatch.setattr(lexical, "ITEMS", 3)
    items = spark.createDataFrame([(*r, "clash") for r in ITEMS], "item_id long, text string, terms string")
    got = lexical.ranked_search(docs, items, k, block, batch)
    assert sorted(map(tuple, got.collect()), key=repr) == slow_search(texts, ITEMS, k)


def test_slices_add_and_rank():
    rng = np.random.default_rng(3)
    n, terms = 200, 9
    value = rng.integers(0, 1 << 35, (terms, n)) * (rng.random((terms, n)) < 0.5)
    value[3:6, ::3] = 12345
    t, at = np.nonzero(value)
    one = lexical.bit_slices(t, at, value[t, at], terms, 4, 35)
    for asked in ([0, 1, 2], [3], [3, 4, 5], list(range(terms)), []):
        total = np.zeros((40, 1, 4), dtype="<u8")
        for x in asked:
            lexical.add(total, one, np.array([x]))
        want = value[asked].sum(axis=0)
        for k in (1, 10, 70, 500):
            best = sorted((-s, i) for i, s in enumerate(want) if s)[:k]
            assert np.flatnonzero(lexical.best_of_slices(total, k)[0]).tolist() == sorted(i for _, i in best)


def test_terms_held_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    value = rng.integers(0, 1 << 20, (40, 100)) * (rng.random((40, 100)) < 0.4)
    items = [np.sort(rng.choice(40, 12, replace=False)) for _ in range(7)]
    term, at = np.nonzero(value)
    for held in (5, 1024):
        monkeypatch.setattr(lexical, "HELD", held)
        got = sorted((int(i), int(p), int(s)) for part in lexical.best_of_block(np.arange(100), (term, at, value[term, at]), items, 10) for i, p, s in zip(*part, strict=True))
        want = [(i, p, s) for i, x in enumerate(items) for s, p in sorted(((int(s), p) for p, s in enumerate(value[x].sum(axis=0)) if s), key=lambda r: (-r[0], r[1]))[:10]]
        assert got == sorted(want)


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_groups(docs, texts, fan_in):
    body = [t or "" for _, t, *_ in texts]
    size = Counter(body)
    top = {b: max((i for (i, *_), c in zip(texts, body, strict=True) if c == b and i is not None), default=None) for b in size}
    got = exact.exact_groups(docs, fan_in=fan_in).collect()
    want = [(i, top[b], size[b], hashlib.sha256(b.encode()).hexdigest()) for (i, *_), b in zip(texts, body, strict=True)]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(want, key=repr)
    kept = [r for r in got if r.kept]
    assert Counter(r.text_sha256 for r in kept) == {hashlib.sha256(b.encode()).hexdigest(): 1 for b in size}
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_deduplicate(docs, texts):
    out = exact.exact_deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for _, t, *_ in texts})
    same = exact.exact_groups(docs, lambda t: F.lit("x")).collect()
    assert {(r.keep_id, r.group_size) for r in same} == {(503, len(texts))} and sum(r.kept for r in same) == 1


def test_merge_holds_one_entry():
    entry = lambda d, i, n=1: {"range": 0, "run": 0, "digest": d, "n_bytes": 1, "check": 1, "doc_id": i, "at": i, "n": n}
    rows = [entry(b"a", 1), entry(b"a", 4, 3), entry(b"a", 9), entry(b"b", 2), entry(b"c", 3), entry(b"c", 5)]
    schema = pa.schema([("range", pa.int32()), ("run", pa.int64()), ("digest", pa.binary()), *[(c, pa.int64()) for c in ("n_bytes", "check", "doc_id", "at")], pa.field("n", pa.int64(), False)])
    for cut in range(1, 6):
        parts = [pa.RecordBatch.from_pylist(x, schema) for x in (rows[:cut], [], rows[cut:])]
        got = [(r["digest"], r["doc_id"], r["n"]) for b in exact.merged(parts) for r in b.to_pylist()]
        assert got == [(b"a", 9, 5), (b"b", 2, 1), (b"c", 5, 2)]


def test_empty(spark, docs):
    nothing = docs.where("false")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert divergence.source_divergence(nothing).count() == 0
    assert exact.exact_groups(nothing).count() == 0 and exact.exact_deduplicate(nothing).count() == 0
    for d, i in ((nothing, items), (docs, items.where("false")), (docs.where("doc_id = 500"), items)):
        got = lexical.ranked_search(d, i)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]

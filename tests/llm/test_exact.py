"""Operators against brute force, over whole small tables."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from oracle import assert_same

from walkframe.llm import bpe, html, mixing, pii, quality, queries, simhash, substrings, toxicity, vectors


@pytest.fixture(scope="module")
def texts(data):
    return duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, data, name):
    assert assert_same(queries.QUERIES[name](spark, data), queries.ORACLE_SQL[name], data) > 0


def test_bpe_in_small_chunks(spark, data, texts):
    enc = bpe.encoder(bpe.default_vocabulary())
    want = {i: hashlib.sha256(np.array(enc.encode_ordinary(t or ""), dtype="<u4").tobytes()).hexdigest() for i, t in texts}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for chunk, overlap in ((300, 40), (1 << 16, 1 << 10)):
        got = {r.doc_id: r for r in bpe.bpe_round_trip(docs, chunk=chunk, overlap=overlap, keep=True).collect()}
        assert {i: r.ids_sha256 for i, r in got.items()} == want
        assert all(got[i].decoded.decode() == (t or "") and len(got[i].ids) == 4 * got[i].n_tokens for i, t in texts)


@pytest.mark.parametrize("text", ["a" * 900, "they're 'll " * 90, " " * 700 + "x", "\n \t" * 300, "1234567890" * 60, "é日本 'S" * 120, "ab  cd   " * 100, "..." * 250])
def test_bpe_where_chunks_hardly_meet(spark, text):
    enc = bpe.encoder(bpe.default_vocabulary())
    got = bpe.bpe_round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string"), chunk=100, overlap=30).first()
    assert got.ids_sha256 == hashlib.sha256(np.array(enc.encode_ordinary(text), dtype="<u4").tobytes()).hexdigest()


def slow_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash(spark, data, texts):
    fp = {i: slow_fingerprint(t) for i, t in texts}
    got = {r.doc_id: r for r in simhash.op10_simhash_near_dedup(spark, data).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fp
    assert {i: r.component_id for i, r in got.items()} == linked(fp, lambda a, b: bin(a ^ b).count("1") <= 3)


def linked(values, near):
    ids = sorted(values)
    label = {i: i for i in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if near(values[a], values[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def test_simhash_links_of_dense_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = {}
    for b in base:
        for _ in range(250):
            x = b
            for _ in range(rng.randint(0, 9)):
                x ^= 1 << rng.randrange(64)
            values[x] = 0
    values = {i: x for i, x in enumerate(values)}
    df = spark.createDataFrame([(simhash.signed(x), i) for i, x in values.items()], "fp long, rep long")
    from walkframe.operators.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash.near_links(df)).collect()}
    want = linked(values, lambda a, b: bin(a ^ b).count("1") <= 3)
    assert {i: got.get(i, i) for i in values} == want


def brute_removed(rows):
    first = {}
    for d, t in sorted(rows):
        x = t.encode()
        for p in range(len(x) - 49):
            first.setdefault(x[p : p + 50], d)
    out = {}
    for d, t in rows:
        x = t.encode()
        off = bytearray(len(x))
        for p in range(len(x) - 49):
            if first[x[p : p + 50]] < d:
                off[p : p + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(off)) if off[i] and (i == 0 or not off[i - 1]))
        out[d] = (len(x), sum(off), spans, hashlib.sha256(bytes(b for b, f in zip(x, off) if not f)).hexdigest())
    return out


def test_repeated_substrings(spark, data, texts):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.op2_repeated_substrings(spark, data).collect()}
    assert got == brute_removed([(i, t or "") for i, t in texts])


def test_repeated_substrings_of_few_letters(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_BYTES", 3000)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 5000)
    monkeypatch.setattr(substrings, "STEP", 256)
    rng = random.Random(8)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randint(20, 400))) for _ in range(12)] + ["x" * 300, "ab" * 120]
    rows = [(i, "".join(rng.choice(pool)[rng.randint(0, 30) :] for _ in range(rng.randint(0, 4)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in substrings.repeated_bytes_removed(df).collect()}
    assert got == brute_removed(rows)


def test_repeated_substrings_at_every_place_of_a_context(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    a, licence, b, x, y = (word(n) for n in (120, 240, 120, 120, 120))
    rows = [(5, x + licence + y), (9, a + licence + a + licence + a + licence + b), (12, a + licence + y)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in substrings.repeated_bytes_removed(df).collect()}
    assert got == brute_removed(rows)


def test_cosine_and_top_k_over_many_blocks(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([centres[i % 12] + 0.35 * rng.standard_normal(16) for i in range(420)]).reshape(-1, 16).astype(np.float32)
    x[50:70] = x[50]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    label = linked({i: i for i in range(len(x))}, lambda a, b: near[a, b])
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.cosine_components(df, block=64).collect()}
    assert got == {i: (int(near[i].sum()), label[i]) for i in range(len(x))}
    q = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, len(x), 20):
        score = q @ q[i]
        best = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-score[j], j))[:10]
        want += [(i, k + 1, j, int(score[j])) for k, j in enumerate(best)]
    vectors_group, vectors.GROUP = vectors.GROUP, 50
    try:
        found = vectors.top_inner_products(df, every=20)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == sorted(want)
    finally:
        vectors.GROUP = vectors_group


PAGE = """<html><body class="has-sidebar"><header class="site-header"><h1>Site</h1><nav>x</nav></header><div id=wrap><div class="content"><article>
<header><h1>Title &amp; more</h1><span>By X</span></header><p>One <b>two</b>&nbsp;three <a href="x">link</a> text &lt;ok&gt;.<p>Second   para<ul><li>item a<li>item b</ul>
<form><input><p>sub</p></form><div class="share-buttons">share</div><section class="comments"><p>a long comment text that must not be in the result at all, really</p></section>
</article><aside>side</aside></div><div class="cookie-notice">cookies!</div></div><footer>f</footer><script>if(a<b){"</p>"}</script></body></html>"""


def test_main_text(spark, data):
    assert html.extract(PAGE, []) == "Title & more\nOne two three link text <ok>.\nSecond para\nitem a\nitem b"
    import html as H

    pages = duckdb.sql(f"SELECT page_id, html FROM '{data}/pages.parquet'").fetchall()
    got = {r.page_id: r.text for r in html.op1_html_main_text(spark, data).collect()}
    for i, source in pages:
        blocks = re.split(r"</?(?:p|h1|br)>", re.search(r"<article>(.*)</article>", source, re.S)[1])
        assert got[i] == "\n".join(x for x in (" ".join(H.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if x)


def test_hosts_agree_on_a_path(spark, monkeypatch):
    # without votes, the short page's own best container is its list of teasers
    long = "<div class='story-7'><p>" + "many words of the article " * 20 + "</p></div><div class='teasers'><p>read this too</p></div>"
    short = "<div class='story-8'><p>only a few words</p></div><div class='teasers'><p>read these, and all those, and some other things too</p></div>"
    assert html.extract(f"<html><body>{short}</body></html>", []).startswith("read these")
    pages = spark.createDataFrame([(i, "http://h.org/x", f"<html><body>{long if i else short}</body></html>") for i in range(5)], "page_id long, url string, html string")
    for small in (html.SMALL, -1):  # with the paths broadcast, and by the salted join
        monkeypatch.setattr(html, "SMALL", small)
        assert {r.page_id: r.text for r in html.main_text(pages).collect()}[0] == "only a few words"


def test_mix_meets_targets(spark, data):
    rows = mixing.op3_mixing(spark, data).collect()
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    assert all(abs(sum(r.taken for r in v) - t) <= 1 for (_, t), v in by.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op3_mixing(spark, data).collect()))


def test_surrogates(spark):
    texts = [
        "Contact Mrs. Anna Smith or Mr. Smith at a.smith@corp.com, A.Smith@corp.com; +1 (017) 555-7713 and +1 017 555 7713.",
        "card 4111 1111 1111 1111 or 4111111111111111, ssn 123-45-6789, ip 10.0.0.1, iban DE44 5001 0517 5407 3249 31",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" г-жа Иванова', "plain text 12345, 3.14 and 1.2.3",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in pii.with_surrogates(df).orderBy("doc_id").collect()]
    again = [r.text for r in pii.with_surrogates(df).orderBy("doc_id").collect()]
    assert got == again and got[3] == texts[3]
    for secret in ("Anna", "Smith", "corp.com", "555-7713", "4111", "123-45-6789", "10.0.0.1", "5001 0517", "04dbebab", "Иванова"):
        assert not any(secret in t for t in got)
    m = re.fullmatch(r"Contact Mrs\. (\w+na) (\w+) or Mr\. (\w+) at (\S+), (\S+); \+1 \((\d{3})\) (\d{3})-(\d{4}) and \+1 (\d{3}) (\d{3}) (\d{4})\.", got[0])
    assert m and m[2] == m[3] and m[4] == m[5] and m.group(6, 7, 8) == m.group(9, 10, 11)
    c = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}) or (\d{16}), ssn \d{3}-\d{2}-\d{4}, ip \d+\.\d+\.\d+\.\d+, iban DE\d\d(?: \d{4}){4} \d\d", got[1])
    assert c and c[1].replace(" ", "") == c[2]
    digits = [int(x) for x in c[2]]
    assert sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"г-жа [А-Я][а-я]+$", got[2])


def test_keys_without_a_digit_are_replaced(spark):
    keys = ["AKIA" + "QWERTYUIOPASDFGH", "sk-" + "abcdefghijklmnopq", "ghp_" + "ABCDEFghijklMNOPqrst", "xoxb-" + "abcdefgh-ijklmnopq", "abcdef" * 6, "ABCDEF" * 6]
    df = spark.createDataFrame([(i, f"the key {k} is here") for i, k in enumerate(keys)], "doc_id long, text string")
    got = pii.with_surrogates(df).orderBy("doc_id").collect()
    assert [r.n_entities for r in got] == [1] * len(keys)
    assert all(k not in r.text and len(r.text) == len(f"the key {k} is here") for k, r in zip(keys, got))


def test_surrogates_stay_distinct_where_draws_collide(spark):
    # all 3-digit areas and lines of one small block: many draws in a small space
    rows = [(i, f"Mr. Name{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} and 10.{i % 7}.{i // 7}.{i % 5}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = pii.replacements(df.selectExpr(f"explode(regexp_extract_all(text, '{pii.ANY}', 0)) as entity".replace("\\", "\\\\")), "k").collect()
    assert len({r.replacement for r in made}) == len(made) == len({r.entity for r in made})
    assert not {r.replacement for r in made} & {r.entity for r in made}


def held_out(data, label, folds, rest):
    import zlib

    rows = duckdb.sql(f"SELECT doc_id, text, {label} FROM '{data}/documents.parquet' JOIN '{data}/labels.parquet' USING (doc_id)").fetchall()
    return {i: y for i, _, y in rows if zlib.crc32(str(i).encode()) % folds == rest}


def auc(pairs):
    pos, neg = ([s for s, y in pairs if y == v] for v in (1, 0))
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("op,label,folds,rest", [(toxicity.op5_toxicity, "toxic", 4, 2), (quality.op9_quality, "quality", 5, 0)])
def test_held_out_accuracy(spark, op, label, folds, rest):
    data = "/root/testdata/sf0.01"
    want = held_out(data, label, folds, rest)
    got = {r.doc_id: r for r in op(spark, data).collect()}
    assert {i for i, r in got.items() if r.held_out} >= set(want)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert auc([(got[i].score, y) for i, y in want.items()]) > 0.9
    assert sum(got[i].predicted == y for i, y in want.items()) / len(want) > 0.9


def test_marginals_are_those_of_all_tokens():
    """Runs of plain words as matrix powers, against forward-backward over every token."""
    t = toxicity.Tagger({"bad$": 3.0, "evil$": 1.5}, -1.0, -2.0, ((0.3, -0.7), (-0.2, 0.9)), (0.0, 1.0, 1.0))
    rng = random.Random(2)
    for _ in range(30):
        words = [rng.choice(["bad", "evil", "fine", "ok", "so"]) for _ in range(rng.randint(1, 40))]
        up = [np.exp(t.bias + {"bad": 3.0, "evil": 1.5}.get(w, 0.0)) for w in words]
        a = np.exp(np.array(t.transitions))
        f = [np.array([1.0, np.exp(t.start) * up[0]])]
        for u in up[1:]:
            f.append(f[-1] @ a * np.array([1.0, u]))
        b = [np.ones(2)]
        for u in reversed(up[1:]):
            b.append(a @ (np.array([1.0, u]) * b[-1]))
        b.reverse()
        want = [(x * y)[1] / (x * y).sum() for x, y in zip(f, b)]
        for i, p in toxicity.marginals(t, words, toxicity.Weights(t)):
            assert abs(p - want[i]) < 1e-9

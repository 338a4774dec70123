"""Plain byte files: round trips over many tasks, places, and writes that must fail."""

import random
import struct

import pytest
from graphs import BUBBLES
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from walkframe import cli
from walkframe.sources import gfa, raw, sinks


def joined(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))


def pairs(df):
    return sorted((r[0], r[1]) for r in df.collect())


def test_words(spark, tmp_path):
    n, out, rng = 5000, tmp_path / "a folder of words", random.Random(3)
    words = [rng.randrange(-(2**63), 2**63) for _ in range(n)]
    rows = spark.createDataFrame(list(enumerate(words)), "at long, value long").repartition(7)
    raw.write_words(rows, str(out), 6)
    assert joined(out) == struct.pack(f"<{n}q", *words)
    assert len(list(out.glob("part-*"))) > 1 and not list(out.glob("_writing*"))
    for split in (1000, 1 << 20):
        assert pairs(raw.read_numbers(spark, str(out), split=split)) == list(enumerate(words))
    assert raw.read_numbers(spark, str(out), split=4000).rdd.getNumPartitions() >= 10
    # the same as one file, with entries left out
    (tmp_path / "one").write_bytes(joined(out))
    assert pairs(raw.read_numbers(spark, str(tmp_path / "one"), skip=3, split=999)) == list(enumerate(words[3:]))
    assert pairs(raw.read_numbers(spark, str(out), skip=n - 1)) == [(0, words[-1])]
    assert pairs(raw.read_numbers(spark, str(out), skip=n)) == []
    assert pairs(gfa.read_suffix_array(spark, str(tmp_path / "one"))) == list(enumerate(words[1:]))


def test_bytes_and_blocks(spark, tmp_path):
    rng, pieces, at = random.Random(4), [], 0
    for _ in range(300):
        piece = rng.randbytes(rng.choice((0, 1, 7, 100)))
        pieces.append((at, piece))
        at += len(piece)
    whole = b"".join(p for _, p in pieces)
    rng.shuffle(pieces)
    out = tmp_path / "bytes"
    raw.write_bytes(spark.createDataFrame([*pieces, (5, None)], "at long, data binary").repartition(5), str(out), 4)
    assert joined(out) == whole
    assert pairs(raw.read_numbers(spark, str(out), width=1, skip=2, split=100)) == list(enumerate(whole[2:]))
    for block, split in ((64, 64), (64, 1000), (1 << 20, 1 << 20)):
        found = pairs(raw.read_blocks(spark, str(out), block, split))
        assert b"".join(bytes(d) for _, d in found) == whole
        assert all(bytes(d) == whole[a : a + len(d)] and a // block == (a + len(d) - 1) // block for a, d in found)
    # fewer bytes in place of more: old parts go
    raw.write_bytes(spark.createDataFrame([(0, b"xyz")], "at long, data binary"), str(out))
    assert joined(out) == b"xyz"


def test_nothing(spark, tmp_path):
    out = tmp_path / "none"
    raw.write_words(spark.createDataFrame([], "at long, value long"), str(out))
    assert joined(out) == b"" and raw.read_numbers(spark, str(out)).count() == 0
    (tmp_path / "empty").write_bytes(b"")
    assert raw.read_numbers(spark, str(tmp_path / "empty")).count() == 0 and raw.read_blocks(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(PySparkException):
        raw.read_numbers(spark, str(tmp_path / "nowhere")).count()
    (tmp_path / "torn").write_bytes(b"123456789")
    with pytest.raises(PySparkException):
        raw.read_numbers(spark, str(tmp_path / "torn")).count()
    with pytest.raises(ValueError):
        raw.read_numbers(spark, str(out), width=2)


@pytest.mark.parametrize("places", [(0, 1, 3), (0, 1, 1, 2), (1, 2), (0, None, 1)])
def test_failed_writes_leave_what_was_there(spark, tmp_path, places):
    out = tmp_path / "kept"
    raw.write_words(spark.range(10).select(F.col("id").alias("at"), F.col("id").alias("value")), str(out))
    bad = spark.createDataFrame([(p, 7) for p in places], "at long, value long").repartition(3)
    with pytest.raises(PySparkException):
        raw.write_words(bad, str(out))
    assert joined(out) == struct.pack("<10q", *range(10)) and not list(out.glob("_writing*"))


def test_missing_part(spark, tmp_path):
    out = tmp_path / "parts"
    raw.write_words(spark.range(4000).select(F.col("id").alias("at"), F.col("id").alias("value")), str(out), 4)
    parts = sorted(out.glob("part-*"))
    assert len(parts) > 2
    parts[1].unlink()
    with pytest.raises(PySparkException):
        raw.read_numbers(spark, str(out)).count()


def test_dump_and_tags_of_a_graph(spark, tmp_path, capsys):
    (tmp_path / "g.gfa").write_text(BUBBLES.text())
    out = str(tmp_path / "x")
    cli.main(["extract", str(tmp_path / "g.gfa"), out, "--end", "$", "--raw"])
    flip = str.maketrans("ACGT", "TGCA")
    walks = ["".join(s.translate(flip)[::-1] if r else s for i, r in steps for s in [BUBBLES.segments[i][1]]) for _, steps in BUBBLES.walks]
    text = "".join(w + "$" for w in walks).encode()
    assert joined(tmp_path / "x/sequences") == text
    n = len(text)
    suffixes = sorted(range(n), key=lambda i: text[i:])
    (tmp_path / "g.sa").write_bytes(struct.pack(f"<{n + 1}q", n, *suffixes))
    bwt = bytes(text[i - 1] for i in suffixes)
    (tmp_path / "g.bwt").write_bytes(b"?" + bwt)
    cli.main(["extract", str(tmp_path / "g.gfa"), out, "--mode", "tag-array", "--suffix-array", str(tmp_path / "g.sa"), "--bwt", str(tmp_path / "g.bwt"), "--raw"])
    found = struct.unpack(f"<{n}q", joined(tmp_path / "x/tags"))
    assert [suffixes[k] for k, t in enumerate(found) if t == 0] == [i for i in suffixes if text[i] == ord("$")]
    runs = lambda x: 1 + sum(a != b for a, b in zip(x, x[1:]))
    assert capsys.readouterr().out.split("\n")[:2] == [f"{runs(found)} runs of tags", f"{runs(bwt)} runs of the BWT"]


def test_empty_walks_have_an_end(spark):
    graph = gfa.PathGraph(
        spark.createDataFrame([(1, 0, 4), (1, 1, 7)], "path_id long, pos long, g long"),
        spark.createDataFrame([(2, "AC"), (3, "GGT")], "node_id long, seq string"),
        path=spark.createDataFrame([(0,), (1,), (2,)], "path_id long"),
    )
    pieces = sorted((r.at, bytes(r.data)) for r in sinks.dump_pieces(graph, end="$").collect())
    assert pieces == [(0, b"$"), (1, b"AC"), (3, b"ACC"), (6, b"$"), (7, b"$")]

"""The command line over a small graph."""

import struct

import pytest
from graphs import BUBBLES, CHOPPED

from walkframe import cli
from walkframe.model import PathGraph


@pytest.fixture()
def file(tmp_path):
    (tmp_path / "g.gfa").write_text(BUBBLES.text())
    return str(tmp_path / "g.gfa")


def test_render(spark, tmp_path, file):
    cli.main(["render", file, str(tmp_path / "out"), "--paths", "pan-sn"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sum(x.startswith("P\tdonor#") for x in lines) == 4 and not any(x.startswith("W") for x in lines)


def test_extract_and_tables(spark, tmp_path, file):
    cli.load(spark, file).write(str(tmp_path / "tables"))
    assert isinstance(cli.load(spark, str(tmp_path / "tables")), PathGraph)
    out = str(tmp_path / "x")
    cli.main(["extract", str(tmp_path / "tables"), out, "--contig", "Y", "--end", "$"])
    got = {r.path_id: r.text for r in spark.read.parquet(f"{out}/sequences").collect()}
    of = {k: (name, "".join(s.translate(str.maketrans("ACGT", "TGCA"))[::-1] if r else s for i, r in steps for s in [BUBBLES.segments[i][1]])) for k, (name, steps) in enumerate(BUBBLES.walks) if name[2] == "Y"}
    assert got == {k: text + "$" for k, (_, text) in of.items()}
    names = sorted(r.value for r in spark.read.text(f"{out}/names").collect())
    assert names[1:] == sorted(f"{k}\tdonor\tY\t{phase}\t0\t{len(text)}" for k, ((sample, phase, _), text) in of.items() if sample)
    with pytest.raises(SystemExit):
        cli.main(["extract", file, out, "--contig", "nobody"])


def test_tag_array(spark, tmp_path):
    (tmp_path / "c.gfa").write_text(CHOPPED.text())
    n = sum(len(CHOPPED.segments[i][1]) for _, steps in CHOPPED.walks for i, _ in steps) + len(CHOPPED.walks)
    (tmp_path / "c.sa").write_bytes(struct.pack(f"<{n + 1}q", n, *range(n)))
    cli.main(["extract", str(tmp_path / "c.gfa"), str(tmp_path / "t"), "--mode", "tag-array", "--suffix-array", str(tmp_path / "c.sa"), "--node-bp", "2"])
    words = b"".join(bytes(r.words) for r in spark.read.parquet(str(tmp_path / "t/tags")).collect())
    found = struct.unpack(f"<{n}q", words)
    assert sorted(found)[: len(CHOPPED.walks)] == [0] * len(CHOPPED.walks) and found[0] == 1 << 11 and found[1] == (1 << 11) + 1


def test_search(spark, file, capsys):
    cli.main(["search", file, "--length", "3", "--digits", "0"])
    assert f"{sum(max(0, len(steps) - 2) for _, steps in BUBBLES.walks)} queries of 3 nodes" in capsys.readouterr().out

"""Byte codes and arriving walks."""

import random

from walkframe.functions import bytecode
from walkframe.operators import navigation, order, search
from walkframe.streaming.arrivals import arriving_walks, subpath_counts


def varint(x):
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes(out + bytes([x]))


def run_code(value, n, sigma):
    if not 0 < sigma < 255:
        return varint(value) + varint(n - 1)
    short = 256 // sigma
    return bytes([value + sigma * (n - 1)]) if n < short else bytes([value + sigma * (short - 1)]) + varint(n - short)


def test_integers(spark):
    rng = random.Random(1)
    rows = [[0, 1, 127, 128, 16383, 16384, (1 << 62) - 1], []] + [[rng.getrandbits(rng.randint(1, 62)) for _ in range(20)] for _ in range(20)]
    df = spark.createDataFrame([(r,) for r in rows], "v array<long>").withColumn("code", bytecode.encode_integers("v"))
    for r in df.withColumn("back", bytecode.decode_integers("code")).collect():
        assert bytes(r.code) == b"".join(map(varint, r.v)) and r.back == r.v
    cut = spark.createDataFrame([(bytearray(b"\x05\x80"),)], "c binary").select(bytecode.decode_integers("c").alias("v")).first().v
    assert cut == [5]


def test_runs(spark):
    rng = random.Random(2)
    for sigma in (1, 4, 254, 255, 14901, 0):
        top = sigma or 1 << 40
        runs = [(rng.randrange(top), rng.choice([1, 2, 63, 64, 65, 1000, 1 << 33])) for _ in range(50)]
        df = spark.createDataFrame([(runs,)], "r array<struct<value:long,len:long>>").withColumn("code", bytecode.encode_runs("r", sigma))
        row = df.withColumn("back", bytecode.decode_runs("code", sigma)).first()
        assert bytes(row.code) == b"".join(run_code(v, n, sigma) for v, n in runs)
        assert [tuple(x) for x in row.back] == runs


def test_records_as_bytes(spark):
    visit = spark.createDataFrame([(0, 0, 2), (0, 1, 4), (1, 0, 2), (1, 1, 5), (2, 0, 2), (2, 1, 4)], "path_id long, pos long, g long")
    records = order.with_next(order.visit_order(navigation.bidirectional(visit)))
    got = {r.g: bytes(r.code) for r in order.encoded_records(records).collect()}
    # handle 2: successor 4 from offset 1 (the mirror of walk 1 starts there), 5 from offset 2; ranks by sequence 0, 1, 0
    assert got[2] == bytes([2, 4, 1, 1, 2]) + run_code(0, 1, 2) + run_code(1, 1, 2) + run_code(0, 1, 2)


def test_arriving_walks(spark, tmp_path):
    folder = tmp_path / "walks"
    folder.mkdir()
    walks = [[2, 4, 6], [2, 4, 8, 6], [], [7, 5, 3]]
    query = subpath_counts(arriving_walks(spark, str(folder)), 2).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        for i, w in enumerate(walks):
            (folder / f"{i}.txt").write_text(",".join(map(str, w)) + "\n")
            query.processAllAvailable()
        got = {tuple(r.pattern): r.n for r in spark.table("counts").collect()}
    finally:
        query.stop()
    visit = spark.createDataFrame([(p, i, g) for p, w in enumerate(walks) for i, g in enumerate(w)], "path_id long, pos long, g long")
    want = {tuple(r.pattern): r.n for r in search.all_subpaths(visit, 2).where("k = 2").collect()}
    assert got == want

from walkframe.operators import metadata


def test_names_are_numbered_in_ranges(spark):
    names = [f"n{i * 7919 % 5000}" for i in range(6000)] + ["", "\u00e9", "Z"]
    got = metadata.dictionary(spark.createDataFrame([(n,) for n in names], "name string"))
    want = sorted(set(names), key=lambda n: n.encode())
    assert sorted((r.id, r.name) for r in got.collect()) == list(enumerate(want))
    assert "row_number" not in got._jdf.queryExecution().toString()

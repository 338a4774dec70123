"""Near-duplicates: one row of each group, counted."""

from walkframe.llm import simhash

A, B, C = ("alpha beta gamma delta epsilon", "one two three four five six", "nothing else is like this text here")


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    out = simhash.near_deduplicate(df)
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_rows_without_an_id(spark):
    # a text that only rows without an id have keeps one of them; where a row has an id, that is kept
    rows = [(None, A, "x"), (None, A, "y"), (7, B, "x"), (None, B, "x"), (None, C, "x")]
    assert kept(spark, rows) == sorted([(None, A), (7, B), (None, C)], key=str)


def test_rows_that_share_an_id(spark):
    rows = [(1, A, "x"), (1, A, "x"), (1, A, "other"), (2, A, "x"), (3, B, "x"), (3, C, "x"), (4, None, "x"), (4, "", "x")]
    got = kept(spark, rows)
    assert [i for i, _ in got] == [1, 3, 3, 4] and {t for i, t in got if i == 3} == {B, C}

"""The pipeline over rows of every kind, and over none."""

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `row` string, score string"
KIND = "the river runs past the old stone mill and nobody minds the noise of it "
ROWS = [(1, KIND * 3, "en", "a"), (1, KIND * 3, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n", "en", None), (None, "a garden of letters and paper flowers", "en", "b"), (6, "Mr. Smith wrote to me@corp.org; Smith waits", "en", "b"), (7, KIND * 4000, "en", "b")]


@pytest.mark.parametrize("empty", [False, True])
def test_rows(spark, tmp_path, empty):
    rows = spark.createDataFrame([(i, t, lang, s, len(t or ""), "clash", "clash") for i, t, lang, s in ROWS], DOCS)
    rows.where("false" if empty else "true").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(1, 1, 0), (3, 1, 0), (6, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("false" if empty else "true").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if empty:
        assert got == []
    else:
        assert {r.doc_id for r in got} <= {1, None, 6, 7} and got and all(r.n_tokens > 0 for r in got)

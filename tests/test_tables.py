"""Tables of a graph that aren't there are None; tables that can't be read are an error."""

import pytest
from pyspark.errors import AnalysisException

from walkframe.model import PathGraph


def test_missing_and_broken(spark, tmp_path):
    visit = spark.createDataFrame([(0, 0, 2)], "path_id long, pos long, g long")
    PathGraph(visit, visit.selectExpr("1L node_id", "'A' seq")).write(str(tmp_path))
    graph = PathGraph.read(spark, str(tmp_path))
    assert graph.segment is None and graph.tag is None and graph.visit.count() == 1
    (tmp_path / "tag").mkdir()
    with pytest.raises(AnalysisException):
        PathGraph.read(spark, str(tmp_path))

"""The tables of a path graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class PathGraph:
    """A bidirected sequence graph and the walks that it is made of, as lazy DataFrames.

    ``visit(path_id, pos, g)``: forward walks, one row a step, ``g`` a handle;
    ``node(node_id, seq)``: nodes that a walk visits; ``segment(seg_id, name, seq, node_lo, node_hi)``:
    named runs of consecutive nodes, or None; ``path(path_id, sample_id, contig_id, phase, fragment)``,
    ``sample(sample_id, name)``, ``contig(contig_id, name)``: names, or None; ``tag(scope, key, value)``.
    """

    visit: DataFrame
    node: DataFrame
    segment: DataFrame | None = None
    path: DataFrame | None = None
    sample: DataFrame | None = None
    contig: DataFrame | None = None
    tag: DataFrame | None = None

    def write(self, path: str) -> None:
        """Persist every table as Parquet: visits by path, nodes by id, for row-group pruning."""
        for name in ("visit", "node", "segment", "path", "sample", "contig", "tag"):
            table: DataFrame | None = getattr(self, name)
            if table is not None:
                order = {"visit": ["path_id", "pos"], "node": ["node_id"]}.get(name)
                (table.sortWithinPartitions(*order) if order else table).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str) -> "PathGraph":
        from pyspark.errors import AnalysisException

        tables = {}
        for name in ("visit", "node", "segment", "path", "sample", "contig", "tag"):
            try:
                tables[name] = spark.read.parquet(f"{path}/{name}")
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                tables[name] = None
        return cls(**tables)


def names_of_paths(graph: PathGraph) -> DataFrame:
    """``path`` with ``sample`` and ``contig`` as text: the name, or the id where there is none."""
    s = graph.sample.withColumnRenamed("name", "sample")
    c = graph.contig.withColumnRenamed("name", "contig")
    return (
        graph.path.join(s, "sample_id", "left")
        .join(c, "contig_id", "left")
        .select(
            "path_id", "sample_id", "contig_id", "phase", "fragment",
            F.coalesce("sample", F.col("sample_id").cast("string")).alias("sample"),
            F.coalesce("contig", F.col("contig_id").cast("string")).alias("contig"),
        )
    )

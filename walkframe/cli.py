"""Command line: render a graph as GFA, extract sequences or tags of a contig, time subpath search.

    python -m walkframe.cli render GRAPH OUT [--paths default|pan-sn|ref-only]
    python -m walkframe.cli extract GRAPH OUT [--contig NAME] [--mode sequences|tag-array] [--end CHAR] [--suffix-array FILE] [--bwt FILE] [--raw]
    python -m walkframe.cli search GRAPH [--length 10] [--digits 2]

GRAPH is a GFA file (or a folder of its parts), or a folder that ``PathGraph.write`` made.
``--raw`` writes plain bytes: parts that are one file in the order of their names. ``--bwt`` counts runs of tags and of that file's bytes.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from walkframe.model import PathGraph
from walkframe.operators import contigs, search, tags
from walkframe.sources import gfa, sinks


def load(spark: SparkSession, path: str, node_bp: int = 1024) -> PathGraph:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stored = files.exists(jvm.org.apache.hadoop.fs.Path(path, "visit"))
    return PathGraph.read(spark, path) if stored else gfa.read_gfa(spark, path, node_bp)


def selected(graph: PathGraph, contig: str | None) -> DataFrame | None:
    """Paths of the contig's components, or None for all paths; an unknown contig is an error."""
    if contig is None:
        return None
    found = graph.contig.where(F.col("name") == contig).select("contig_id").first()
    if found is None:
        raise SystemExit(f"no contig {contig}")
    return contigs.paths_of_contig(graph.visit, graph.path, found.contig_id, contigs.node_components(graph.visit))


def extract(spark: SparkSession, graph: PathGraph, out: str, contig: str | None, mode: str, end: str, suffix_array: str | None, bwt: str | None = None, raw: bool = False) -> None:
    """Write ``OUT/sequences`` and ``OUT/names``, or ``OUT/tags`` in the order of a suffix array of the sequences."""
    paths = selected(graph, contig)
    if mode == "sequences":
        if raw:
            sinks.write_dump(graph, f"{out}/sequences", paths, end)
        else:
            sinks.sequence_dump(graph, paths, end).orderBy("path_id").write.mode("overwrite").parquet(f"{out}/sequences")
        sinks.names_lines(graph, paths).orderBy("path_id").select("line").write.mode("overwrite").text(f"{out}/names")
        return
    if suffix_array is None:
        raise SystemExit("tag-array needs --suffix-array")
    visit = graph.visit if paths is None else graph.visit.join(paths, "path_id", "left_semi")
    found = tags.tag_array(tags.tags_of_text(visit, graph.node, sinks.path_starts(graph, paths)), gfa.read_suffix_array(spark, suffix_array))
    (sinks.write_tag_words if raw else sinks.write_tags)(found, f"{out}/tags")
    if bwt is not None:
        print(tags.count_runs(found, "rank", "tag").first().runs, "runs of tags")
        print(tags.count_runs(gfa.read_bwt(spark, bwt), "rank", "symbol").first().runs, "runs of the BWT")


def time_search(graph: PathGraph, length: int, digits: int) -> str:
    """Sample subpaths, count them all, and say how long it took."""
    queries = search.sample_patterns(graph.visit, length, digits).cache()
    n, began = queries.count(), time.perf_counter()
    total = search.count_occurrences(graph.visit, queries, [length]).agg(F.sum("n")).first()[0] or 0
    took = time.perf_counter() - began
    each = took / max(n, 1)
    return f"{n} queries of {length} nodes in {took:.3f} s: {each * 1e6:.1f} us/query, {each / length * 1e9:.1f} ns/node, {total} occurrences"


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="walkframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("render", "extract", "search"):
        c = commands.add_parser(name)
        c.add_argument("graph")
        c.add_argument("--node-bp", type=int, default=1024, help="longest node when a GFA file is chopped")
        if name != "search":
            c.add_argument("out")
        if name == "render":
            c.add_argument("--paths", choices=("default", "pan-sn", "ref-only"), default="default")
        if name == "extract":
            c.add_argument("--contig")
            c.add_argument("--mode", choices=("sequences", "tag-array"), default="sequences")
            c.add_argument("--end", default="\0", help="character after each sequence")
            c.add_argument("--suffix-array")
            c.add_argument("--bwt")
            c.add_argument("--raw", action="store_true")
        if name == "search":
            c.add_argument("--length", type=int, default=10)
            c.add_argument("--digits", type=int, default=2, help="about one visit in 16 ** DIGITS starts a query")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("walkframe").getOrCreate()
    graph = load(spark, a.graph, a.node_bp)
    if a.command == "render":
        sinks.write_gfa(graph, a.out, a.paths)
    elif a.command == "extract":
        extract(spark, graph, a.out, a.contig, a.mode, a.end, a.suffix_array, a.bwt, a.raw)
    else:
        print(time_search(graph, a.length, a.digits))


if __name__ == "__main__":
    main()

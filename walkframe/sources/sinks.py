"""Graphs as text: GFA lines, sequence dumps, names files, tag arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from walkframe.functions.dna import oriented, step_prefix, step_suffix
from walkframe.functions.handles import edge_is_canonical, flip, id_of, is_reverse
from walkframe.functions.names import GENERIC_SAMPLE, pansn_name
from walkframe.model import PathGraph, names_of_paths
from walkframe.operators.chains import in_blocks, whole_blocks
from walkframe.operators.metadata import reference_samples
from walkframe.operators.navigation import canonical_edges
from walkframe.operators.positions import path_dna, path_lengths, path_offsets, text_offsets
from walkframe.operators.prefix import large
from walkframe.operators.segments import RUN, chosen, fits, links_entered, mirrored, runs_of_visits, segment_links, segment_paths_exact, segment_pieces, used_segments, whole_walks
from walkframe.session import stored
from walkframe.sources.raw import write_in_order, write_words

TAB = "\t"


def gfa_header(graph: PathGraph) -> DataFrame:
    """The H line, with reference samples if there are any."""
    names = reference_samples(graph)
    refs = names.agg(F.sort_array(F.collect_list(F.struct("ordinal", "name"))).alias("n"))
    text = F.array_join(F.transform("n", lambda x: x["name"]), " ")
    return refs.select(F.concat(F.lit("H\tVN:Z:1.1"), F.when(F.size("n") > 0, F.concat(F.lit("\tRS:Z:"), text)).otherwise("")).alias("line"))


def gfa_segments(graph: PathGraph, used: DataFrame | None = None) -> DataFrame:
    """S lines with ``ordinal``: used segments, or nodes where there are no segments."""
    if graph.segment is None:
        return graph.node.select(F.col("node_id").alias("ordinal"), F.concat_ws(TAB, F.lit("S"), F.col("node_id").cast("string"), "seq").alias("line"))
    used = used_segments(graph.segment, graph.node) if used is None else used
    return used.select(F.col("seg_id").alias("ordinal"), F.concat_ws(TAB, F.lit("S"), "name", "seq").alias("line"))


def gfa_links(graph: PathGraph, rows: DataFrame | None = None) -> DataFrame:
    """L lines: each link once, in its canonical orientation by segment (or node) number; ``rows`` of ``rows_of_walks`` are used if they are there."""
    sign = lambda g: F.when(is_reverse(g), "-").otherwise("+")
    if graph.segment is None:
        e = canonical_edges(graph.visit)
        a, b = id_of("g").cast("string"), id_of("next_g").cast("string")
    elif rows is not None:
        found = in_blocks(rows, links_entered, "g long, next_g long, a_name string, b_name string")
        # of a link and its mirror image, one way is canonical
        kept = edge_is_canonical("g", "next_g")
        one, other = F.struct("g", "next_g", "a_name", "b_name"), F.struct(flip("next_g").alias("g"), flip("g").alias("next_g"), F.col("b_name").alias("a_name"), F.col("a_name").alias("b_name"))
        e = found.select(F.when(kept, one).otherwise(other).alias("e")).select("e.*").distinct()
        a, b = F.col("a_name"), F.col("b_name")
    else:
        links = mirrored(segment_links(graph.segment, graph.node, graph.visit))
        name = graph.segment.select(F.col("seg_id"), "name")
        e = (
            links.where(edge_is_canonical("g", "next_g"))
            .join(name.select(F.col("seg_id").alias("a_id"), F.col("name").alias("a_name")), id_of("g") == F.col("a_id"))
            .join(name.select(F.col("seg_id").alias("b_id"), F.col("name").alias("b_name")), id_of("next_g") == F.col("b_id"))
        )
        a, b = F.col("a_name"), F.col("b_name")
    return e.select("g", "next_g", F.concat_ws(TAB, F.lit("L"), a, sign("g"), b, sign("next_g"), F.lit("*")).alias("line"))


def walk_steps(graph: PathGraph, paths: DataFrame | None = None) -> DataFrame:
    """``(path_id, n, name, is_rev)``: walks (of ``paths`` only, if given) over segments, or over nodes where there are no segments."""
    visit = graph.visit if paths is None else graph.visit.join(paths, "path_id", "left_semi")
    if graph.segment is None:
        return visit.select("path_id", F.col("pos").alias("n"), id_of("g").cast("string").alias("name"), is_reverse("g").alias("is_rev"))
    walks = segment_paths_exact(visit, graph.segment)
    return walks.join(graph.segment.select("seg_id", "name"), "seg_id").select("path_id", F.col("seg_no").alias("n"), "name", "is_rev")


def rendered(steps: DataFrame, render, separator: str, block: int = 1 << 12) -> DataFrame:
    """``(path_id, walk)``: text of blocks of steps first; only these meet in the line."""

    def joined(rows: DataFrame, order: str, text: Column, *keys: str) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct(order, text.alias("text"))))
        return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["text"]), separator).alias("walk"))

    placed = steps.withColumn("block", F.call_function("div", F.col("n"), F.lit(block)))
    blocks = joined(placed, "n", render("name", "is_rev"), "path_id", "block")
    return joined(blocks, "block", F.col("walk"), "path_id")


def p_lines(names: DataFrame, steps: DataFrame) -> DataFrame:
    walks = rendered(steps, step_suffix, ",")
    rows = names.join(walks, "path_id", "left")
    return rows.select("path_id", F.concat_ws(TAB, F.lit("P"), "path_name", F.coalesce("walk", F.lit("")), F.lit("*")).alias("line"))


def gfa_paths(graph: PathGraph, steps: DataFrame | None = None) -> DataFrame:
    """P lines of plainly named paths; ``steps`` of all walks are used if they are there."""
    names = names_of_paths(graph).where(F.col("sample") == GENERIC_SAMPLE).select("path_id", F.col("contig").alias("path_name"))
    return p_lines(names, walk_steps(graph, names.select("path_id")) if steps is None else steps)


def gfa_pansn(graph: PathGraph) -> DataFrame:
    """P lines of all paths, by sample, haplotype and contig; fragments of one haplotype share a name."""
    return p_lines(names_of_paths(graph).select("path_id", pansn_name("sample", "phase", "contig").alias("path_name")), walk_steps(graph))


def gfa_walks(graph: PathGraph, steps: DataFrame | None = None) -> DataFrame:
    """W lines of all but plainly named paths; ``steps`` of all walks are used if they are there."""
    steps = stored(walk_steps(graph)) if steps is None else steps  # read twice
    walks = rendered(steps, step_prefix, "")
    if graph.segment is None:
        bp = path_lengths(graph.visit, graph.node).select("path_id", "bp")
    else:
        bp = steps.join(graph.segment.select("name", F.length("seq").cast("long").alias("n_bp")), "name").groupBy("path_id").agg(F.sum("n_bp").alias("bp"))
    named = names_of_paths(graph).where(F.col("sample") != GENERIC_SAMPLE)
    rows = named.join(walks, "path_id", "left").join(bp, "path_id", "left")
    end = F.col("fragment") + F.coalesce("bp", F.lit(0))
    text = [F.lit("W"), F.col("sample"), F.col("phase").cast("string"), F.col("contig"), F.col("fragment").cast("string"), end.cast("string"), F.coalesce("walk", F.lit(""))]
    return rows.select("path_id", F.concat_ws(TAB, *text).alias("line"))


def lined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(path_id, generic, head, fragment, bp, walk)`` of whole walks: for each row at position -1, a name, the walk as the steps of a P line or of a W line."""
    for t, at in whole_blocks(batches):
        pos = t.column("pos").to_numpy()
        names = np.flatnonzero(pos < 0)
        if not len(names):
            continue
        number = np.zeros(len(pos), dtype=np.int64)
        number[at[1:]] = 1
        number = np.cumsum(number)
        runs = np.flatnonzero(pos >= 0)
        steps = t.take(pa.array(runs))
        rows = chosen(steps) if len(runs) else runs
        steps, of = steps.take(pa.array(rows)), number[runs[rows]]
        bp = np.concatenate([[0], np.cumsum(steps.column("bp").fill_null(0).to_numpy())])
        named = steps.column("name").is_valid()
        ends = np.searchsorted(of, np.arange(len(at) + 1))
        bp = bp[ends[1:]] - bp[ends[:-1]]
        steps, of = steps.filter(named), of[named.to_numpy()]
        ends = pa.array(np.searchsorted(of, np.arange(len(at) + 1)), pa.int32())
        name, rev = (steps.column(c).combine_chunks() for c in ("name", "is_rev"))
        text = lambda parts, end: pc.binary_join(pa.ListArray.from_arrays(ends, pc.binary_join_element_wise(*parts, "")), end)
        asked = t.take(pa.array(names))
        as_p = text((name, pc.if_else(rev, "-", "+")), ",").take(pa.array(number[names]))
        as_w = text((pc.if_else(rev, "<", ">"), name), "").take(pa.array(number[names]))
        generic = asked.column("generic").combine_chunks()
        columns = [asked.column("walk"), generic, asked.column("head"), asked.column("fragment"), pa.array(bp[number[names]]), pc.if_else(generic, as_p, as_w)]
        yield from pa.table(columns, ["path_id", "generic", "head", "fragment", "bp", "walk"]).combine_chunks().to_batches()


#: What is known of a name in a row of a walk, beside what its pieces have.
NAME = {"generic": "boolean", "head": "string", "fragment": "long"}


def rows_of_walks(pieces: DataFrame, heads: DataFrame) -> DataFrame:
    """Pieces of walks and, at position -1, ``(path_id, generic, head, fragment)`` of their names: what meets in a line meets in one shuffle."""
    none = lambda names: [F.lit(None).cast(t).alias(c) for c, t in names.items()]
    rest = {f.name: f.dataType.simpleString() for f in pieces.schema if f.name not in ("path_id", "pos", "is_rev")}
    named = heads.select("path_id", F.lit(-1).cast("long").alias("pos"), F.lit(False).alias("is_rev"), *none(rest), *NAME)
    return whole_walks(pieces.select("path_id", "pos", "is_rev", *rest, *none(NAME)).union(named))


def heads_of_paths(graph: PathGraph, mode: str) -> DataFrame:
    """``(path_id, generic, head, fragment)``: how a path's line begins, ``generic`` if it is a P line."""
    names = names_of_paths(graph)
    if mode == "pan-sn":
        return names.select("path_id", F.lit(True).alias("generic"), F.concat_ws(TAB, F.lit("P"), pansn_name("sample", "phase", "contig")).alias("head"), "fragment")
    generic = F.col("sample") == GENERIC_SAMPLE
    names = names.where(generic if mode == "ref-only" else generic.isNotNull())
    p, w = F.concat_ws(TAB, F.lit("P"), "contig"), F.concat_ws(TAB, F.lit("W"), "sample", F.col("phase").cast("string"), "contig", F.col("fragment").cast("string"))
    return names.select("path_id", generic.alias("generic"), F.when(generic, p).otherwise(w).alias("head"), "fragment")


def path_lines(rows: DataFrame) -> DataFrame:
    """``(path_id, generic, line)``: P lines of generic paths, W lines of others; a line is made in one pass over a walk's pieces."""
    made = in_blocks(rows, lined, "path_id long, generic boolean, head string, fragment long, bp long, walk string")
    end = (F.col("fragment") + F.col("bp")).cast("string")
    line = F.when(F.col("generic"), F.concat_ws(TAB, "head", "walk", F.lit("*"))).otherwise(F.concat_ws(TAB, "head", end, "walk"))
    return made.select("path_id", "generic", line.alias("line"))


def pieces_of_lines(graph: PathGraph, used: DataFrame) -> DataFrame:
    """Pieces of all walks, with what lines say of a segment, and whether it is among the used ones."""
    known = large(graph.segment).select("seg_id", "name", "node_lo", "node_hi", F.length("seq").cast("long").alias("bp"))
    known = known.join(large(used).select("seg_id", F.lit(True).alias("used")), "seg_id", "left").withColumn("used", F.coalesce("used", F.lit(False)))
    return stored(segment_pieces(graph.visit, known, ("name", "bp", "used")))


def gfa(graph: PathGraph, mode: str = "default") -> DataFrame:
    """``(part, a, b, line)``: all lines; sorted by the first three they make a file.

    ``mode``: ``default`` (P and W lines), ``pan-sn`` (P lines of all paths), ``ref-only`` (no W lines). Walks are taken to their segments once; links
    and lines of walks of one block each come from one shuffle of the pieces.
    """
    zero = F.lit(0).cast("long")

    def part(lines: DataFrame, n: int, *place: str) -> DataFrame:
        at = [F.col(c) for c in place] + [zero] * (2 - len(place))
        return lines.select(F.lit(n).alias("part"), at[0].alias("a"), at[1].alias("b"), "line")

    parts = [part(gfa_header(graph), 0)]
    if graph.segment is not None:
        used = stored(used_segments(graph.segment, graph.node))
        pieces = pieces_of_lines(graph, used)
        # a segment without nodes has links at its neighbours' nodes
        if fits(pieces) and used.where("node_lo >= node_hi").isEmpty():
            rows = rows_of_walks(pieces, heads_of_paths(graph, mode))
            lines = path_lines(rows).select(F.when(F.col("generic"), 3).otherwise(4).alias("part"), F.col("path_id").alias("a"), zero.alias("b"), "line")
            return reduce(DataFrame.union, [*parts, part(gfa_segments(graph, used), 1, "ordinal"), part(gfa_links(graph, rows), 2, "g", "next_g"), lines])
    parts += [part(gfa_segments(graph), 1, "ordinal"), part(gfa_links(graph), 2, "g", "next_g")]
    if mode == "pan-sn":
        parts += [part(gfa_pansn(graph), 3, "path_id")]
    else:
        steps = None if mode == "ref-only" else stored(walk_steps(graph))
        parts += [part(gfa_paths(graph, steps), 3, "path_id")]
        if mode != "ref-only":
            parts += [part(gfa_walks(graph, steps), 4, "path_id")]
    return reduce(DataFrame.union, parts)


def write_gfa(graph: PathGraph, path: str, mode: str = "default") -> None:
    """A folder of text files that are one GFA file in the order of their names."""
    gfa(graph, mode).orderBy("part", "a", "b").select("line").write.mode("overwrite").text(path)


def sequence_dump(graph: PathGraph, paths: DataFrame | None = None, end: str = "\0") -> DataFrame:
    """``(path_id, text)``: DNA of each selected path and an end after it."""
    visit = graph.visit if paths is None else graph.visit.join(paths, "path_id", "left_semi")
    return path_dna(visit, graph.node).select("path_id", F.concat("dna", F.lit(end)).alias("text"))


def path_starts(graph: PathGraph, paths: DataFrame | None = None) -> DataFrame:
    """``(path_id, bp, offset)``: where each (selected) path begins in the dump; a path without visits is an end alone."""
    bp = path_lengths(graph.visit, graph.node).select("path_id", "bp")
    if graph.path is not None:
        bp = graph.path.select("path_id").join(bp, "path_id", "left").select("path_id", F.coalesce("bp", F.lit(0).cast("long")).alias("bp"))
    return text_offsets(bp if paths is None else bp.join(paths, "path_id", "left_semi"))


def dump_pieces(graph: PathGraph, paths: DataFrame | None = None, end: str = "\0") -> DataFrame:
    """``(at, data)``: the dump in pieces, one a visit and one an end, each with its first byte; no walk meets in a row."""
    if len(end.encode()) != 1:
        raise ValueError("an end is one byte")
    starts = path_starts(graph, paths)
    at = path_offsets(graph.visit, graph.node).withColumnRenamed("offset", "in_path").withColumn("node_id", id_of("g"))
    pieces = at.join(graph.node, "node_id").join(starts.select("path_id", "offset"), "path_id")
    ends = starts.select((F.col("offset") + F.col("bp")).alias("at"), F.lit(end).cast("binary").alias("data"))
    return pieces.select((F.col("offset") + F.col("in_path")).alias("at"), oriented("seq", "g").cast("binary").alias("data")).union(ends)


#: Ids of nodes whose sequences are read together, and what a byte of them is on the other strand.
NODES = 1 << 6
OTHER = bytes({"A": "T", "C": "G", "G": "C", "T": "A"}.get(chr(b).upper(), "N").encode()[0] for b in range(256))


def dna_of_runs(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``(path_id, pos, data)`` of nodes (no ``path_id``) and then runs of each ``part``: the bytes along each run. Nodes of one part are held."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        is_run = t.column("path_id").is_valid()
        node, run = t.filter(pc.invert(is_run)), t.filter(is_run)
        node = (node if held is None else pa.concat_tables([held, node])).combine_chunks()
        of, at = (node.column(c).to_numpy() for c in ("part", "lo"))
        held, at = node.slice(int(np.searchsorted(of, t.column("part")[-1].as_py()))), of * width + at
        if not run.num_rows:
            continue
        seqs = [x or b"" for x in node.column("seq").to_pylist()]
        before, text = np.concatenate([[0], np.cumsum([len(x) for x in seqs], dtype=np.int64)]), b"".join(seqs)
        part, lo, n, rev = (run.column(c).to_numpy() for c in ("part", "lo", "len", "is_rev"))
        lo = part * width + lo
        begin, end = before[np.searchsorted(at, lo)], before[np.searchsorted(at, lo + n)]
        # the other strand lies behind the one that nodes have
        both = text + text.translate(OTHER)[::-1]
        begin, end = np.where(rev, len(both) - end, begin), np.where(rev, len(both) - begin, end)
        data = pa.array([both[i:j] for i, j in zip(begin.tolist(), end.tolist())], pa.binary())
        yield from pa.table([run.column("path_id"), run.column("pos"), data], ["path_id", "pos", "data"]).combine_chunks().to_batches()


def dump_runs(graph: PathGraph, paths: DataFrame | None = None, end: str = "\0", width: int = NODES) -> DataFrame:
    """``(path_id, pos, data)``: the dump in pieces that follow each other by walk and position, one a run of visits over the next ids and one an end."""
    if len(end.encode()) != 1:
        raise ValueError("an end is one byte")
    known = (graph.visit.select("path_id").distinct() if graph.path is None else graph.path.select("path_id")) if paths is None else paths.select("path_id")
    if paths is not None and graph.path is not None:
        known = graph.path.select("path_id").join(known, "path_id", "left_semi")
    known = stored(known)
    # a table for each task, so visits stay in their order
    visit = graph.visit.join(known.hint("shuffle_hash"), "path_id", "left_semi").select("path_id", "pos", "g")
    runs = visit.mapInArrow(lambda x: runs_of_visits(x, width), RUN).select("part", "lo", "len", "path_id", "pos", "is_rev", F.lit(None).cast("binary").alias("seq"))
    part = F.floor(F.col("node_id") / width)
    none = [F.lit(None).cast(t) for t in ("long", "long", "boolean")]
    nodes = graph.node.select(part.alias("part"), (F.col("node_id") - part * width).alias("lo"), F.lit(1).cast("long").alias("len"), *none, F.col("seq").cast("binary").alias("seq"))
    both = runs.union(nodes).repartition("part").sortWithinPartitions("part", F.col("path_id").isNotNull(), "lo")
    found = both.mapInArrow(lambda x: dna_of_runs(x, width), "path_id long, pos long, data binary")
    return found.union(known.select("path_id", F.lit(2**63 - 1).alias("pos"), F.lit(end).cast("binary").alias("data")))


def write_dump(graph: PathGraph, path: str, paths: DataFrame | None = None, end: str = "\0") -> None:
    """The dump as plain bytes, in parts that are one file in the order of their names; no walk meets in a row."""
    write_in_order(dump_runs(graph, paths, end), path, "path_id", "pos")


def names_lines(graph: PathGraph, paths: DataFrame | None = None) -> DataFrame:
    """``(path_id, line)`` of a names file: path, sample, contig, phase, fragment, length."""
    n = names_of_paths(graph).join(path_lengths(graph.visit, graph.node).select("path_id", "bp"), "path_id", "left")
    n = n if paths is None else n.join(paths, "path_id", "left_semi")
    text = [F.col("path_id").cast("string"), "sample", "contig", F.col("phase").cast("string"), F.col("fragment").cast("string"), F.coalesce("bp", F.lit(0)).cast("string")]
    return n.select("path_id", F.concat_ws(TAB, *text).alias("line"))


def write_tags(tags: DataFrame, path: str) -> None:
    """``(rank, tag)`` as little-endian 64-bit words, one file a range of ranks; in name order they are the array."""

    def words(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().astype("<i8").tobytes()], pa.binary())], ["words"])

    ordered = tags.repartitionByRange("rank").sortWithinPartitions("rank").select(F.col("tag").cast("long"))
    ordered.mapInArrow(words, "words binary").write.mode("overwrite").parquet(path)


def write_tag_words(tags: DataFrame, path: str) -> None:
    """``(rank, tag)`` as little-endian 64-bit words and nothing else, in parts that are one file in the order of their names."""
    write_words(tags.select(F.col("rank").alias("at"), F.col("tag").alias("value")), path)

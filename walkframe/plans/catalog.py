"""Every operator over the test tables' path graphs, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from walkframe.functions import dna, handles, names
from walkframe.model import PathGraph, names_of_paths
from walkframe.operators import contigs, lcs, lcs_tiles, metadata, navigation, order, positions, ranks, search, segments, subpaths, tags
from walkframe.operators.components import contracted_components, join_components
from walkframe.plans.base_sql import BASE, EDGES, ORDER
from walkframe.session import cut, shared_path, stored
from walkframe.sources import gfa as gfa_files, raw, sinks
from walkframe.sources.projection import event_graph, order_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def over(graph: Callable[[SparkSession, str], PathGraph], sql: str, *tables: str):
    """Register a function of a graph under its name, with the SELECT that it equals."""

    def register(f: Callable[[PathGraph], DataFrame]) -> Callable[[PathGraph], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(graph(spark, sf_dir))
        ORACLE_SQL[f.__name__] = BASE + "".join(tables) + sql
        return f

    return register


def text(array):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), " ")


# ---------------------------------------------------------------- statistics, nodes, handles


@over(order_graph, """
SELECT (2 * count(*) + 2 * count(DISTINCT path_id))::BIGINT AS size, (2 * count(DISTINCT path_id))::BIGINT AS sequences,
  2 * max(g // 2) + 2 AS alphabet_size, 2 * min(g // 2) - 1 AS alphabet_offset, 2 * max(g // 2) + 2 - (2 * min(g // 2) - 1) AS effective_size,
  2 * min(g // 2) AS first_node, count(DISTINCT g // 2) AS nodes, min(g // 2) AS min_node, max(g // 2) AS max_node, count(DISTINCT path_id) AS paths
FROM fvisit""")
def graph_stats(g):
    return navigation.statistics(g.visit)


@over(order_graph, "SELECT node_id FROM node")
def node_scan(g):
    return g.node.select("node_id")


@over(order_graph, "SELECT node_id, seq, length(seq)::INTEGER AS bp FROM node")
def node_sequences(g):
    return g.node.select("node_id", "seq", F.length("seq").alias("bp"))


@over(order_graph, """
SELECT node_id, node_id BETWEEN (SELECT min(g // 2) FROM fvisit) AND (SELECT max(g // 2) FROM fvisit) AS in_range,
  node_id IN (SELECT node_id FROM node) AS has_node
FROM (SELECT unnest(range(node_lo, node_hi)) AS node_id FROM segment)""")
def has_node(g):
    return navigation.has_node(g.visit, segments.node_to_segment(g.segment).select("node_id"))


@over(order_graph, """
SELECT node_id FROM (SELECT unnest(range(node_lo, node_hi)) AS node_id FROM segment)
EXCEPT SELECT node_id FROM node""")
def unused_nodes(g):
    return segments.node_to_segment(g.segment).select("node_id").join(g.node, "node_id", "left_anti")


@over(order_graph, """
SELECT DISTINCT g, g // 2 AS id, CASE WHEN g % 2 = 1 THEN 'reverse' ELSE 'forward' END AS orientation, xor(g, 1) AS flipped FROM fvisit""")
def handle_codec(g):
    h = g.visit.select("g").distinct()
    again = handles.encode(handles.id_of("g"), handles.is_reverse("g"))
    return h.select(again.alias("g"), handles.id_of("g").alias("id"), handles.orientation_name(handles.is_reverse("g")).alias("orientation"), handles.flip("g").alias("flipped"))


@over(order_graph, "SELECT DISTINCT seq_id, seq_id // 2 AS path_id, seq_id % 2 = 1 AS is_rev, xor(seq_id, 1) AS mirror FROM visit")
def path_codec(g):
    s = navigation.bidirectional(g.visit).select("seq_id").distinct()
    return s.select("seq_id", handles.id_of("seq_id").alias("path_id"), handles.is_reverse("seq_id").alias("is_rev"), handles.flip("seq_id").alias("mirror"))


@over(order_graph, "SELECT node_id, translate(reverse(regexp_replace(upper(seq), '[^ACGT]', 'N', 'g')), 'ACGT', 'TGCA') AS rc FROM node")
def reverse_complement(g):
    return g.node.select("node_id", dna.reverse_complement("seq").alias("rc"))


@over(order_graph, "SELECT node_id, (2 * node_id + 1)::BIGINT AS handle, length(seq)::BIGINT - 1 AS \"offset\" FROM node")
def graph_positions(g):
    p = g.node.select(handles.position("node_id", F.lit(True), F.length("seq").cast("long") - 1).alias("p"))
    return p.select("p.node_id", handles.encode("p.node_id", "p.is_rev").alias("handle"), "p.offset")


# ---------------------------------------------------------------- walks and edges


@over(order_graph, "SELECT seq_id, pos, g FROM visit")
def bidirectional_visits(g):
    return navigation.bidirectional(g.visit)


@over(order_graph, "SELECT g, next_g AS successor FROM edges", EDGES)
def successors(g):
    return navigation.successors(g.visit)


@over(order_graph, "SELECT g, row_number() OVER (PARTITION BY g ORDER BY next_g) AS rank, next_g AS successor FROM edges", EDGES)
def successors_in_order(g):
    w = W.partitionBy("g").orderBy("successor")
    return navigation.successors(g.visit).select("g", F.row_number().over(w).cast("long").alias("rank"), "successor")


@over(order_graph, "SELECT next_g AS g, row_number() OVER (PARTITION BY next_g ORDER BY g // 2, g % 2 DESC) AS rank, g AS predecessor FROM edges", EDGES)
def predecessors_in_order(g):
    # of one node, its reverse before its forward orientation
    w = W.partitionBy("g").orderBy(handles.id_of("predecessor"), handles.is_reverse("predecessor").desc())
    return navigation.predecessors(g.visit).select("g", F.row_number().over(w).cast("long").alias("rank"), "predecessor")


@over(order_graph, "SELECT next_g AS g, g AS predecessor FROM edges", EDGES)
def predecessors(g):
    return navigation.predecessors(g.visit)


@over(order_graph, "SELECT g, count(DISTINCT coalesce(next_g, 0)) AS out_degree FROM nxt GROUP BY g", EDGES)
def out_degree(g):
    return navigation.out_degrees(g.visit)


@over(order_graph, "SELECT g, coalesce(next_g, 0) AS next_g, count(*) AS n FROM nxt GROUP BY ALL", EDGES)
def edge_multiplicity(g):
    return navigation.edge_counts(g.visit)


CANONICAL = "CASE WHEN g % 2 = 0 THEN next_g // 2 >= g // 2 ELSE next_g // 2 > g // 2 OR (next_g // 2 = g // 2 AND next_g % 2 = 0) END"


@over(order_graph, f"SELECT g, next_g FROM edges WHERE {CANONICAL}", EDGES)
def canonical_edges(g):
    return navigation.canonical_edges(g.visit)


@over(order_graph, f"""
SELECT path_id, CASE WHEN g % 2 = next_g % 2 THEN g % 2 = 0 ELSE {CANONICAL} END AS is_canonical
FROM (SELECT path_id, arg_min(g, pos) AS g, arg_max(g, pos) AS next_g FROM fvisit GROUP BY path_id)""")
def canonical_paths(g):
    return navigation.canonical_paths(g.visit)


@over(order_graph, "SELECT path_id, pos, g // 2 AS node_id, g % 2 = 1 AS is_rev FROM fvisit")
def path_nodes_fwd(g):
    return navigation.nodes_of_paths(g.visit)


@over(order_graph, "SELECT seq_id // 2 AS path_id, pos, g // 2 AS node_id, g % 2 = 1 AS is_rev FROM visit WHERE seq_id % 2 = 1")
def path_nodes_rev(g):
    return navigation.nodes_of_paths(g.visit, reverse=True)


@over(order_graph, """
SELECT path_id, array_to_string(list(g ORDER BY pos), ' ') AS walk, array_to_string(list(xor(g, 1) ORDER BY pos DESC), ' ') AS mirrored FROM fvisit GROUP BY path_id""")
def path_array(g):
    a = navigation.path_arrays(g.visit)
    return a.withColumn("m", handles.reverse_path("handles")).select("path_id", text("handles").alias("walk"), text("m").alias("mirrored"))


@over(event_graph, "SELECT seq_id, g, off FROM ord WHERE pos = 0", ORDER)
def path_start(g):
    return order.visit_order(navigation.bidirectional(g.visit)).where("pos = 0").select("seq_id", "g", "off")


@over(event_graph, "SELECT seq_id, pos, g, off, next_g, next_off FROM erec", ORDER)
def path_forward(g):
    return order.with_next(order.visit_order(navigation.bidirectional(g.visit))).select("seq_id", "pos", "g", "off", "next_g", "next_off")


@over(event_graph, """
SELECT seq_id, pos, g, off, lag(g) OVER w AS prev_g, lag(off) OVER w AS prev_off FROM ord WINDOW w AS (PARTITION BY seq_id ORDER BY pos)""", ORDER)
def path_backward(g):
    o = order.visit_order(navigation.bidirectional(g.visit))
    before = F.lag(F.struct("g", "off")).over(W.partitionBy("seq_id").orderBy("pos"))
    return o.withColumn("b", before).select("seq_id", "pos", "g", "off", F.col("b.g").alias("prev_g"), F.col("b.off").alias("prev_off"))


# ---------------------------------------------------------------- order and records


def ordered(g: PathGraph) -> DataFrame:
    return order.visit_order(navigation.bidirectional(g.visit))


@over(event_graph, "SELECT g, off, seq_id, pos FROM ord", ORDER)
def bwt_offsets(g):
    return ordered(g)


@over(event_graph, "SELECT g, off, seq_id, pos FROM ord", ORDER)
def bwt_offsets_doubling(g):
    return order.by_doubling(navigation.bidirectional(g.visit))


@over(event_graph, """
SELECT g, row_number() OVER (PARTITION BY g ORDER BY next_g) - 1 AS edge_rank, next_g, next_off
FROM (SELECT g, next_g, min(next_off) AS next_off FROM erec GROUP BY g, next_g)""", ORDER)
def record_edges(g):
    return order.record_edges(order.with_next(ordered(g)))


@over(event_graph, """
, flagged AS (
  SELECT g, off, dense_rank() OVER (PARTITION BY g ORDER BY next_g) - 1 AS value,
    CASE WHEN lag(next_g) OVER (PARTITION BY g ORDER BY off) = next_g THEN 0 ELSE 1 END AS new FROM erec
), numbered AS (SELECT *, (sum(new) OVER (PARTITION BY g ORDER BY off) - 1)::BIGINT AS run_no FROM flagged)
SELECT g, run_no, min(value) AS value, count(*) AS len FROM numbered GROUP BY g, run_no""", ORDER)
def record_runs(g):
    return order.record_runs(order.with_next(ordered(g)))


@over(order_graph, "SELECT g, count(*)::BIGINT AS len FROM visit GROUP BY g")
def record_len(g):
    return order.record_lengths(g.visit)


# ---------------------------------------------------------------- search


@over(event_graph, "SELECT g, 0::BIGINT AS lo, count(*) AS hi FROM ord GROUP BY g", ORDER)
def find(g):
    return search.find(ordered(g))


def gram_sql(k: int, extra: str = "") -> str:
    cols = ", ".join(f"lag(g, {k - 1 - i}) OVER w AS g{i}" for i in range(k - 1)) + f", g AS g{k - 1}"
    return f""", gram AS (SELECT seq_id, pos, off, {cols}{extra} FROM ord WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
state{k} AS (SELECT concat_ws(' ', {", ".join(f"g{i}" for i in range(k))}) AS pattern, {", ".join(f"g{i}" for i in range(k))}, min(off) AS lo, max(off) + 1 AS hi, count(*) AS n FROM gram WHERE g0 IS NOT NULL GROUP BY ALL)
"""


@over(event_graph, "SELECT pattern, g1 AS g, lo, hi, n FROM state2", ORDER, gram_sql(2))
def extend_2(g):
    return search.states(ordered(g), 2).select(text("pattern").alias("pattern"), "g", "lo", "hi", "n")


@over(event_graph, "SELECT pattern, g2 AS g, lo, hi, n FROM state3", ORDER, gram_sql(3))
def extend_3(g):
    return search.states(ordered(g), 3).select(text("pattern").alias("pattern"), "g", "lo", "hi", "n")


@over(event_graph, """
SELECT a.pattern, a.g1 AS fwd_g, a.lo AS fwd_lo, a.hi AS fwd_hi, b.g1 AS rev_g, b.lo AS rev_lo, b.hi AS rev_hi
FROM state2 a JOIN state2 b ON b.g0 = xor(a.g1, 1) AND b.g1 = xor(a.g0, 1)""", ORDER, gram_sql(2))
def bd_extend(g):
    s = search.bidirectional_states(cut(ordered(g)), 2)
    return s.withColumn("pattern", text("pattern"))


@over(event_graph, """
SELECT a.pattern, a.g2 AS fwd_g, a.lo AS fwd_lo, b.g2 AS rev_g, b.lo AS rev_lo, a.n
FROM state3 a JOIN state3 b ON b.g0 = xor(a.g2, 1) AND b.g1 = xor(a.g1, 1) AND b.g2 = xor(a.g0, 1)""", ORDER, gram_sql(3))
def extend_backward(g):
    o = cut(ordered(g))
    s = search.extend_state_left(o, search.bidirectional_states(o, 2), 2)
    return s.select(text("pattern").alias("pattern"), "fwd_g", "fwd_lo", "rev_g", "rev_lo", (F.col("fwd_hi") - F.col("fwd_lo")).alias("n"))


@over(event_graph, """
, one AS (SELECT g, 0::BIGINT AS lo, count(*) AS hi FROM ord GROUP BY g)
SELECT a.g::VARCHAR AS pattern, a.g AS fwd_g, a.lo AS fwd_lo, a.hi AS fwd_hi, b.g AS rev_g, b.lo AS rev_lo, b.hi AS rev_hi FROM one a JOIN one b ON b.g = xor(a.g, 1)""", ORDER)
def bd_find(g):
    s = search.bidirectional_states(cut(ordered(g)), 1)
    return s.withColumn("pattern", text("pattern"))


@over(event_graph, """
SELECT a.pattern, a.g0 // 2 AS from_id, a.g0 % 2 = 1 AS from_rev, a.g1 // 2 AS to_id, a.g1 % 2 = 1 AS to_rev, a.n FROM state2 a JOIN state2 b ON b.g0 = xor(a.g1, 1) AND b.g1 = xor(a.g0, 1)""", ORDER, gram_sql(2))
def state_ends(g):
    s = search.state_ends(search.bidirectional_states(cut(ordered(g)), 2))
    return s.select(text("pattern").alias("pattern"), F.col("from.id").alias("from_id"), F.col("from.is_rev").alias("from_rev"), F.col("to.id").alias("to_id"), F.col("to.is_rev").alias("to_rev"), "n")


@over(event_graph, """
, asked AS (SELECT DISTINCT pattern FROM gram3 WHERE substr(md5((seq_id // 2) || ':' || pos), 1, 1) = '0' AND seq_id % 2 = 0)
SELECT pattern AS query_id, g2 AS g, lo, hi FROM state3 JOIN asked USING (pattern)""", ORDER, gram_sql(3),
      ", gram3 AS (SELECT seq_id, pos, concat_ws(' ', g, lead(g, 1) OVER w, lead(g, 2) OVER w) AS pattern FROM evisit WINDOW w AS (PARTITION BY seq_id ORDER BY pos) QUALIFY lead(g, 2) OVER w IS NOT NULL)")
def extend_queries(g):
    # a batch of given patterns: sampling them is the feature
    asked = search.sample_patterns(g.visit, 3, digits=1).select("pattern").distinct()
    return search.extend(ordered(g), asked.withColumn("query_id", text("pattern")), 3)


def rank_tables(g: PathGraph) -> ranks.RankIndex:
    return ranks.rank_index(order.with_next(ordered(g)))


@over(event_graph, """
, flagged AS (SELECT g, off, next_g, CASE WHEN lag(next_g) OVER (PARTITION BY g ORDER BY off) = next_g THEN 0 ELSE 1 END AS new FROM erec),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY off) AS run FROM flagged),
runs AS (SELECT g, next_g, min(off) AS start, count(*) AS len FROM numbered GROUP BY g, next_g, run)
SELECT g, next_g, start, len, coalesce(sum(len) OVER (PARTITION BY g, next_g ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM runs""", ORDER)
def rank_runs(g):
    return ranks.whole_runs(rank_tables(g))


@over(event_graph, """
, asked AS (SELECT DISTINCT pattern FROM gram5 WHERE substr(md5((seq_id // 2) || ':' || pos), 1, 1) = '0' AND seq_id % 2 = 0)
SELECT pattern AS query_id, g4 AS g, lo, hi FROM state5 JOIN asked USING (pattern)""", ORDER, gram_sql(5),
      ", gram5 AS (SELECT seq_id, pos, concat_ws(' ', g, lead(g, 1) OVER w, lead(g, 2) OVER w, lead(g, 3) OVER w, lead(g, 4) OVER w) AS pattern FROM evisit WINDOW w AS (PARTITION BY seq_id ORDER BY pos) QUALIFY lead(g, 4) OVER w IS NOT NULL)")
def search_ranges(g):
    # a batch of given patterns: sampling them is the feature
    asked = search.sample_patterns(g.visit, 5, digits=1).select("pattern").distinct()
    return ranks.search_ranges(rank_tables(g), cut(asked.withColumn("query_id", text("pattern"))))


@over(event_graph, "SELECT concat_ws(' ', g0, g1) AS pattern, g2 AS g, lo, hi FROM state3", ORDER, gram_sql(3))
def extend_ranges(g):
    # every range of two handles, extended by every handle that follows
    index = rank_tables(g)
    two = cut(ranks.follow_states(index, ranks.find(index, index.edges.select("g").distinct()).withColumn("first", F.col("g"))))
    three = ranks.follow_states(index, two.select(text(F.array("first", "g")).alias("pattern"), "g", "lo", "hi"))
    return three.select("pattern", "g", "lo", "hi")


BOTH_WAYS = """
SELECT a.pattern, a.g2 AS fwd_g, a.lo AS fwd_lo, a.hi AS fwd_hi, b.g2 AS rev_g, b.lo AS rev_lo, b.hi AS rev_hi
FROM state3 a JOIN state3 b ON b.g0 = xor(a.g2, 1) AND b.g1 = xor(a.g1, 1) AND b.g2 = xor(a.g0, 1)"""


@over(event_graph, BOTH_WAYS, ORDER, gram_sql(3))
def extend_ranges_both(g):
    # one handle to the right and then one to the left
    index = rank_tables(g)
    one = ranks.find_both(index, index.edges.select("g").distinct()).withColumn("pattern", F.array("fwd_g"))
    two = cut(ranks.extend_both(index, one).select(F.concat("pattern", F.array("next_g")).alias("pattern"), *ranks.BOTH))
    three = ranks.extend_both_left(index, two)
    return three.select(text(F.concat(F.array("next_g"), "pattern")).alias("pattern"), *ranks.BOTH)


@over(event_graph, "SELECT concat_ws(' ', g0, g1) AS pattern, g2 AS next_g, n, lo, hi FROM state3", ORDER, gram_sql(3))
def follow_forward(g):
    return search.follow_forward(ordered(g), 2).withColumn("pattern", text("pattern"))


@over(event_graph, "SELECT concat_ws(' ', g1, g2) AS pattern, g0 AS prev_g, n FROM state3", ORDER, gram_sql(3))
def follow_backward(g):
    return search.follow_backward(ordered(g), 2).withColumn("pattern", text("pattern"))


def lead_gram(k: int, table: str, key: str) -> str:
    cols = ", ".join(["g AS g0"] + [f"lead(g, {i}) OVER w AS g{i}" for i in range(1, k)])
    return f"SELECT {key}, pos, concat_ws(' ', {', '.join(f'g{i}' for i in range(k))}) AS pattern FROM (SELECT {key}, pos, {cols} FROM {table} WINDOW w AS (PARTITION BY {key} ORDER BY pos)) WHERE g{k - 1} IS NOT NULL"


@over(order_graph, f"""
, grams AS ({lead_gram(10, "visit", "seq_id")}),
n AS (SELECT pattern, count(*) AS n FROM grams GROUP BY pattern)
SELECT (seq_id // 2) || ':' || pos AS query_id, n.n FROM grams JOIN n USING (pattern)
WHERE seq_id % 2 = 0 AND substr(md5((seq_id // 2) || ':' || pos), 1, 1) = '0'""")
def count_queries(g):
    # sampling queries is the feature: a sixteenth of all 10-node subpaths
    return search.count_occurrences(g.visit, search.sample_patterns(g.visit, 10, digits=1), [10])


@over(event_graph, f"""
, one AS ({lead_gram(1, "evisit", "seq_id")}), two AS ({lead_gram(2, "evisit", "seq_id")}), three AS ({lead_gram(3, "evisit", "seq_id")})
SELECT 1 AS k, pattern, count(*)::BIGINT AS n FROM one GROUP BY pattern UNION ALL
SELECT 2, pattern, count(*)::BIGINT FROM two GROUP BY pattern UNION ALL SELECT 3, pattern, count(*)::BIGINT FROM three GROUP BY pattern""")
def all_subpaths_k(g):
    return search.all_subpaths(g.visit, 3).withColumn("pattern", text("pattern"))


@over(event_graph, """
, whole AS (SELECT list_concat([g], coalesce(pre, [])) AS w FROM prefixed)
SELECT k::BIGINT AS k, count(DISTINCT w[1:k])::BIGINT AS n FROM (SELECT w, unnest(range(1, len(w) + 1)) AS k FROM whole) GROUP BY k""", ORDER)
def distinct_subpaths(g):
    return subpaths.distinct_subpaths(navigation.bidirectional(g.visit))


@over(event_graph, f"""
, grams AS ({lead_gram(10, "evisit", "seq_id")}),
drawn AS (SELECT g, arg_min(seq_id || ':' || pos, md5(seq_id || ':' || pos)) AS query_id FROM evisit WHERE substr(md5('node:' || g), 1, 1) = '0' GROUP BY g)
SELECT query_id, pattern FROM drawn JOIN grams ON seq_id || ':' || pos = query_id""")
def sample_by_node(g):
    # drawing handles is the feature
    return search.sample_by_node(g.visit, 10, 1).withColumn("pattern", text("pattern"))


# ---------------------------------------------------------------- base pairs


@over(order_graph, "SELECT path_id, count(*) AS nodes, sum(length(seq))::BIGINT AS bp FROM fvisit JOIN node ON g // 2 = node_id GROUP BY path_id")
def path_lengths(g):
    return positions.path_lengths(g.visit, g.node)


OFFSETS = """, offs AS (
  SELECT path_id, pos, g, coalesce(sum(length(seq)) OVER (PARTITION BY path_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM fvisit JOIN node ON g // 2 = node_id)
"""


@over(order_graph, 'SELECT path_id, pos, g, "offset" FROM offs', OFFSETS)
def path_offsets(g):
    return positions.path_offsets(g.visit, g.node)


DNA = """, dna AS (
  SELECT path_id, string_agg(CASE WHEN g % 2 = 1 THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END, '' ORDER BY pos) AS dna
  FROM fvisit JOIN node ON g // 2 = node_id GROUP BY path_id)
"""


@over(order_graph, "SELECT path_id, dna FROM dna", DNA)
def path_dna(g):
    return positions.path_dna(g.visit, g.node)


@over(order_graph, "SELECT path_id, dna || '$' AS text FROM dna", DNA)
def sequence_dump(g):
    return sinks.sequence_dump(g, end="$")


@over(order_graph, """
, len AS (SELECT path_id, sum(length(seq))::BIGINT AS bp FROM fvisit JOIN node ON g // 2 = node_id GROUP BY path_id)
SELECT path_id, bp, coalesce(sum(bp + 1) OVER (ORDER BY path_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM len""")
def text_offsets(g):
    return positions.text_offsets(positions.path_lengths(g.visit, g.node).select("path_id", "bp"))


REFERENCES = f"('c3', 'c7', 'c11', 'c20', '{names.GENERIC_SAMPLE}')"


@over(order_graph, f"""
, refs AS (SELECT o.* FROM offs o JOIN named USING (path_id) WHERE sample IN {REFERENCES}),
taken AS (
  SELECT path_id, pos, "offset" FROM refs WHERE pos = 0
  UNION ALL
  SELECT r.path_id, arg_min(r.pos, r."offset"), min(r."offset") FROM taken t JOIN refs r ON r.path_id = t.path_id AND r."offset" >= t."offset" + 25 GROUP BY r.path_id, t.pos
)
SELECT path_id, pos, "offset" FROM taken""", OFFSETS)
def reference_positions(g):
    wanted = g.path.join(metadata.reference_samples(g, also_generic=True), "sample_id", "left_semi")
    offsets = positions.path_offsets(g.visit.join(wanted, "path_id", "left_semi"), g.node)
    return positions.reference_positions(offsets, 25)


# ---------------------------------------------------------------- segments


@over(order_graph, "SELECT seg_id, name, seq, node_lo, node_hi FROM segment WHERE node_lo IN (SELECT node_id FROM node)")
def used_segments(g):
    return segments.used_segments(g.segment, g.node).select("seg_id", "name", "seq", "node_lo", "node_hi")


@over(order_graph, "SELECT seg_id, seq FROM segment WHERE node_lo IN (SELECT node_id FROM node)")
def segment_sequences(g):
    # put together from the nodes
    at = segments.node_to_segment(g.segment).join(g.node, "node_id")
    parts = at.groupBy("seg_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "seq"))).alias("parts"))
    return parts.select("seg_id", F.array_join(F.transform("parts", lambda x: x["seq"]), "").alias("seq"))


@over(order_graph, "SELECT seg_id, name, length(seq)::INTEGER AS bp, node_hi - node_lo AS nodes, node_lo - 1 AS first_index FROM segment")
def segment_len(g):
    return g.segment.select("seg_id", "name", F.length("seq").alias("bp"), (F.col("node_hi") - F.col("node_lo")).alias("nodes"), (F.col("node_lo") - 1).alias("first_index"))


@over(order_graph, "SELECT n.node_id, s.seg_id FROM node n JOIN segment s ON n.node_id >= s.node_lo AND n.node_id < s.node_hi")
def node_to_segment(g):
    return segments.segment_of_nodes(g.segment, g.node).select("node_id", "seg_id")


LINKS = """, ends AS (
  SELECT seg_id, false AS is_rev, 2 * (node_hi - 1) AS g FROM segment UNION ALL SELECT seg_id, true, 2 * node_lo + 1 FROM segment
), links AS (
  SELECT e.seg_id, e.is_rev, s.seg_id AS next_seg, d.next_g % 2 = 1 AS next_rev
  FROM ends e JOIN edges d USING (g) JOIN segment s ON d.next_g // 2 >= s.node_lo AND d.next_g // 2 < s.node_hi
  WHERE e.seg_id IN (SELECT seg_id FROM segment WHERE node_lo IN (SELECT node_id FROM node)))
"""


@over(order_graph, "SELECT * FROM links", EDGES, LINKS)
def segment_links(g):
    return segments.segment_links(g.segment, g.node, g.visit)


@over(order_graph, "SELECT seg_id, NOT is_rev AS is_rev, next_seg AS prev_seg, NOT next_rev AS prev_rev FROM links", EDGES, LINKS)
def segment_predecessors(g):
    return segments.segment_predecessors(segments.segment_links(g.segment, g.node, g.visit))


@over(order_graph, "SELECT path_id, sv AS seg_no, seg_id, is_rev FROM segment_visit")
def segment_paths(g):
    return segments.segment_paths(g.visit, g.segment)


@over(order_graph, "SELECT path_id, sv AS seg_no, seg_id, is_rev FROM segment_visit")
def segment_paths_exact(g):
    return segments.segment_paths_exact(g.visit, g.segment)


# ---------------------------------------------------------------- names


@over(order_graph, f"""
SELECT path_id, sample, contig, phase, fragment,
  CASE WHEN sample = '{names.GENERIC_SAMPLE}' THEN contig WHEN phase = 0 AND fragment = 0 THEN sample || '#' || contig
    ELSE sample || '#' || phase || '#' || contig || '@' || fragment END AS name,
  sample || '#' || phase || '#' || contig AS pansn
FROM named""")
def path_names(g):
    return metadata.path_names(g)


@over(order_graph, """
, len AS (SELECT path_id, sum(length(seq))::BIGINT AS bp FROM fvisit JOIN node ON g // 2 = node_id GROUP BY path_id)
SELECT path_id, sample || '#' || phase || '#' || contig || '[' || fragment || '-' || (fragment + bp) || ']' AS name FROM named JOIN len USING (path_id)""")
def fragment_names(g):
    return metadata.fragment_names(g, positions.path_lengths(g.visit, g.node))


@over(order_graph, """
SELECT a.path_id AS query_id, (SELECT min(b.path_id) FROM path b WHERE b.sample_id = a.sample_id AND b.contig_id = a.contig_id AND b.phase = a.phase AND b.fragment = a.fragment) AS path_id FROM path a""")
def find_path(g):
    return metadata.find_path(g, names_of_paths(g).select(F.col("path_id").alias("query_id"), "sample", "contig", "phase", "fragment"))


@over(order_graph, """
SELECT query_id, path_id FROM (
  SELECT a.path_id AS query_id, b.path_id, row_number() OVER (PARTITION BY a.path_id ORDER BY b.fragment DESC, b.path_id) AS rn
  FROM path a LEFT JOIN path b ON b.sample_id = a.sample_id AND b.contig_id = a.contig_id AND b.phase = a.phase AND b.fragment <= a.fragment - 15
) WHERE rn = 1""")
def find_fragment(g):
    asked = names_of_paths(g).select(F.col("path_id").alias("query_id"), "sample", "contig", "phase", (F.col("fragment") - 15).alias("fragment"))
    return metadata.find_fragment(g, asked)


@over(order_graph, "SELECT contig_id, count(*) AS n_paths, min(path_id) AS first_path, max(path_id) AS last_path FROM path GROUP BY contig_id")
def paths_per_contig(g):
    return metadata.paths_per_contig(g)


@over(order_graph, "SELECT count(*) AS paths, count(DISTINCT sample_id) AS samples, count(DISTINCT (sample_id, phase)) AS haplotypes, count(DISTINCT contig_id) AS contigs FROM path")
def haplotypes(g):
    return metadata.haplotypes(g)


@over(order_graph, "SELECT sample_id, coalesce(s.name, sample_id::VARCHAR) AS name FROM (SELECT DISTINCT sample_id FROM path) LEFT JOIN sample s USING (sample_id)")
def sample_names(g):
    return g.path.select("sample_id").distinct().join(g.sample, "sample_id", "left").select("sample_id", names.name_or_id("name", "sample_id").alias("name"))


@over(order_graph, "SELECT row_number() OVER (ORDER BY name) - 1 AS id, name FROM (SELECT DISTINCT name FROM sample)")
def sample_dictionary(g):
    return metadata.dictionary(g.sample)


@over(order_graph, "SELECT pansn, count(*) AS n FROM (SELECT sample || '#' || phase || '#' || contig AS pansn FROM named) GROUP BY pansn HAVING count(*) > 1")
def duplicate_names(g):
    return metadata.duplicates(metadata.path_names(g), "pansn")


TAGS = "(VALUES ('index', 'reference_samples', 'c3 c7 c3 nobody c11 c20'), ('graph', 'source', 'projection'))"


def more_tags(g: PathGraph) -> DataFrame:
    """A tag for each contig, and one that is there already, in other letters."""
    graph = F.lit("graph").alias("scope")
    new = g.contig.select(graph, F.col("name").alias("key"), F.col("contig_id").cast("string").alias("value"))
    return new.union(g.contig.agg(F.count("*").cast("string").alias("value")).select(graph, F.lit("SOURCE"), "value"))


MORE_TAGS = f""", edited AS (
  SELECT scope, key, value FROM {TAGS} t(scope, key, value) WHERE key <> 'source'
  UNION ALL SELECT 'graph', lower(name), contig_id::VARCHAR FROM contig
  UNION ALL SELECT 'graph', 'source', count(*)::VARCHAR FROM contig
)
"""


@over(order_graph, "SELECT scope, key, value, (row_number() OVER (PARTITION BY scope ORDER BY key))::INTEGER AS place FROM edited", MORE_TAGS)
def tags_insert(g):
    return metadata.set_tags(g.tag, more_tags(g)).withColumn("place", F.row_number().over(W.partitionBy("scope").orderBy("key")))


@over(order_graph, "SELECT scope, key, value FROM edited WHERE key NOT IN ('source', 'asia')", MORE_TAGS)
def tags_remove(g):
    return metadata.remove_tags(metadata.set_tags(g.tag, more_tags(g)), "Source", "Asia")


@over(order_graph, f"SELECT * FROM {TAGS} t(scope, key, value)")
def tags_normalise(g):
    return metadata.normalised_tags(g.tag)


@over(order_graph, f"""
SELECT ordinal, sample_id, name FROM (
  SELECT (generate_subscripts(l, 1) - 1)::INTEGER AS ordinal, unnest(l) AS name FROM (SELECT string_split(value, ' ') AS l FROM {TAGS} t(scope, key, value) WHERE key = 'reference_samples')
  UNION ALL SELECT 2147483647, '{names.GENERIC_SAMPLE}'
) JOIN sample USING (name)""")
def reference_samples(g):
    return metadata.reference_samples(g, also_generic=True)


@over(order_graph, """
SELECT string_agg(name, ' ' ORDER BY name) AS value, count(*) AS n FROM (SELECT DISTINCT sample AS name FROM named JOIN sample ON sample.name = named.sample WHERE phase = 2)""")
def set_reference_samples(g):
    return metadata.set_reference_samples(g, names_of_paths(g).where("phase = 2").select(F.col("sample").alias("name")))


# ---------------------------------------------------------------- components, subsequences


COMPONENTS = """, und AS (SELECT DISTINCT g // 2 AS a, next_g // 2 AS b FROM edges),
cc(node_id, component) USING KEY (node_id) AS (
  SELECT node_id, node_id FROM node
  UNION
  SELECT u.b, min(cc.component) FROM cc JOIN und u ON u.a = cc.node_id JOIN recurring.cc AS old ON old.node_id = u.b
  WHERE cc.component < old.component GROUP BY u.b
)
"""


@over(order_graph, "SELECT node_id, component FROM cc", EDGES, COMPONENTS)
def components(g):
    return contigs.node_components(g.visit)


@over(order_graph, "SELECT node_id, component FROM cc", EDGES, COMPONENTS)
def components_in_batches(g):
    # edges arrive in three batches; each is joined to the labels of those before it
    links = stored(contigs.node_links(g.visit).distinct())
    batch = F.pmod(F.xxhash64("src", "dst"), F.lit(3))
    labels = stored(contracted_components(links.where(batch == 0)))
    for i in (1, 2):
        labels = stored(join_components(labels, links.where(batch == i)))
    return labels.withColumnRenamed("node", "node_id")


@over(order_graph, """
SELECT dense_rank() OVER (ORDER BY component) - 1 AS component_no, row_number() OVER (PARTITION BY component ORDER BY node_id) - 1 AS member_no, node_id FROM cc""", EDGES, COMPONENTS)
def numbered_components(g):
    return contigs.numbered_components(cut(contigs.node_components(g.visit)))


@over(order_graph, """
, starts AS (SELECT path_id, component FROM fvisit JOIN cc ON node_id = g // 2 WHERE pos = 0)
SELECT path_id FROM starts WHERE component IN (SELECT component FROM starts JOIN path USING (path_id) WHERE contig_id = 2)""", EDGES, COMPONENTS)
def contig_paths(g):
    return contigs.paths_of_contig(g.visit, g.path, 2, contigs.node_components(g.visit))


NEIGHBOURS = "SELECT a.path_id || '-' || b.path_id AS pair_id, a.w AS a, a.wt AS wt, b.w AS b FROM walks a JOIN walks b ON b.path_id = a.path_id + 1"
#: All pairs whose handles, in any order, weigh enough.
REACHING = """SELECT a.path_id || '-' || b.path_id AS pair_id, a.w AS a, a.wt AS wt, b.w AS b FROM walks a JOIN walks b ON a.path_id < b.path_id JOIN (
  SELECT a_id, b_id FROM (SELECT a.path_id AS a_id, b.path_id AS b_id, least(a.c, b.c) * length(seq) AS shared
    FROM (SELECT path_id, g, count(*) AS c FROM efvisit GROUP BY path_id, g) a JOIN (SELECT path_id, g, count(*) AS c FROM efvisit GROUP BY path_id, g) b ON a.g = b.g AND a.path_id < b.path_id JOIN enode ON node_id = a.g // 2)
  GROUP BY a_id, b_id HAVING sum(shared) >= {least}) ON a_id = a.path_id AND b_id = b.path_id"""
#: Of walks of some sixty visits of four bases on average, about as alike as any two.
ALIKE = 75


def lcs_sql(weight: str, pairs: str = NEIGHBOURS, what: str = "pair_id, arg_max(r[len(r)], i) AS weight", having: str = "") -> str:
    return f""", walks AS (SELECT path_id, list(g ORDER BY pos) AS w, list({weight} ORDER BY pos) AS wt FROM efvisit JOIN enode ON node_id = g // 2 GROUP BY path_id),
pairs AS ({pairs}),
dp(pair_id, i, r) AS (
  SELECT pair_id, 0, list_transform(b, lambda x: 0::BIGINT) FROM pairs
  UNION ALL
  SELECT pair_id, i, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (
    SELECT d.pair_id, d.i + 1 AS i,
      list_transform(range(1, len(p.b) + 1), lambda j: greatest(d.r[j], CASE WHEN p.b[j] = p.a[d.i + 1] THEN coalesce(d.r[j - 1], 0) + p.wt[d.i + 1] ELSE 0 END)) AS c
    FROM dp d JOIN pairs p USING (pair_id) WHERE d.i < len(p.a))
)
SELECT {what} FROM dp GROUP BY pair_id{having}"""


def neighbours(g: PathGraph, weights: DataFrame | None) -> DataFrame:
    """Each user's walk and the next user's."""
    walks = cut(navigation.path_arrays(g.visit))
    pairs = walks.select(F.col("path_id").alias("a_id"), (F.col("path_id") + 1).alias("b_id"))
    return lcs.path_pairs(walks, pairs, weights)


@over(event_graph, lcs_sql("1::BIGINT"))
def lcs_unit(g):
    return lcs.weighted_lcs(neighbours(g, None)).select("pair_id", "weight")


@over(event_graph, lcs_sql("length(seq)::BIGINT"))
def lcs_weighted(g):
    return lcs.weighted_lcs(neighbours(g, lcs.node_weights(g.node))).select("pair_id", "weight")


@over(event_graph, lcs_sql("length(seq)::BIGINT", what="pair_id, arg_max(r[len(r)], i) AS weight, 0::BIGINT AS wrong"))
def lcs_pairs(g):
    # each user and the next; of the pairs of positions found: what they weigh, and how many aren't alike or don't go on in both walks
    visit = cut(g.visit)
    ids = visit.select("path_id").distinct()
    pairs = ids.select(F.col("path_id").alias("a_id"), (F.col("path_id") + 1).alias("b_id")).join(ids.withColumnRenamed("path_id", "b_id"), "b_id", "left_semi")
    pairs = cut(pairs.select("a_id", "b_id", F.concat_ws("-", "a_id", "b_id").alias("pair_id")))
    found = cut(lcs_tiles.subsequences(visit, pairs, lcs.node_weights(g.node))).join(pairs, "pair_id")
    side = lambda p: visit.select(F.col("path_id").alias(f"{p}_id"), F.col("pos").alias(f"{p}_pos"), F.col("g").alias(f"{p}_g"))
    found = found.join(side("a"), ["a_id", "a_pos"]).join(side("b"), ["b_id", "b_pos"])
    w = W.partitionBy("pair_id").orderBy("a_pos")
    right = (F.col("a_g") == F.col("b_g")) & (F.coalesce(F.lag("b_pos").over(w), F.lit(-1)) < F.col("b_pos")) & (F.coalesce(F.lag("a_pos").over(w), F.lit(-1)) < F.col("a_pos"))
    weight = found.withColumn("wrong", (~right).cast("long")).groupBy("pair_id").agg(F.sum("w").alias("weight"), F.sum("wrong").alias("wrong"))
    return pairs.select("pair_id").join(weight, "pair_id", "left").select("pair_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("weight", "wrong")])


@over(event_graph, lcs_sql("length(seq)::BIGINT", REACHING.format(least=ALIKE), having=f" HAVING arg_max(r[len(r)], i) >= {ALIKE}"))
def lcs_all_pairs(g):
    found = lcs_tiles.alike(cut(g.visit), lcs.node_weights(g.node), ALIKE)
    return found.select(F.concat_ws("-", "a_id", "b_id").alias("pair_id"), "weight")


@over(event_graph, lcs_sql("length(seq)::BIGINT"))
def lcs_table(g):
    rows = neighbours(g, lcs.node_weights(g.node))
    return rows.select("pair_id", lcs.weight_by_table(F.col("a"), F.col("b"), F.col("weight")).alias("weight"))


# ---------------------------------------------------------------- orders, numbers, edits


@over(order_graph, "SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS place, row_number() OVER (ORDER BY node_id DESC) - 1 AS place_from_end FROM node")
def node_order(g):
    return navigation.node_order(g.node)


@over(order_graph, """
SELECT g, next_g AS successor, row_number() OVER (PARTITION BY g ORDER BY next_g) - 1 AS place,
  row_number() OVER (PARTITION BY g ORDER BY next_g DESC) - 1 AS place_from_end FROM edges""", EDGES)
def edge_order(g):
    return navigation.edge_order(g.visit)


@over(order_graph, """
, f AS (SELECT min(node_id) AS first FROM node), h AS (SELECT 2 * node_id AS g FROM node UNION ALL SELECT 2 * node_id + 1 FROM node)
SELECT g, g - 2 * first + 1 AS record, (g - 2 * first) // 2 AS sequence, g AS handle_of_record, g // 2 AS node_of_sequence FROM h, f""")
def index_numbers(g):
    return navigation.index_numbers(g.node)


@over(order_graph, "SELECT a.path_id, a.path_id % 20 AS k, v.g // 2 AS node_id, v.g % 2 = 1 AS is_rev FROM path a LEFT JOIN fvisit v ON v.path_id = a.path_id AND v.pos = a.path_id % 20")
def nth_visits(g):
    return navigation.nth_visits(g.visit, g.path.select("path_id", (F.col("path_id") % 20).alias("k")))


@over(order_graph, "SELECT contig_id, coalesce(c.name, contig_id::VARCHAR) AS name FROM (SELECT DISTINCT contig_id FROM path) LEFT JOIN contig c USING (contig_id)")
def contig_names(g):
    return g.path.select("contig_id").distinct().join(g.contig, "contig_id", "left").select("contig_id", names.name_or_id("name", "contig_id").alias("name"))


@over(order_graph, f"""
SELECT path_id, CASE WHEN sample = '{names.GENERIC_SAMPLE}' THEN '{names.GENERIC_SAMPLE}' ELSE sample END AS sample, contig,
  CASE WHEN sample = '{names.GENERIC_SAMPLE}' OR (phase = 0 AND fragment = 0) THEN 0 ELSE phase END::BIGINT AS haplotype,
  CASE WHEN sample = '{names.GENERIC_SAMPLE}' OR (phase = 0 AND fragment = 0) THEN 0 ELSE fragment END::BIGINT AS fragment FROM named""")
def made_names(g):
    made = F.when(F.col("sample") == names.GENERIC_SAMPLE, names.generic_name("contig"))
    made = made.when((F.col("phase") == 0) & (F.col("fragment") == 0), names.path_name("sample", "contig")).otherwise(names.path_name("sample", "contig", "phase", "fragment"))
    return names_of_paths(g).select("path_id", made.alias("n")).select("path_id", "n.*")


# ---------------------------------------------------------------- text output


@over(order_graph, "SELECT 'H' || chr(9) || 'VN:Z:1.1' || chr(9) || 'RS:Z:c3 c7 c3 c11' AS line")
def gfa_header(g):
    return sinks.gfa_header(g)


@over(order_graph, "SELECT seg_id AS ordinal, concat_ws(chr(9), 'S', name, seq) AS line FROM segment WHERE node_lo IN (SELECT node_id FROM node)")
def gfa_segments(g):
    return sinks.gfa_segments(g)


@over(order_graph, f"""
, both_ways AS (
  SELECT 2 * seg_id + is_rev::BIGINT AS g, 2 * next_seg + next_rev::BIGINT AS next_g FROM links
  UNION SELECT xor(2 * next_seg + next_rev::BIGINT, 1), xor(2 * seg_id + is_rev::BIGINT, 1) FROM links)
SELECT g, next_g, concat_ws(chr(9), 'L', 's' || (g // 2), CASE WHEN g % 2 = 1 THEN '-' ELSE '+' END, 's' || (next_g // 2), CASE WHEN next_g % 2 = 1 THEN '-' ELSE '+' END, '*') AS line
FROM both_ways WHERE {CANONICAL}""", EDGES, LINKS)
def gfa_links(g):
    return sinks.gfa_links(g)


STEPS = """, p_walk AS (SELECT path_id, string_agg('s' || seg_id || CASE WHEN is_rev THEN '-' ELSE '+' END, ',' ORDER BY sv) AS walk FROM segment_visit GROUP BY path_id),
w_walk AS (SELECT path_id, string_agg(CASE WHEN is_rev THEN '<' ELSE '>' END || 's' || seg_id, '' ORDER BY sv) AS walk, sum(length(seq))::BIGINT AS bp FROM segment_visit JOIN segment USING (seg_id) GROUP BY path_id)
"""


@over(order_graph, f"SELECT path_id, concat_ws(chr(9), 'P', contig, walk, '*') AS line FROM named JOIN p_walk USING (path_id) WHERE sample = '{names.GENERIC_SAMPLE}'", STEPS)
def gfa_paths(g):
    return sinks.gfa_paths(g)


@over(order_graph, "SELECT path_id, concat_ws(chr(9), 'P', sample || '#' || phase || '#' || contig, walk, '*') AS line FROM named JOIN p_walk USING (path_id)", STEPS)
def gfa_pansn(g):
    return sinks.gfa_pansn(g)


@over(order_graph, f"""
SELECT path_id, concat_ws(chr(9), 'W', sample, phase, contig, fragment, fragment + bp, walk) AS line FROM named JOIN w_walk USING (path_id) WHERE sample <> '{names.GENERIC_SAMPLE}'""", STEPS)
def gfa_walks(g):
    return sinks.gfa_walks(g)


@over(order_graph, """
, len AS (SELECT path_id, sum(length(seq))::BIGINT AS bp FROM fvisit JOIN node ON g // 2 = node_id GROUP BY path_id)
SELECT path_id, concat_ws(chr(9), path_id, sample, contig, phase, fragment, bp) AS line FROM named JOIN len USING (path_id)""")
def names_lines(g):
    return sinks.names_lines(g)


TEXT_TAGS = """, eoff AS (
  SELECT path_id, pos, g, seq, coalesce(sum(length(seq)) OVER (PARTITION BY path_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM efvisit JOIN enode ON node_id = g // 2
), elen AS (SELECT path_id, sum(length(seq))::BIGINT AS bp, string_agg(CASE WHEN g % 2 = 1 THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END, '' ORDER BY pos) AS dna FROM eoff GROUP BY path_id),
estart AS (SELECT *, coalesce(sum(bp + 1) OVER (ORDER BY path_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM elen),
ttag AS (
  SELECT start + before + i AS text_offset, (g // 2) * 2048 + (g % 2) * 1024 + i AS tag FROM (SELECT *, unnest(range(length(seq))) AS i FROM eoff) JOIN estart USING (path_id)
  UNION ALL SELECT start + bp, 0 FROM estart
), suffixes AS (SELECT start + i AS text_offset, row_number() OVER (ORDER BY substr(dna, i + 1), path_id) - 1 AS rank FROM (SELECT *, unnest(range(bp + 1)) AS i FROM estart))
"""


def text_tags(g: PathGraph) -> tuple[DataFrame, DataFrame]:
    """Tags of the text of all walks, and its suffix array: suffixes end with their walk, ties go by walk."""
    starts = positions.text_offsets(positions.path_lengths(g.visit, g.node).select("path_id", "bp"))
    dna_of = positions.path_dna(g.visit, g.node).join(starts, "path_id")
    suffix = dna_of.select("path_id", "offset", "dna", F.explode(F.expr("sequence(0L, bp)")).alias("i")).select(
        (F.col("offset") + F.col("i")).alias("text_offset"), F.struct(F.expr("substring(dna, int(i) + 1)").alias("suffix"), "path_id").alias("key")
    )
    return tags.tags_of_text(g.visit, g.node, starts), order.ranked_apart(suffix)


@over(event_graph, "SELECT rank, tag FROM suffixes JOIN ttag USING (text_offset)", TEXT_TAGS)
def tag_array(g):
    return tags.tag_array(*text_tags(g))


@over(event_graph, """
SELECT sum(CASE WHEN tag = before THEN 0 ELSE 1 END)::BIGINT AS runs FROM (SELECT tag, lag(tag) OVER (ORDER BY rank) AS before FROM suffixes JOIN ttag USING (text_offset))""", TEXT_TAGS)
def tag_runs(g):
    return tags.count_runs(tags.tag_array(*text_tags(g)), "rank", "tag", 1 << 12)


# ---------------------------------------------------------------- plain byte files


@over(order_graph, """
SELECT i * 65536 AS at, substr(text, (i * 65536 + 1)::BIGINT, 65536) AS text
FROM (SELECT text, unnest(range((length(text) + 65535) // 65536)) AS i FROM (SELECT string_agg(coalesce(dna, '') || '$', '' ORDER BY path_id) AS text FROM path LEFT JOIN dna USING (path_id)))""", DNA)
def dump_file(g):
    out = shared_path(g.visit.sparkSession, "dump")
    sinks.write_dump(g, out, end="$")
    pieces = raw.read_blocks(g.visit.sparkSession, out)
    whole = F.octet_length("data") == 1 << 16
    # a part may end within a block; only what it cuts has to meet
    cuts = pieces.where(~whole).groupBy((F.col("at") - F.col("at") % (1 << 16)).alias("block"))
    parts = cuts.agg(F.sort_array(F.collect_list(F.struct("at", F.decode("data", "US-ASCII").alias("text")))).alias("p"))
    parts = parts.select(F.col("block").alias("at"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return pieces.where(whole).select("at", F.decode("data", "US-ASCII").alias("text")).union(parts)


@over(event_graph, "SELECT rank, tag FROM suffixes JOIN ttag USING (text_offset)", TEXT_TAGS)
def tag_file(g):
    spark = g.visit.sparkSession
    text, suffixes = text_tags(g)
    array, out = shared_path(spark, "suffixes"), shared_path(spark, "tags")
    # an array that begins with an entry that isn't one of its suffixes, as builders write it
    first = spark.range(1).select(F.col("id").alias("at"), F.lit(-1).cast("long").alias("value"))
    raw.write_words(suffixes.select((F.col("rank") + 1).alias("at"), F.col("text_offset").alias("value")).union(first), array)
    sinks.write_tag_words(tags.tag_array(text, gfa_files.read_suffix_array(spark, array)), out)
    return raw.read_numbers(spark, out).select(F.col("at").alias("rank"), F.col("value").alias("tag"))


@over(event_graph, """
SELECT sum(CASE WHEN symbol = before THEN 0 ELSE 1 END)::BIGINT AS runs FROM (SELECT symbol, lag(symbol) OVER (ORDER BY rank) AS before FROM (
  SELECT rank, CASE WHEN text_offset = start THEN '$' ELSE substr(dna, text_offset - start, 1) END AS symbol
  FROM suffixes JOIN (SELECT *, unnest(range(bp + 1)) + start AS text_offset FROM estart) USING (text_offset)))""", TEXT_TAGS)
def bwt_runs(g):
    spark = g.visit.sparkSession
    _, suffixes = text_tags(g)
    dump, out = shared_path(spark, "dump"), shared_path(spark, "bwt")
    sinks.write_dump(g, dump, end="$")
    # the byte before each suffix; before the whole text, its last one
    before = raw.read_numbers(spark, dump, width=1).select((F.col("at") + 1).alias("text_offset"), "value")
    symbol = F.coalesce(F.chr("value"), F.lit("$")).cast("binary").alias("data")
    raw.write_bytes(suffixes.join(before, "text_offset", "left").select(F.col("rank").alias("at"), symbol), out)
    return tags.count_runs(gfa_files.read_bwt(spark, out, skip=0), "rank", "symbol", 1 << 12)


# ---------------------------------------------------------------- scalars over tables


def range_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lo, hi = handles.intersect("l_partkey", F.col("l_partkey") + 100, "l_suppkey", F.col("l_suppkey") + 100)
    return li.select(lo.alias("lo"), hi.alias("hi")).groupBy(F.greatest(F.col("hi") - F.col("lo"), F.lit(0)).alias("len")).agg(F.count("*").alias("n"))


def readable_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") * F.col("o_orderkey") * 1000).alias("n_bytes")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", n)
    value, unit = names.readable_size("n_bytes")
    return rows.select("o_orderkey", F.round(value, 3).alias("value"), unit.alias("unit"))


def top_subpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pattern, n)``: the 100 most frequent 3-node subpaths of the order graph, both orientations counted."""
    visit = order_graph(spark, sf_dir).visit
    n = search.all_subpaths(visit, 3).where("k = 3").select(text("pattern").alias("pattern"), "n")
    return n.orderBy(F.col("n").desc(), "pattern").limit(100)


QUERIES |= {"range_intersect": range_intersect, "readable_size": readable_size, "top_subpaths": top_subpaths}
ORACLE_SQL |= {
    "range_intersect": """
SELECT greatest(least(l_partkey + 100, l_suppkey + 100) - greatest(l_partkey, l_suppkey), 0) AS len, count(*) AS n FROM lineitem GROUP BY 1""",
    "readable_size": """
SELECT o_orderkey, round(CASE WHEN n >= 1099511627776 THEN n / 1099511627776.0::DOUBLE WHEN n >= 1073741824 THEN n / 1073741824.0::DOUBLE WHEN n >= 1048576 THEN n / 1048576.0::DOUBLE
    WHEN n >= 1024 THEN n / 1024.0::DOUBLE ELSE n END, 3) AS value,
  CASE WHEN n >= 1099511627776 THEN 'TiB' WHEN n >= 1073741824 THEN 'GiB' WHEN n >= 1048576 THEN 'MiB' WHEN n >= 1024 THEN 'KiB' ELSE 'B' END AS unit
FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 1000)::DOUBLE AS n FROM orders)""",
    "top_subpaths": BASE + f", grams AS ({lead_gram(3, 'visit', 'seq_id')}) SELECT pattern, count(*)::BIGINT AS n FROM grams GROUP BY pattern ORDER BY n DESC, pattern LIMIT 100",
}


def gfa_mode(name: str, mode: str, parts: list[str]) -> None:
    """Register the lines of a whole file in one of its modes, with their part and their place in it."""
    QUERIES[name] = lambda spark, sf_dir: sinks.gfa(order_graph(spark, sf_dir), mode)
    place = {"gfa_header": "0::BIGINT AS a, 0::BIGINT AS b", "gfa_segments": "ordinal AS a, 0::BIGINT AS b", "gfa_links": "g AS a, next_g AS b"}
    number = {"gfa_header": 0, "gfa_segments": 1, "gfa_links": 2, "gfa_walks": 4}
    ORACLE_SQL[name] = " UNION ALL ".join(f"SELECT {number.get(p, 3)} AS part, {place.get(p, 'path_id AS a, 0::BIGINT AS b')}, line FROM ({ORACLE_SQL[p]})" for p in parts)


gfa_mode("gfa_default", "default", ["gfa_header", "gfa_segments", "gfa_links", "gfa_paths", "gfa_walks"])
gfa_mode("gfa_all_pansn", "pan-sn", ["gfa_header", "gfa_segments", "gfa_links", "gfa_pansn"])
gfa_mode("gfa_references", "ref-only", ["gfa_header", "gfa_segments", "gfa_links", "gfa_paths"])

"""The test tables' path graphs as SQL, for the queries that results are checked against."""

from __future__ import annotations

from walkframe.functions.names import GENERIC_SAMPLE

#: Common table expressions: p, segment, segment_visit, fvisit, visit, node, path, sample, contig, efvisit, evisit, enode.
BASE = """
WITH RECURSIVE p AS (SELECT max(p_partkey) + 1 AS p FROM part),
seg0 AS (SELECT (r_regionkey * p + p_partkey)::BIGINT AS seg_id, p_size::BIGINT AS bp FROM region, part, p),
segment AS (
  SELECT seg_id, 's' || seg_id AS name,
    substr(translate(md5('a' || seg_id) || md5('b' || seg_id), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, bp::INTEGER) AS seq,
    (1 + sum((bp + 9) // 10) OVER (ORDER BY seg_id) - (bp + 9) // 10)::BIGINT AS node_lo,
    (1 + sum((bp + 9) // 10) OVER (ORDER BY seg_id))::BIGINT AS node_hi
  FROM seg0
), segment_visit AS (
  SELECT l_orderkey AS path_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS sv,
    (n_regionkey * p + l_partkey)::BIGINT AS seg_id, l_returnflag = 'R' AS is_rev
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey, p
), placed AS (
  SELECT v.*, s.node_lo, s.node_hi,
    coalesce(sum(s.node_hi - s.node_lo) OVER (PARTITION BY path_id ORDER BY sv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM segment_visit v JOIN segment s USING (seg_id)
), exploded AS (SELECT *, unnest(range(node_hi - node_lo)) AS i FROM placed),
fvisit AS (
  SELECT path_id, (before + i)::BIGINT AS pos,
    (2 * CASE WHEN is_rev THEN node_hi - 1 - i ELSE node_lo + i END + is_rev::BIGINT)::BIGINT AS g
  FROM exploded
), visit AS (
  SELECT 2 * path_id AS seq_id, pos, g FROM fvisit
  UNION ALL
  SELECT 2 * path_id + 1, max(pos) OVER (PARTITION BY path_id) - pos, xor(g, 1) FROM fvisit
), node AS (
  SELECT node_id, seq FROM (
    SELECT node_lo + i AS node_id, substr(seq, (10 * i + 1)::INTEGER, 10) AS seq
    FROM (SELECT node_lo, seq, unnest(range(node_hi - node_lo)) AS i FROM segment))
  WHERE node_id IN (SELECT g // 2 FROM fvisit)
), path AS (
  SELECT o_orderkey AS path_id, CASE WHEN o_custkey % 20 = 0 THEN 0 ELSE o_custkey END AS sample_id, n_regionkey::BIGINT AS contig_id,
    CASE WHEN o_custkey % 20 = 0 THEN 0 ELSE 1 + o_orderkey % 2 END::BIGINT AS phase,
    CASE WHEN o_custkey % 20 = 0 THEN 0 ELSE date_diff('day', DATE '1995-01-01', o_orderdate::DATE) END::BIGINT AS fragment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderkey IN (SELECT path_id FROM fvisit)
), sample AS (
  SELECT c_custkey AS sample_id, CASE WHEN c_custkey = 0 THEN '{generic}' ELSE 'c' || c_custkey END AS name
  FROM customer WHERE c_custkey % 20 <> 0 OR c_custkey = 0
), contig AS (SELECT r_regionkey::BIGINT AS contig_id, r_name AS name FROM region),
named AS (
  SELECT path_id, sample_id, contig_id, phase, fragment, coalesce(s.name, sample_id::VARCHAR) AS sample, coalesce(c.name, contig_id::VARCHAR) AS contig
  FROM path LEFT JOIN sample s USING (sample_id) LEFT JOIN contig c USING (contig_id)
), efvisit AS (
  SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    (2 * (1 + 8 * (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1) + json_extract(props, '$.k')::BIGINT % 8) + (value > 150)::BIGINT)::BIGINT AS g
  FROM events
), evisit AS (
  SELECT 2 * path_id AS seq_id, pos, g FROM efvisit
  UNION ALL
  SELECT 2 * path_id + 1, max(pos) OVER (PARTITION BY path_id) - pos, xor(g, 1) FROM efvisit
), enode AS (
  SELECT node_id, substr(translate(md5('e' || node_id), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, (1 + node_id % 7)::INTEGER) AS seq
  FROM (SELECT DISTINCT g // 2 AS node_id FROM efvisit)
)
""".replace("{generic}", GENERIC_SAMPLE)

#: Distinct edges of the order graph over both orientations, without ends.
EDGES = """, nxt AS (SELECT seq_id, pos, g, lead(g) OVER (PARTITION BY seq_id ORDER BY pos) AS next_g FROM visit),
edges AS (SELECT DISTINCT g, next_g FROM nxt WHERE next_g IS NOT NULL)
"""

#: Positions of the event graph with the next one, ``erec``.
ORDER = """, prefixed AS (
  SELECT a.seq_id, a.pos, a.g, list(b.g ORDER BY b.pos DESC) FILTER (WHERE b.pos < a.pos) AS pre
  FROM evisit a JOIN evisit b ON a.seq_id = b.seq_id AND b.pos <= a.pos GROUP BY a.seq_id, a.pos, a.g
), ord AS (
  SELECT seq_id, pos, g, row_number() OVER (PARTITION BY g ORDER BY list_concat(coalesce(pre, []), [0, seq_id])) - 1 AS off FROM prefixed
), erec AS (
  SELECT g, off, coalesce(lead(g) OVER w, 0) AS next_g, coalesce(lead(off) OVER w, 0) AS next_off, seq_id, pos
  FROM ord WINDOW w AS (PARTITION BY seq_id ORDER BY pos)
)
"""

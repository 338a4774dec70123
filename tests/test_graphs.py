"""Known values on small graphs, round trips, and invariants of the order of visits."""

import random
import struct

import pytest
from graphs import BUBBLES, CHOPPED, WALKS, handles_of
from pyspark.sql import functions as F

from walkframe.functions import dna, handles, names
from walkframe.operators import contigs, lcs, metadata, navigation, order, positions, search, segments, tags
from walkframe.sources import gfa, sinks


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(scope="module")
def bubbles(spark, tmp_path_factory):
    f = tmp_path_factory.mktemp("g") / "bubbles.gfa"
    f.write_text(BUBBLES.text())
    return gfa.read_gfa(spark, str(f))


@pytest.fixture(scope="module")
def chopped(spark, tmp_path_factory):
    f = tmp_path_factory.mktemp("g") / "chopped.gfa"
    f.write_text(CHOPPED.text())
    return gfa.read_gfa(spark, str(f), node_bp=2)


def walks_of(graph):
    """Forward walks of handles, where names are node ids."""
    return [[2 * int(graph.segments[i][0]) + r for i, r in steps] for _, steps in graph.walks]


def test_statistics(bubbles):
    s, walks = navigation.statistics(bubbles.visit).first(), walks_of(BUBBLES)
    nodes = {g // 2 for w in walks for g in w}
    assert (s["size"], s.sequences) == (2 * sum(map(len, walks)) + 2 * len(walks), 2 * len(walks))
    assert (s.alphabet_size, s.alphabet_offset) == (2 * max(nodes) + 2, 2 * min(nodes) - 1)
    assert (s.nodes, s.min_node, s.max_node) == (len(nodes), min(nodes), max(nodes))


def test_statistics_with_an_empty_walk(spark, tmp_path):
    (tmp_path / "walks.txt").write_text(WALKS)
    walks = gfa.read_walks(spark, str(tmp_path / "walks.txt"))
    assert walks.count() == 6
    assert rows(gfa.visits_of_walks(walks)) == [(k, i, int(g)) for k, w in enumerate(WALKS.splitlines()) for i, g in enumerate(w.split(",") if w else [])]


def test_edges(bubbles):
    edges = {e for w in handles_of(walks_of(BUBBLES)) for e in zip(w, w[1:])}
    assert rows(navigation.successors(bubbles.visit), "g", "successor") == sorted(edges)
    assert rows(navigation.predecessors(bubbles.visit), "predecessor", "g") == sorted(edges)
    assert navigation.canonical_edges(bubbles.visit).count() == len({min((a, b), (b ^ 1, a ^ 1)) for a, b in edges})


def test_search(spark, bubbles):
    o = order.visit_order(navigation.bidirectional(bubbles.visit))
    walks = handles_of(walks_of(BUBBLES))
    times = lambda p: sum(w[i : i + len(p)] == list(p) for w in walks for i in range(len(w)))
    assert rows(search.find(o), "g", "lo", "hi") == sorted((g, 0, times([g])) for g in {g for w in walks for g in w})
    asked = {"a": walks[2][:3], "b": walks[2][2::-1], "c": walks[-2][1:4]}
    q = spark.createDataFrame(list(asked.items()), "query_id string, pattern array<bigint>")
    assert rows(search.count_occurrences(bubbles.visit, q, [3])) == [(k, times(p)) for k, p in asked.items()]
    grams = {tuple(w[i : i + 3]) for w in walks for i in range(len(w) - 2)}
    assert {tuple(r.pattern): r.n for r in search.states(o, 3).collect()} == {g: times(g) for g in grams}
    every = {tuple(r.pattern): r.n for r in search.all_subpaths(bubbles.visit, 4).collect()}
    assert every == {p: times(p) for p in {tuple(w[i : i + k]) for w in walks for k in range(1, 5) for i in range(len(w) - k + 1)}}


def test_states_are_ranges_and_mirror(bubbles):
    o = order.visit_order(navigation.bidirectional(bubbles.visit))
    for k in (1, 2, 3):
        for r in search.states(o, k).collect():
            assert r.hi - r.lo == r.n
    b = search.bidirectional_states(o, 2)
    assert b.where("fwd_hi - fwd_lo <> rev_hi - rev_lo").count() == 0
    edges = {e for w in handles_of(walks_of(BUBBLES)) for e in zip(w, w[1:])}
    assert rows(search.state_ends(b), "from.id", "from.is_rev", "to.id", "to.is_rev") == sorted((a // 2, bool(a % 2), z // 2, bool(z % 2)) for a, z in edges)


def test_names(bubbles):
    n = {r.path_id: (r.name, r.pansn) for r in metadata.path_names(bubbles).collect()}
    for k, ((sample, phase, contig), _) in enumerate(BUBBLES.walks):
        if sample:
            assert n[k] == (f"{sample}#{phase}#{contig}@0", f"{sample}#{phase}#{contig}")
        else:
            assert n[k][0] == contig
    assert rows(bubbles.path.join(bubbles.contig.where("name = 'Y'"), "contig_id"), "path_id") == [(k,) for k, ((_, _, c), _) in enumerate(BUBBLES.walks) if c == "Y"]
    assert rows(bubbles.sample) == [(0, names.GENERIC_SAMPLE), (1, "donor")]


def test_components(bubbles):
    c = contigs.node_components(bubbles.visit)
    of = {contig: {g // 2 for w, ((_, _, x), _) in zip(walks_of(BUBBLES), BUBBLES.walks) if x == contig for g in w} for contig in "XY"}
    assert rows(contigs.component_sizes(c)) == sorted((min(x), len(x), max(x)) for x in of.values())
    assert rows(contigs.paths_of_contig(bubbles.visit, bubbles.path, 1, c)) == [(k,) for k, ((_, _, x), _) in enumerate(BUBBLES.walks) if x == "Y"]


def test_chopped_segments(chopped):
    ranges = CHOPPED.ranges(2)
    used = sorted({i for _, steps in CHOPPED.walks for i, _ in steps})
    assert rows(chopped.segment, "seg_id", "name", "node_lo", "node_hi") == [(i, n, *ranges[i]) for i, (n, _) in enumerate(CHOPPED.segments)]
    assert len(used) < len(CHOPPED.segments)
    assert rows(chopped.node) == [(lo + k, CHOPPED.segments[i][1][2 * k : 2 * k + 2]) for i in used for lo, hi in [ranges[i]] for k in range(hi - lo)]
    links = segments.segment_links(chopped.segment, chopped.node, chopped.visit).where("not is_rev")
    assert rows(links, "seg_id", "next_seg") == sorted({(a, b) for _, steps in CHOPPED.walks for (a, _), (b, _) in zip(steps, steps[1:])})
    walks = {r.path_id: [g // 2 for g in r.handles] for r in navigation.path_arrays(chopped.visit).collect()}
    assert walks == {k: [x for i, _ in steps for x in range(*ranges[i])] for k, (_, steps) in enumerate(CHOPPED.walks)}
    assert rows(segments.used_segments(chopped.segment, chopped.node), "seg_id") == [(i,) for i in used]


def test_subsequence_of_chopped_walks(spark, chopped):
    arrays = navigation.path_arrays(chopped.visit)
    pairs = spark.createDataFrame([(2, 3), (0, 3), (2, 5)], "a_id long, b_id long")
    walks = {r.path_id: r.handles for r in arrays.collect()}
    bp = {2 * r.node_id: len(r.seq) for r in chopped.node.collect()}
    for r in lcs.weighted_lcs(lcs.path_pairs(arrays, pairs, lcs.node_weights(chopped.node))).collect():
        a, b = (walks[int(x)] for x in r.pair_id.split("-"))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + bp[x] * (x == y))
        assert r.weight == best[-1][-1] == sum(bp[a[p.i]] for p in r.pairs) and all(a[p.i] == b[p.j] for p in r.pairs)


def test_broken_segment_walks_stop(spark, chopped):
    # all of the first segment and what follows; the first node of the third and then of the fourth; a walk of one node
    ranges = CHOPPED.ranges(2)
    whole = [2 * x for x in range(*ranges[0])] + [2 * ranges[1][0]]
    broken = [2 * ranges[3][0], 2 * ranges[4][0]]
    assert ranges[0][1] - ranges[0][0] > 1 < ranges[3][1] - ranges[3][0] and ranges[1][1] - ranges[1][0] == 1
    data = [(p, i, g) for p, w in enumerate((whole, broken, whole[:1])) for i, g in enumerate(w)]
    visit = spark.createDataFrame(data, "path_id long, pos long, g long")
    got = rows(segments.segment_paths_exact(visit, chopped.segment), "path_id", "seg_no", "seg_id")
    assert got == [(0, 0, 0), (0, 1, 1), (1, 0, 3), (2, 0, 0)]
    assert rows(segments.segment_paths(visit, chopped.segment), "path_id", "seg_no", "seg_id") == got


@pytest.mark.parametrize("which", ["bubbles", "chopped"])
def test_gfa_round_trip(spark, tmp_path, request, which):
    graph = request.getfixturevalue(which)
    sinks.write_gfa(graph, str(tmp_path / "out"))
    again = gfa.read_gfa(spark, str(tmp_path / "out"), node_bp=2)
    for part in ("default", "pan-sn", "ref-only"):
        assert rows(sinks.gfa(graph, part), "line") == rows(sinks.gfa(again, part), "line")
    lines = {r.line for r in sinks.gfa(graph).collect()}
    graph_of = BUBBLES if which == "bubbles" else CHOPPED
    source = graph_of.text()
    idle = {n for i, (n, _) in enumerate(graph_of.segments) if all(i != j for _, steps in graph_of.walks for j, _ in steps)}
    assert {x for x in source.splitlines() if x[0] in "PW"} <= lines
    assert {x for x in source.splitlines() if x[0] == "S" and x.split("\t")[1] not in idle} == {x for x in lines if x[0] == "S"}


def test_write_and_read_tables(spark, tmp_path, chopped):
    chopped.write(str(tmp_path / "t"))
    again = type(chopped).read(spark, str(tmp_path / "t"))
    assert rows(again.visit) == rows(chopped.visit) and rows(again.path) == rows(chopped.path)


def test_orders_agree_and_step(spark):
    rng = random.Random(5)
    data = [(p, i, 2 * rng.randint(1, 4) + rng.randint(0, 1)) for p in range(6) for i in range(rng.randint(1, 40))]
    visit = spark.createDataFrame(data, "path_id long, pos long, g long")
    seqs = navigation.bidirectional(visit)
    a = order.by_prefix_arrays(seqs)
    assert rows(a) == rows(order.by_doubling(seqs).select("g", "off", "seq_id", "pos"))
    walks = {}
    for s, p, g in sorted((r.seq_id, r.pos, r.g) for r in seqs.collect()):
        walks.setdefault(s, []).append(g)
    keyed = sorted((g, w[:i][::-1] + [0, s], s, i) for s, w in walks.items() for i, g in enumerate(w))
    want, last, n = [], None, 0
    for g, _, s, i in keyed:
        n, last = (n + 1, last) if g == last else (0, g)
        want.append((g, n, s, i))
    assert rows(a) == sorted(want)
    # along an edge, offsets in the next record are consecutive from the edge's own
    r = order.with_next(a)
    e = {(x.g, x.next_g): x.next_off for x in order.record_edges(r).collect()}
    for (g, ng), group in _by(r.where("next_g <> 0").collect()).items():
        assert [x.next_off for x in sorted(group, key=lambda x: x.off)] == list(range(e[g, ng], e[g, ng] + len(group)))


def _by(found):
    out = {}
    for x in found:
        out.setdefault((x.g, x.next_g), []).append(x)
    return out


def test_subsequences_against_the_textbook(spark):
    rng = random.Random(3)

    def table(a, b, w):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w.get(x, 1) if x == y else 0)
        return best[-1][-1]

    cases = [([], [], {}), ([1], [], {}), ([1, 2, 3], [1, 2, 3], {2: 5})]
    for _ in range(40):
        sigma = rng.choice([2, 5, 20])
        cases.append(([rng.randint(1, sigma) for _ in range(rng.randint(0, 60))], [rng.randint(1, sigma) for _ in range(rng.randint(0, 60))], {i: rng.randint(0, 9) for i in range(1, sigma + 1)}))
    for a, b, w in cases:
        pairs, weight = lcs.lcs_of_pair(a, b, w)
        assert weight == table(a, b, w) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    df = spark.createDataFrame([(str(i), a, b, w) for i, (a, b, w) in enumerate(cases)], "pair_id string, a array<long>, b array<long>, weight map<long,long>")
    got = df.select("pair_id", lcs.weight_by_table(F.col("a"), F.col("b"), F.col("weight")).alias("w"))
    assert {r.pair_id: r.w for r in got.collect()} == {str(i): table(*c) for i, c in enumerate(cases)}


def test_similar_walks_are_quick():
    rng = random.Random(1)
    a = [rng.randint(1, 1000) for _ in range(10_000)]
    b = [x if rng.random() > 0.01 else 0 for x in a]
    assert lcs.lcs_of_pair(a, b, {})[1] == sum(x == y for x, y in zip(a, b))


def test_reverse_complement(spark):
    df = spark.createDataFrame([("GATTACA",), ("GATTACAT",), ("acgx",), ("",)], "s string")
    assert [r[0] for r in df.select(dna.reverse_complement("s")).collect()] == ["TGTAATC", "ATGTAATC", "NCGT", ""]


def test_long_nodes_have_no_tag(spark):
    df = spark.createDataFrame([(6, 1023), (6, 1024), (7, 0)], "g long, o long")
    assert [r[0] for r in df.select(dna.tag("g", "o")).collect()] == [(3 << 11) + 1023, None, (3 << 11) + 1024]


def test_empty_path_is_canonical(spark):
    df = spark.createDataFrame([(None, None), (2, 4), (3, 5), (3, 4), (5, 2), (3, 2)], "a long, b long")
    assert [r[0] for r in df.select(handles.path_is_canonical("a", "b")).collect()] == [True, True, False, True, False, True]


def test_reference_positions_against_a_loop(chopped):
    offsets = positions.path_offsets(chopped.visit, chopped.node)
    walks = {}
    for p, i, o in rows(offsets, "path_id", "pos", "offset"):
        walks.setdefault(p, []).append((i, o))
    for interval in range(9):
        want = []
        for p, w in walks.items():
            due = 0
            for i, o in w:
                if o >= due:
                    want.append((p, i, o))
                    due = o + interval
        assert rows(positions.reference_positions(offsets, interval)) == sorted(want)


def test_tag_array_files(spark, tmp_path, chopped):
    starts = positions.text_offsets(positions.path_lengths(chopped.visit, chopped.node).select("path_id", "bp"))
    text = tags.tags_of_text(chopped.visit, chopped.node, starts)
    n = text.count()
    assert n == sum(len(CHOPPED.segments[i][1]) for _, steps in CHOPPED.walks for i, _ in steps) + len(CHOPPED.walks)
    order_ = list(range(n))
    random.Random(2).shuffle(order_)
    (tmp_path / "x.sa").write_bytes(struct.pack(f"<{n + 1}q", n, *order_))
    sa = gfa.read_suffix_array(spark, str(tmp_path / "x.sa"))
    assert rows(sa) == list(enumerate(order_))
    found = [t for _, t in rows(tags.tag_array(text, sa))]
    of = dict(rows(text))
    assert found == [of[o] for o in order_]
    runs = 1 + sum(a != b for a, b in zip(found, found[1:]))
    for width in (4, 1 << 20):
        assert tags.count_runs(tags.tag_array(text, sa), "rank", "tag", width).first().runs == runs


def test_tags_and_reference_samples(spark, chopped):
    t = spark.createDataFrame([("index", "Source", "x"), ("index", "reference_samples", "donor nobody")], "scope string, key string, value string")
    new = spark.createDataFrame([("index", "SOURCE", "y")], "scope string, key string, value string")
    assert rows(metadata.set_tags(t, new)) == [("index", "reference_samples", "donor nobody"), ("index", "source", "y")]
    assert metadata.remove_tags(t, "source").count() == 1
    assert rows(metadata.reference_samples(chopped, True), "name") == [(names.GENERIC_SAMPLE,), ("donor",)]
    nobody = spark.createDataFrame([("nobody",), (names.GENERIC_SAMPLE,)], "name string")
    assert metadata.set_reference_samples(chopped, nobody).count() == 0


def test_components_of_random_graphs(spark):
    from walkframe.operators.components import connected_components

    rng = random.Random(9)
    for n, m in ((30, 0), (60, 25), (60, 80)):
        edges = [(rng.randint(0, n), rng.randint(0, n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(40)]
        label = {x: x for e in edges for x in e}
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                low = min(label[a], label[b])
                changed |= label[a] != low or label[b] != low
                label[a] = label[b] = low
        df = spark.createDataFrame([*edges, (None, 1), (7, 7)], "src long, dst long")
        got = {r.node: r.component for r in connected_components(df).collect()}
        assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}

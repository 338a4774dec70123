"""Subpath search over batches of patterns.

A pattern is an array of handles. Counting needs forward walks only: a mirror
image contains a pattern where the forward walk contains the mirrored pattern.
Search states (ranges of offsets) come from ordered positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, Window as W

from walkframe.functions.handles import decode, flip, reverse_path


def kgrams(visit: DataFrame, k: int, walk: str = "path_id") -> DataFrame:
    """``(walk, pos, gram)``: the ``k`` handles from each visit on, where the walk is long enough."""
    w = W.partitionBy(walk).orderBy("pos")
    cols = [F.col("g")] + [F.lead("g", i).over(w) for i in range(1, k)]
    grams = visit.select(walk, "pos", *[c.alias(f"g{i}") for i, c in enumerate(cols)])
    last = f"g{k - 1}"
    return grams.where(F.col(last).isNotNull()).select(walk, "pos", F.array(*[f"g{i}" for i in range(k)]).alias("gram"))


def count_occurrences(visit: DataFrame, queries: DataFrame, lengths: list[int]) -> DataFrame:
    """Of ``(query_id, pattern)`` with patterns of the given lengths: ``(query_id, n)`` over both orientations.

    Grams are counted before they meet the patterns, so a popular subpath is one row.
    """
    both = queries.select("query_id", F.col("pattern").alias("gram")).union(queries.select("query_id", reverse_path("pattern").alias("gram")))
    found = []
    for k in sorted(set(lengths)):
        n = kgrams(visit, k).groupBy("gram").agg(F.count("*").alias("n"))
        found.append(both.where(F.size("gram") == k).join(n, "gram").select("query_id", "n"))
    hits = reduce(DataFrame.union, found).groupBy("query_id").agg(F.sum("n").alias("n"))
    return queries.join(hits, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))


def find(records: DataFrame) -> DataFrame:
    """``(g, lo, hi)``: the range of each handle, all its visits."""
    return records.groupBy("g").agg(F.lit(0).cast("long").alias("lo"), F.count("*").alias("hi"))


def states(order: DataFrame, k: int) -> DataFrame:
    """``(pattern, g, lo, hi, n)`` of every subpath of ``k`` handles: the range of its last handle's visits."""
    w = W.partitionBy("seq_id").orderBy("pos")
    cols = [F.lag("g", k - 1 - i).over(w) for i in range(k - 1)] + [F.col("g")]
    rows = order.select("off", "g", F.array(*cols).alias("pattern"), cols[0].alias("first")).where(F.col("first").isNotNull())
    return rows.groupBy("pattern").agg(
        F.first("g").alias("g"), F.min("off").alias("lo"), (F.max("off") + 1).alias("hi"), F.count("*").alias("n")
    )


def extend(order: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, g, lo, hi)`` of the patterns (of length ``k``) that occur."""
    return queries.join(states(order, k), "pattern").select("query_id", "g", "lo", "hi")


def bidirectional_states(order: DataFrame, k: int) -> DataFrame:
    """``(pattern, fwd_g, fwd_lo, fwd_hi, rev_g, rev_lo, rev_hi)``: a pattern's range, and that of its mirror image."""
    s = states(order, k)
    mirrored = s.select(reverse_path("pattern").alias("pattern"), F.col("g").alias("rev_g"), F.col("lo").alias("rev_lo"), F.col("hi").alias("rev_hi"))
    return s.select("pattern", F.col("g").alias("fwd_g"), F.col("lo").alias("fwd_lo"), F.col("hi").alias("fwd_hi")).join(mirrored, "pattern")


def extend_state(order: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """All extensions to the right, by one handle, of bidirectional states of ``k`` handles."""
    longer = bidirectional_states(order, k + 1).withColumn("start", F.slice("pattern", 1, k))
    return longer.join(state.select(F.col("pattern").alias("start")), "start", "left_semi").drop("start")


def extend_state_left(order: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """All extensions to the left: read from the other end, extended to the right, and read from the first end again."""
    return flip_state(extend_state(order, flip_state(state), k))


def flip_state(state: DataFrame) -> DataFrame:
    """The same occurrences read from the other end."""
    swap = {"fwd": "rev", "rev": "fwd"}
    return state.select(reverse_path("pattern").alias("pattern"), *[F.col(f"{swap[a]}_{b}").alias(f"{a}_{b}") for a in ("fwd", "rev") for b in ("g", "lo", "hi")])


def state_ends(state: DataFrame) -> DataFrame:
    """``(pattern, from, to, n)``: the first and the last handle of a state, and its occurrences."""
    return state.select("pattern", decode(flip("rev_g")).alias("from"), decode("fwd_g").alias("to"), (F.col("fwd_hi") - F.col("fwd_lo")).alias("n"))


def follow_forward(order: DataFrame, k: int) -> DataFrame:
    """All extensions by one handle of every subpath of length ``k``: ``(pattern, next_g, n, lo, hi)``."""
    longer = states(order, k + 1)
    return longer.select(F.slice("pattern", 1, k).alias("pattern"), F.col("g").alias("next_g"), "n", "lo", "hi")


def follow_backward(order: DataFrame, k: int) -> DataFrame:
    """All extensions to the left: ``(pattern, prev_g, n)``."""
    longer = states(order, k + 1)
    return longer.select(F.slice("pattern", 2, k).alias("pattern"), F.element_at("pattern", 1).alias("prev_g"), "n")


def all_subpaths(visit: DataFrame, longest: int) -> DataFrame:
    """``(k, pattern, n)``: every distinct subpath of up to ``longest`` handles over both orientations."""
    found = []
    for k in range(1, longest + 1):
        n = kgrams(visit, k).groupBy("gram").agg(F.count("*").alias("n"))
        both = n.union(n.select(reverse_path("gram").alias("gram"), "n"))
        found.append(both.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(k).alias("k"), F.col("gram").alias("pattern"), "n"))
    return reduce(DataFrame.union, found)


def sample_patterns(visit: DataFrame, k: int, digits: int = 3) -> DataFrame:
    """``(query_id, pattern)``: subpaths from about one in ``16 ** digits`` visits, the same on every run.

    Short walks give none, as grams need ``k`` handles.
    """
    key = F.concat(F.col("path_id").cast("string"), F.lit(":"), F.col("pos").cast("string"))
    drawn = kgrams(visit, k).where(F.substring(F.md5(key), 1, digits) == "0" * digits)
    return drawn.select(key.alias("query_id"), F.col("gram").alias("pattern"))


def sample_by_node(visit: DataFrame, k: int, digits: int = 1) -> DataFrame:
    """``(query_id, pattern)``: about one in ``16 ** digits`` visited handles, each as likely as any other, and a visit of each drawn by a keyed hash.

    A handle's least hash is found in the tasks, so a popular handle is drawn no more often and is no task's work. Visits are drawn
    over both orientations; where the walk is too short from there on, the handle gives none, as a random visit would.
    """
    from walkframe.operators.navigation import bidirectional

    seqs = bidirectional(visit)
    asked = seqs.where(F.substring(F.md5(F.concat(F.lit("node:"), F.col("g").cast("string"))), 1, digits) == "0" * digits)
    key = F.concat(F.col("seq_id").cast("string"), F.lit(":"), F.col("pos").cast("string"))
    drawn = asked.groupBy("g").agg(F.min(F.struct(F.md5(key).alias("hash"), "seq_id", "pos")).alias("v")).select("v.seq_id", "v.pos")
    grams = kgrams(seqs.join(drawn.select("seq_id").distinct(), "seq_id", "left_semi"), k, "seq_id")
    return grams.join(drawn, ["seq_id", "pos"]).select(key.alias("query_id"), F.col("gram").alias("pattern"))

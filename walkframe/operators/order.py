"""The order of visits within a handle: by what was walked before, read backwards.

Position ``(g, off)`` is the ``off``-th visit of handle ``g`` in the order of reversed
prefixes, a walk's beginning first and then by sequence. All occurrences of a
subpath are therefore one range of offsets, which is what subpath search uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from walkframe.session import cut

#: Walks longer than this are ordered by doubling: arrays of all prefixes grow with the square of the length.
LONGEST_ARRAY = 2000


def by_prefix_arrays(seqs: DataFrame) -> DataFrame:
    """Offsets of ``(seq_id, pos, g)`` by sorting each handle's visits on their whole reversed prefix."""
    walk = F.sort_array(F.collect_list(F.struct("pos", "g")))
    walks = seqs.groupBy("seq_id").agg(F.transform(walk, lambda x: x["g"]).alias("walk"))
    visits = walks.select("seq_id", F.posexplode("walk").alias("pos", "g"), "walk")
    end = F.array(F.lit(0).cast("long"), F.col("seq_id"))
    prefix = F.concat(F.reverse(F.slice("walk", F.lit(1), F.col("pos"))), end)
    keyed = visits.select("seq_id", F.col("pos").cast("long").alias("pos"), "g", prefix.alias("prefix"))
    off = F.row_number().over(W.partitionBy("g").orderBy("prefix")) - 1
    return keyed.select("g", off.cast("long").alias("off"), "seq_id", "pos")


def by_doubling(seqs: DataFrame) -> DataFrame:
    """The same offsets by prefix doubling: each round sorts pairs of ranks at twice the distance.

    A rank is the number of visits with a smaller key, so it needs no dense
    numbering: counts of distinct keys are summed in key order over range
    partitions, and a hot handle's visits are spread as soon as their prefixes differ.
    """
    real = doubling_rounds(seqs)[-1].where("pos >= 0")
    low = real.groupBy("g").agg(F.min("rank").alias("low"))
    # ranks of one handle are consecutive
    return real.join(low, "g").select("g", (F.col("rank") - F.col("low")).alias("off"), "seq_id", "pos")


def doubling_rounds(seqs: DataFrame) -> list[DataFrame]:
    """Of each round r: ``(seq_id, pos, g, rank)``, where visits that agree over 2^r handles backwards rank alike; in the last all differ.

    A row at position -1 stands for the end before each sequence.
    """
    # before the first visit of a sequence stands an end that is unlike any other, in the order of sequences
    ends = seqs.select("seq_id").distinct().select("seq_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("g"))
    everything = ends.union(seqs.select("seq_id", "pos", "g"))
    key = F.struct("g", F.when(F.col("pos") < 0, F.col("seq_id")).otherwise(F.lit(-1)).alias("tie"))
    rounds = [cut(ranked(everything.withColumn("key", key)))]
    step, total = 1, rounds[0].count()
    while rounds[-1].select("rank").distinct().count() < total:
        back = F.lag("rank", step).over(W.partitionBy("seq_id").orderBy("pos"))
        key = F.struct("rank", F.coalesce(back, F.lit(-1)).alias("before"))
        rounds, step = [*rounds, cut(ranked(rounds[-1].withColumn("key", key)))], step * 2
    return rounds


def ranked(rows: DataFrame) -> DataFrame:
    """Replace ``rank`` by the number of rows with a smaller ``key``."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    ordered = cut(counts.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()))
    parts = ordered.groupBy("part").agg(F.sum("n").alias("part_n"))  # one row a partition
    before = F.coalesce(F.sum("part_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = ordered.join(parts.select("part", before.alias("before")), "part").select("key", (F.col("before") + inside).alias("new_rank"))
    keep = [c for c in rows.columns if c not in ("key", "rank")]
    return rows.join(rank, "key").select(*keep, F.col("new_rank").alias("rank"))


def ranked_apart(rows: DataFrame) -> DataFrame:
    """The same where no two keys are equal: keys are sorted once, and neither counted nor joined with, nor kept."""
    keep = [c for c in rows.columns if c not in ("key", "rank")]
    at = F.monotonically_increasing_id()  # the partition, and the place in it
    ordered = cut(rows.repartitionByRange("key").sortWithinPartitions("key").select(*keep, at.alias("_at")))
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    parts = ordered.groupBy("_part").agg(F.count("*").alias("n"))  # one row a partition
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("before") + F.col("_at") - F.shiftleft("_part", 33)
    return ordered.join(parts.select("_part", before.alias("before")), "_part").select(*keep, rank.alias("rank"))


def visit_order(seqs: DataFrame, longest: int | None = None) -> DataFrame:
    """``(g, off, seq_id, pos)`` of every visit; ``longest`` (visits a walk, if known) picks the way."""
    if longest is None:
        longest = seqs.agg(F.max("pos")).first()[0] or 0
    return by_prefix_arrays(seqs) if longest < LONGEST_ARRAY else by_doubling(seqs)


def with_next(order: DataFrame) -> DataFrame:
    """Each position with the next one on its walk; the end of a walk is ``(0, 0)``."""
    follow = F.lead(F.struct("g", "off")).over(W.partitionBy("seq_id").orderBy("pos"))
    return order.withColumn("next", follow).select(
        "g", "off", F.coalesce("next.g", F.lit(0)).alias("next_g"), F.coalesce("next.off", F.lit(0)).alias("next_off"), "seq_id", "pos"
    )


def record_edges(records: DataFrame) -> DataFrame:
    """``(g, edge_rank, next_g, next_off)``: the edges of each handle, and the offset where its visits begin in the next."""
    lowest = records.groupBy("g", "next_g").agg(F.min("next_off").alias("next_off"))
    rank = F.row_number().over(W.partitionBy("g").orderBy("next_g")) - 1
    return lowest.select("g", rank.cast("long").alias("edge_rank"), "next_g", "next_off")


def record_runs(records: DataFrame) -> DataFrame:
    """``(g, run_no, value, len)``: runs of equal edge ranks in the order of offsets."""
    by_off = W.partitionBy("g").orderBy("off")
    value = F.dense_rank().over(W.partitionBy("g").orderBy("next_g")) - 1
    changed = F.when(F.lag("next_g").over(by_off) == F.col("next_g"), 0).otherwise(1)
    rows = records.select("g", "off", "next_g", value.cast("long").alias("value"), changed.alias("new"))
    rows = rows.withColumn("run_no", (F.sum("new").over(by_off) - 1).cast("long"))
    return rows.groupBy("g", "run_no").agg(F.min("value").alias("value"), F.count("*").alias("len"))


def record_lengths(visit: DataFrame) -> DataFrame:
    """``(g, len)``: visits of each handle over both orientations, from forward counts."""
    n = visit.groupBy("g").agg(F.count("*").alias("n"))
    both = n.union(n.select(F.col("g").bitwiseXOR(F.lit(1)).alias("g"), "n"))
    return both.groupBy("g").agg(F.sum("n").alias("len"))


def encoded_records(records: DataFrame) -> DataFrame:
    """``(g, code)``: each handle's record in bytes: its number of edges, edges (successors as differences), runs of edge ranks."""
    from walkframe.functions.bytecode import encode_integers, encode_runs

    edges = record_edges(records).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("edge_rank", "next_g", "next_off"))).alias("e"))
    runs = record_runs(records).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("run_no", "value", "len"))).alias("r"))
    step = F.transform("e", lambda x, i: F.array(x["next_g"] - F.coalesce(F.get("e", i - 1)["next_g"], F.lit(0)), x["next_off"]))
    head = F.concat(F.array(F.size("e").cast("long")), F.flatten(step))
    both = edges.join(runs, "g").select("g", head.alias("head"), "r", F.size("e").cast("long").alias("sigma"))
    return both.select("g", F.concat(encode_integers("head"), encode_runs("r", F.col("sigma"))).alias("code"))

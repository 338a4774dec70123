"""Exact duplicates: sorted runs of digests, merged along a tree.

Each input partition is a run: its rows' digests in sorted order, equal ones as one
entry that holds the identifier to keep and the number of rows. Runs then meet in
binomial rounds: in round r all runs whose numbers agree but for their last
``r * log2(fan_in)`` bits are merged, as many steps of the binomial tree at once as the fan-in has bits.
A run is cut in ranges of digests that travel apart, so the last run isn't one
task's work: its ranges are. An entry is a digest once per run, so a text that a third of all rows
have is as many entries as there are runs, fewer in each round.

An identifier is only taken over from an entry that agrees in SHA-256, in length and in a second hash.
What the rounds have found goes back by run and digest, so rows of a frequent text stay with their run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from walkframe.session import stored

#: Runs that one round makes one of; a power of two.
FAN_IN = 8
#: Ranges of digests that a run is cut in.
RANGES = 4096
SAME = ("digest", "n_bytes", "check")
ENTRY = "range int, run long, digest binary, n_bytes long, check long, doc_id long, at long, n long"


def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries in order of range, run, digest and identifier: one of each digest, with the last identifier and all rows counted.

    At most one batch and one entry are held.
    """
    held: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        b = pa.RecordBatch.from_arrays(b.columns, b.schema.names)  # whether a column may be null doesn't matter
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        new = np.zeros(b.num_rows, dtype=bool)
        new[0] = True
        for k in ("range", "run", *SAME):
            c = b.column(k)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        out = b.take(pa.array(np.append(starts[1:], b.num_rows) - 1))
        n = pa.array(np.add.reduceat(b.column("n").to_numpy(), starts))
        out = out.set_column(out.schema.get_field_index("n"), "n", n)
        held = out.slice(out.num_rows - 1)
        yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def in_order(entries: DataFrame) -> DataFrame:
    """Merge what a partition holds of each run; the largest identifier comes last, null before any."""
    return entries.sortWithinPartitions("range", "run", *SAME, "doc_id", "at").mapInArrow(merged, ENTRY)


def digests(docs: DataFrame, normalise: Callable[[Column], Column], *more: Column) -> DataFrame:
    """``(run, at, doc_id, digest, n_bytes, check, range)`` of every row: ``at`` tells rows apart, ``run`` is the partition it was read in."""
    text = normalise(F.coalesce(F.col("text"), F.lit(""))).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), *more)
    rows = rows.select(
        F.spark_partition_id().cast("long").alias("run"), F.monotonically_increasing_id().alias("at"), "doc_id",
        F.unhex(F.sha2("_text", 256)).alias("digest"), F.octet_length("_text").cast("long").alias("n_bytes"), F.xxhash64("_text").alias("check"),
        *[c for c in rows.columns if c not in ("doc_id", "_text")],
    )
    first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return rows.withColumn("range", (first % RANGES).cast("int"))


def tree_merge(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``(digest, n_bytes, check, keep_id, keep_at, group_size)`` of each text."""
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in is a power of two, 2 or more")
    last = rows.agg(F.max("run")).first()[0] or 0
    runs = in_order(rows.select("range", "run", *SAME, "doc_id", "at", F.lit(1).cast("long").alias("n")))
    while True:
        runs = in_order(runs.withColumn("run", F.shiftright("run", fan_in.bit_length() - 1)).repartition("range", "run"))
        last //= fan_in
        if not last:
            return runs.select(*SAME, F.col("doc_id").alias("keep_id"), F.col("at").alias("keep_at"), F.col("n").alias("group_size"))


def answered(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``rows`` (as a stored table) with ``keep_id``, ``group_size`` and ``kept``."""
    several = tree_merge(rows, fan_in).where("group_size > 1")
    # to runs first, then to the rows of a run: a frequent text is never one task's work
    to_runs = rows.select("run", *SAME).distinct().join(several, list(SAME))
    alone = F.col("group_size").isNull()
    found = rows.join(to_runs, ["run", *SAME], "left")
    return found.select(
        *rows.columns,
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("at") == F.col("keep_at"))).alias("kept"),
    )


def unchanged(text: Column) -> Column:
    return text


def exact_groups(docs: DataFrame, normalise: Callable[[Column], Column] = unchanged, fan_in: int = FAN_IN) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row of ``docs``.

    Texts are equal if they are after ``normalise``; of equal texts the row with the largest ``doc_id`` stays.

    * null texts are empty, and empty texts equal each other;
    * of rows that share the largest id one stays; a null ``doc_id`` is smaller than any, and of a group without ids one row stays;
    * an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    found = answered(stored(digests(docs, normalise)), fan_in)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def exact_deduplicate(docs: DataFrame, normalise: Callable[[Column], Column] = unchanged, fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows are treated as in :func:`exact_groups`."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = answered(stored(digests(docs, normalise, row)), fan_in)
    return found.where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op13_exact_dedup(spark, sf_dir):
    from walkframe.llm.common import table

    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op13_exact_dedup": op13_exact_dedup}
ORACLE_SQL = {
    "op13_exact_dedup": """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY body)
"""
}

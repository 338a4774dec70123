"""What several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of so many rows, so that what a task makes of whole texts is held for a few rows only."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of batches sorted by ``keys``: tables that hold whole groups only, and where each group starts.

    At most one batch and one unfinished group are held at a time.
    """
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), dtype=bool)
        new[:1] = True
        for k in keys:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if len(held) > 1 and all(held[-2].column(k)[held[-2].num_rows - 1] == b.column(k)[b.num_rows - 1] for k in keys):
            continue  # still the group that was open
        t = pa.Table.from_batches(held)
        at = starts(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]), at[:-1]
        held = t.slice(at[-1]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def term_bytes(digits: bool) -> bytes:
    """For ``bytes.translate``: A to Z in lower case, letters (and digits) and all of non-ASCII characters as they are, spaces for the rest."""
    letters = range(97, 123)
    keep = {*letters, *range(128, 256), *(range(48, 58) if digits else ())}
    return bytes(b + 32 if b + 32 in letters else b if b in keep else 32 for b in range(256))


def terms_of(text: bytes, table: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, those of about ``size`` bytes at a time."""
    text, at = text.translate(table), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end

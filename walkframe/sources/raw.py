"""Plain byte files without lines or headers: words of 64 bits, single bytes, blocks of bytes.

A Python data source reads a file, or a folder of parts, in ranges of bytes, one task
a range; nothing is read to number the entries, their places follow from the sizes of
the files. It writes a folder of parts. Each row says where it belongs, so a task knows
the byte at which its part begins and names the part after it (or rows are in order, and the
commit adds up what tasks wrote): in the order of names the parts are the file. Parts are written under a name of their own for each attempt of
a task and put in place by the commit, once all are there and no byte is missing or
written twice; a lost executor's attempt leaves nothing that a reader would see.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructType

FORMAT = "walkframe_raw"
PART = re.compile(r"part-(\d{20})")
#: Bytes a task reads, and bytes in a batch of it.
SPLIT, BATCH = 32 << 20, 1 << 19


def opened(options: dict) -> tuple[fs.FileSystem, str]:
    """The file system of a place and the path in it."""
    files, root = fs.FileSystem.from_uri(options["base"])
    return files, root.rstrip("/") + options["place"]


@dataclass
class Span(InputPartition):
    file: str
    begin: int
    end: int
    #: place in the whole of the file's first byte
    before: int


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.width = int(options.get("width", 8))
        self.block = int(options.get("block", 0))
        self.skip = int(options.get("skip", 0)) * self.width

    def parts(self) -> list[tuple[str, int]]:
        """Files and their sizes, in order."""
        files, path = opened(self.options)
        info = files.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            return [(path, info.size)]
        found = sorted((x.base_name, x.path, x.size) for x in files.get_file_info(fs.FileSelector(path)) if PART.fullmatch(x.base_name))
        at = 0
        for name, _, size in found:
            if int(PART.fullmatch(name)[1]) != at:
                raise ValueError(f"{path}: bytes from {at} on are missing")
            at += size
        return [(file, size) for _, file, size in found]

    def partitions(self) -> list[Span]:
        unit = self.block or self.width
        split = max(int(self.options.get("split", SPLIT)) // unit, 1) * unit
        spans, before = [], 0
        for file, size in self.parts():
            if size % self.width:
                raise ValueError(f"{file}: {size} bytes are no whole number of entries")
            # ranges begin at whole blocks of the file as a whole, so that blocks don't depend on its parts
            at = max(self.skip - before, 0)
            while at < size:
                end = min(size, ((before + at - self.skip) // split + 1) * split + self.skip - before)
                spans.append(Span(file, at, end, before))
                at = end
            before += size
        return spans or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span.begin == span.end:
            return
        files, _ = opened(self.options)
        with files.open_input_file(span.file) as f:
            f.seek(span.begin)
            at = span.begin
            while at < span.end:
                place = span.before + at - self.skip
                # a block ends where the next one of the whole begins
                size = self.block - place % self.block if self.block else BATCH // self.width * self.width
                data = f.read(min(size, span.end - at))
                if not data:
                    raise EOFError(f"{span.file} ends before byte {span.end}")
                if self.block:
                    columns = [pa.array([place]), pa.array([data], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["at", "data"])
                else:
                    values = np.frombuffer(data, "<i8" if self.width == 8 else "u1").astype(np.int64)
                    columns = [pa.array(np.arange(len(values)) + place // self.width), pa.array(values)]
                    yield pa.RecordBatch.from_arrays(columns, ["at", "value"])
                at += len(data)


@dataclass
class Written(WriterCommitMessage):
    file: str
    begin: int
    end: int
    #: place of the task among others
    task: int


class RawWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.options = dict(options)
        #: rows are the bytes, in the order of tasks and of rows in a task
        self.in_order = "at" not in schema.names
        self.words = not isinstance(schema["data" if "data" in schema.names else "value"].dataType, BinaryType)
        self.run = uuid.uuid4().hex

    def folder(self) -> tuple[fs.FileSystem, str, str]:
        files, path = opened(self.options)
        return files, path, f"{path}/_writing-{self.run}"

    def laid_out(self, batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray, list]:
        """First and last byte of each row, and the bytes in order; ``end`` is where the rows before end."""
        if self.in_order:
            data = b"".join(batch.column("data").to_pylist())
            return np.array([end]), np.array([end + len(data)]), [data]
        at = batch.column("at").to_numpy(zero_copy_only=False)
        if self.words:
            value = batch.column("value")
            if value.null_count:
                raise ValueError("a word is null")
            return at * 8, at * 8 + 8, [value.to_numpy(zero_copy_only=False).astype("<i8").tobytes()]
        data = batch.column("data").to_pylist()
        return at, at + np.array([len(x) for x in data], np.int64), data

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, writing = self.folder()
        file, out, begin, end = f"{writing}/{uuid.uuid4().hex}", None, 0, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                first, last, pieces = self.laid_out(batch, end)
                if out is None:
                    files.create_dir(writing, recursive=True)
                    out, begin, end = files.open_output_stream(file), int(first[0]), int(first[0])
                if first[0] != end or (first[1:] != last[:-1]).any():
                    raise ValueError(f"bytes are missing or given twice after byte {end}")
                for piece in pieces:
                    out.write(piece)
                end = int(last[-1])
        finally:
            if out is not None:
                out.close()
        return Written(file, begin, end, TaskContext.get().partitionId())

    def commit(self, messages: list[Written | None]) -> None:
        files, path, writing = self.folder()
        written = sorted((m for m in messages if m is not None and m.begin < m.end), key=lambda m: m.task)
        if self.in_order:
            ends = [0, *accumulate(m.end for m in written)]
            parts, at = [(begin, end, m.file) for begin, end, m in zip(ends, ends[1:], written)], 0
        else:
            parts, at = sorted((m.begin, m.end, m.file) for m in written), 0
        for begin, end, _ in parts:
            if begin != at:
                files.delete_dir(writing)
                raise ValueError(f"bytes are missing or given twice at byte {min(begin, at)}")
            at = end
        files.create_dir(path, recursive=True)
        for old in files.get_file_info(fs.FileSelector(path)):
            if PART.fullmatch(old.base_name):
                files.delete_file(old.path)
        for begin, _, file in parts:
            files.move(file, f"{path}/part-{begin:020d}")
        if parts:
            files.delete_dir(writing)

    def abort(self, messages: list[Written | None]) -> None:
        files, _, writing = self.folder()
        if files.get_file_info(writing).type != fs.FileType.NotFound:
            files.delete_dir(writing)


class RawFiles(DataSource):
    """``(at, value)`` of words (``width`` 8) or bytes (``width`` 1), or ``(at, data)`` of ``block`` bytes each."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "at bigint, data binary" if int(self.options.get("block", 0)) else "at bigint, value bigint"

    def reader(self, schema: StructType) -> RawReader:
        return RawReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> RawWriter:
        return RawWriter(self.options, schema)


def located(spark: SparkSession, path: str) -> dict[str, str]:
    """Options that name a place: Spark's own file system for ``path``, and the path in it."""
    spark.dataSource.register(RawFiles)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    scheme = {"s3a": "s3", "s3n": "s3"}.get(uri.getScheme(), uri.getScheme())
    return {"base": f"{scheme}://{uri.getAuthority() or ''}/", "place": uri.getPath()}


def read_numbers(spark: SparkSession, path: str, width: int = 8, skip: int = 0, split: int = SPLIT) -> DataFrame:
    """``(at, value)``: little-endian words of 64 bits (``width`` 8) or bytes (``width`` 1), numbered from 0 after the first ``skip``."""
    if width not in (1, 8):
        raise ValueError("numbers are one or eight bytes wide")
    return spark.read.format(FORMAT).options(**located(spark, path), width=width, skip=skip, split=split).load()


def read_blocks(spark: SparkSession, path: str, block: int = 1 << 16, split: int = SPLIT) -> DataFrame:
    """``(at, data)``: pieces of at most ``block`` bytes, ``at`` the first byte of each.

    A piece ends at a multiple of ``block`` or at the end of a part of the file.
    """
    return spark.read.format(FORMAT).options(**located(spark, path), width=1, block=block, split=split).load()


def write_words(words: DataFrame, path: str, parts: int | None = None) -> None:
    """Write ``(at, value)``, ``at`` each number from 0 on once, as little-endian words of 64 bits; Spark picks the number of parts if none is given."""
    placed(words.select("at", F.col("value").cast("long").alias("value")), path, parts)


def write_bytes(pieces: DataFrame, path: str, parts: int | None = None) -> None:
    """Write ``(at, data)``, ``at`` the byte where a piece begins; pieces meet without gap or overlap, empty or null ones count nothing."""
    placed(pieces.select("at", F.col("data").cast("binary").alias("data")).where(F.octet_length("data") > 0), path, parts)


def placed(rows: DataFrame, path: str, parts: int | None) -> None:
    ordered = rows.repartitionByRange(*[parts] * (parts is not None), "at").sortWithinPartitions("at")
    ordered.write.format(FORMAT).options(**located(rows.sparkSession, path)).mode("overwrite").save()


def write_in_order(pieces: DataFrame, path: str, *order: str) -> None:
    """Write ``data`` of rows with ``order``, no two equal, one after the other; where a row begins follows from what was written before, so it needn't be known."""
    some = pieces.select(*order, F.col("data").cast("binary").alias("data")).where(F.octet_length("data") > 0)
    ordered = some.repartitionByRange(*order).sortWithinPartitions(*order).select("data")
    ordered.write.format(FORMAT).options(**located(pieces.sparkSession, path)).mode("overwrite").save()

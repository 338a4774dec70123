"""Byte-level BPE over whole texts, in overlapping chunks.

A pre-token is a function of the position where it starts and of the text from
there on, so two chains of pre-tokens that meet at one boundary are the same
from it on. Every text over ``CHUNK`` characters is cut in chunks that overlap;
each is pre-tokenised alone, and the boundaries that both neighbours see in
their overlap are where the chunks resynchronise. Each chunk keeps what lies
between the first such boundary of either overlap (after a non-space, so that
look-ahead at white space can't see the cut), and these pieces are encoded
independently. Where an overlap has no common boundary, its two chunks become one
piece, which is right at any length. A text's pieces come together in order
only to be decoded and hashed, one after the other.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window as W, functions as F

from walkframe.llm.common import slices

CHUNK = 1 << 12
OVERLAP = 1 << 7
#: A match that ends so near the end of a chunk may go on behind it.
MARGIN = 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def encoder(path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def pre_token() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


def boundaries(chunk: str, last: bool) -> np.ndarray:
    """Ends of pre-tokens after a non-space, those that the end of the chunk can't change."""
    ends = [m.end() for m in pre_token().finditer(chunk) if not chunk[m.end() - 1].isspace()]
    x = np.array(ends, dtype=np.int64)
    return x if last else x[x <= len(chunk) - MARGIN]


# ---------------------------------------------------------------- what tasks do

CHUNKS = "key binary, doc_id long, k int, n int, text string"
BOUNDS = "key binary, k int, lefts array<int>, rights array<int>"
ENCODED = "key binary, doc_id long, piece int, copies long, n_tokens long, ids binary"
CODED = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary()), ("decoded", pa.binary())]


def in_chunks(batches: Iterable[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunk ``k`` of the ``n`` of each text, with what overlaps the next; rows of one id and text share their key."""
    for b in batches:
        for row in slices(b, 1):
            doc, text = row.column(0)[0].as_py(), row.column(1)[0].as_py()
            key = hashlib.blake2b(f"{doc}|{text}".encode(errors="surrogatepass"), digest_size=16).digest()
            n = -(-len(text) // chunk)
            for at in range(0, n, 256):
                ks = range(at, min(n, at + 256))
                parts = [text[k * chunk : (k + 1) * chunk + overlap] for k in ks]
                columns = [pa.array([key] * len(ks), pa.binary()), pa.array([doc] * len(ks), pa.int64()), pa.array(ks, pa.int32()), pa.array([n] * len(ks), pa.int32()), pa.array(parts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "k", "n", "text"])


def overlap_boundaries(batches: Iterable[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk: the boundaries in its overlap with the chunk before, and with the chunk behind, from the overlap's start."""
    for whole in batches:
        for b in slices(whole, 256):
            lefts, rights = [], []
            for k, n, text in zip(*(b.column(c).to_pylist() for c in ("k", "n", "text"))):
                at = boundaries(text, k == n - 1)
                lefts.append(at[at <= overlap] if k else at[:0])
                rights.append(at[at >= chunk] - chunk if k < n - 1 else at[:0])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k"), pa.array(lefts, kind), pa.array(rights, kind)], ["key", "k", "lefts", "rights"])


def id_type(enc: tiktoken.Encoding) -> str:
    """What ids are exchanged as: two bytes each where the vocabulary allows it."""
    return "<u2" if enc.max_token_value < 1 << 16 else "<u4"


def encode_pieces(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Encode what lies between ``start`` and ``end`` of each row (null: the end of its text)."""
    enc = encoder(path)
    kind = id_type(enc)
    for whole in batches:
        for b in slices(whole, 256):
            of = zip(*(b.column(c).to_pylist() for c in ("text", "start", "end")))
            tokens = [np.array(enc.encode_ordinary(x[s:e]), dtype=kind) for x, s, e in of]
            columns = [pa.array([len(t) for t in tokens], pa.int64()), pa.array([zlib.compress(t.tobytes(), 1) for t in tokens], pa.binary())]
            names = ["key", "doc_id", "piece", "copies"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *columns], [*names, "n_tokens", "ids"])


def coded(rows: list[tuple], keep: bool) -> pa.RecordBatch:
    kinds = CODED if keep else CODED[:4]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def code_whole(batches: Iterable[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk: encoded, decoded and hashed where they are."""
    enc = encoder(path)
    for whole in batches:
        for b in slices(whole, 256):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                tokens = enc.encode_ordinary(text.as_py())
                ids, decoded = np.array(tokens, dtype="<u4").tobytes(), enc.decode_bytes(tokens)
                rows.append((doc, len(tokens), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids, decoded))
            yield coded(rows, keep)


def code_in_order(batches: Iterable[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by key and place: the ids of a text and the bytes that they decode to, hashed piece by piece.

    Pieces of rows that are alike come side by side; one of each is hashed, and the copies of the first tell how many rows there are.
    """
    enc = encoder(path)
    kind, key, held = id_type(enc), None, None

    def result() -> Iterator[pa.RecordBatch]:
        doc, copies, n, of_ids, of_bytes, parts, _ = held
        row = (doc, n, of_ids.hexdigest(), of_bytes.hexdigest(), b"".join(p for p, _ in parts), b"".join(d for _, d in parts))
        for at in range(0, copies, 256):
            yield coded([row] * min(256, copies - at), keep)

    for whole in batches:
        for b in slices(whole, 64):
            for new, doc, piece, copies, n, ids in zip(*(c.to_pylist() for c in b.columns)):
                if new != key:
                    if held:
                        yield from result()
                    key, held = new, [doc, 0, 0, hashlib.sha256(), hashlib.sha256(), [], -1]
                if piece == 0:
                    held[1] += copies
                if piece == held[6]:
                    continue
                ids = np.frombuffer(zlib.decompress(ids), dtype=kind).astype("<u4")
                decoded, ids = enc.decode_bytes(ids.tolist()), ids.tobytes()
                held[2] += n
                held[3].update(ids)
                held[4].update(decoded)
                held[6] = piece
                if keep:
                    held[5].append((ids, decoded))
    if held:
        yield from result()


# ---------------------------------------------------------------- the plan


def pieces_of(chunks: DataFrame, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """``(key, doc_id, piece, copies, text, start, end)`` of the chunks of long texts: pieces of one chunk, which end where it resynchronises, and joined ones."""
    seen = chunks.mapInArrow(lambda batches: overlap_boundaries(batches, chunk, overlap), BOUNDS).dropDuplicates(["key", "k"])
    order = W.partitionBy("key").orderBy("k")
    meets = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("lefts", F.lag("rights").over(order))))
    spans = (
        seen.withColumn("meets", meets)
        .select(
            "key",
            "k",
            F.coalesce("meets", F.lit(0)).alias("start"),
            # the last chunk has none behind it and ends where its text does
            (F.when(F.lead("k").over(order).isNotNull(), chunk + F.coalesce(F.lead("meets").over(order), F.lit(0)))).alias("end"),
            (F.sum(F.col("meets").isNotNull().cast("int")).over(order) - 1).cast("int").alias("piece"),
        )
        .withColumn("parts", F.count("*").over(W.partitionBy("key", "piece")))
    )
    # both sides take all columns of the chunks, so that one exchange serves both
    parts = chunks.join(spans, ["key", "k"])
    alone = parts.where("parts = 1").withColumn("copies", F.lit(1).cast("long"))
    own = F.col("text").substr(F.col("start") + 1, F.coalesce("end", F.length("text")) - F.col("start"))
    joined = (
        parts.where("parts > 1")
        .groupBy("key", "doc_id", "n", "piece", "parts")
        .agg(F.count("*").alias("rows"), F.sort_array(F.collect_set(F.struct("k", own.alias("text")))).alias("of"))
        .select("key", "doc_id", "piece", F.expr("rows div parts").alias("copies"), F.array_join(F.transform("of", lambda x: x["text"]), "").alias("text"))
        .withColumns({"start": F.lit(0), "end": F.lit(None).cast("int")})
    )
    return alone, joined


def bpe_round_trip(docs: DataFrame, vocabulary: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, keep: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row; with ``keep`` also ``ids`` and ``decoded`` bytes.

    ``ids`` are little-endian unsigned 32-bit integers. ``vocabulary`` is the path
    of a rank file in tiktoken's format. ``overlap`` is at most ``chunk``.

    * null and empty texts have no tokens, and the digests of no bytes;
    * texts over ``chunk`` characters, of any length, are chunks, each a row of its own until its ids are hashed;
    * repeated rows each come back; a null ``doc_id`` stays null;
    * an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = ", ".join(f"{name} {'long' if kind == pa.int64() else 'string' if kind == pa.string() else 'binary'}" for name, kind in (CODED if keep else CODED[:4]))
    short = rows.where(F.length("text") <= chunk).mapInArrow(lambda batches: code_whole(batches, path, keep), out)
    chunks = rows.where(F.length("text") > chunk).mapInArrow(lambda batches: in_chunks(batches, chunk, overlap), CHUNKS)
    # the join with the cuts asks for these; asked here, both uses of the exchange are alike, and it is made once
    chunks = chunks.where("key is not null and k is not null").repartition("key", "k")
    alone, joined = (x.mapInArrow(lambda batches: encode_pieces(batches, path), ENCODED) for x in pieces_of(chunks, chunk, overlap))
    encoded = alone.union(joined)
    long = encoded.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(lambda batches: code_in_order(batches, path, keep), out)
    return short.union(long)


def op6_byte_bpe(spark, sf_dir):
    from walkframe.llm.common import table

    return bpe_round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLE_SQL: dict[str, str] = {}

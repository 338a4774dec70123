"""Quality: nearest-neighbour voting among labelled documents in a latent-semantic space.

A document is a histogram of byte pairs and of triples of character classes, so
that form counts in any language. Histograms are damped, weighted by inverse
document frequency and projected on the leading singular directions of a bounded
sample of labelled training documents. That sample's vectors are sent to every
task; each document is compared with all of them, in blocks of exact cosine
products, and its nearest neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from walkframe.llm.toxicity import bounded_sample

#: Training reads at most so many labelled documents of each label.
SAMPLE = 1200
DIMENSIONS = 64
NEIGHBOURS = 15
#: Documents compared with the labelled vectors at a time.
BLOCK = 256
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
PAIRS = 2048
CLASSES = 16


def byte_classes() -> np.ndarray:
    """A class for each byte: letters by case, digits, space, line ends, frequent marks, other marks, beyond ASCII."""
    of = np.full(256, 15, dtype=np.int32)
    of[:128] = 14
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"'\"", b"-_", b"!?", b":;", b"()[]{}<>", b"|/\\", b"@#$%&*+=~^`")):
        of[list(chars)] = k
    return of


CLASS_OF = byte_classes()
#: Shares of words that repeat the one before, and of words that occur before, by which documents are told apart.
REPEATED = (0.01, 0.05, 0.15, 0.3, 0.5)
KNOWN = (0.5, 0.7, 0.8, 0.9, 0.97)
FORM = CLASSES**3 + PAIRS
FEATURES = FORM + len(REPEATED) + len(KNOWN) + 2


def histogram(text: bytes) -> np.ndarray:
    """Counts of class triples and hashed byte pairs of one whole text, damped by the logarithm, and how much it repeats."""
    x = np.frombuffer(text, dtype=np.uint8)
    out = np.zeros(FEATURES, dtype=np.float32)
    for at in range(0, len(x), 1 << 20):  # blocks that overlap by two bytes: bounded memory at any length
        part = x[at : at + (1 << 20) + 2].astype(np.int32)
        c = CLASS_OF[part]
        if len(c) > 2:
            out[: CLASSES**3] += np.bincount((c[:-2] << 8) | (c[1:-1] << 4) | c[2:], minlength=CLASSES**3)
        if len(part) > 1:
            out[CLASSES**3 : FORM] += np.bincount(((part[:-1] * 257 + part[1:]) * 40503 >> 4) % PAIRS, minlength=PAIRS)
    np.log1p(out, out=out)
    words = text.split()
    if words:
        strong = 0.5 * float(np.linalg.norm(out[:FORM]))
        again = max(0, sum(map(eq, words, words[1:])) - 2) / len(words)  # two are chance
        out[FORM + bisect_right(REPEATED, again)] = strong
        if len(words) >= 50:  # in short texts few words occur twice anyway
            out[FORM + len(REPEATED) + 1 + bisect_right(KNOWN, 1 - len(set(words)) / len(words))] = strong / 2
    return out


@dataclass(frozen=True)
class Voter:
    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    base: float


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def embed(counts: np.ndarray, idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return unit(unit(counts * idf) @ directions)


def fit(sample: list[tuple[bytes, int]], dimensions: int = DIMENSIONS) -> Voter:
    if not sample:
        return Voter(np.ones(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    counts = np.stack([histogram(text) for text, _ in sample])
    y = np.array([label for _, label in sample], dtype=np.float32)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x = unit(counts * idf)
    # randomised truncated SVD with a fixed start; the sign of a direction doesn't matter to cosines
    k = min(dimensions, *x.shape)
    q = x.T @ np.random.default_rng(7).standard_normal((len(x), min(k + 10, len(x)))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    directions = np.ascontiguousarray((q @ v.T)[:, :k], dtype=np.float32)
    return Voter(idf, directions, embed(counts, idf, directions), y, float(y.mean()))


def vote(voter: Voter, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores 0 to 1 of a block of histograms: the share of label 1 among the nearest, by weights that grow with similarity.

    Of equal cosines (to six places) the smaller ``doc_id`` is nearer. A text without features has the base rate.
    """
    if not len(voter.votes):
        return np.full(len(counts), voter.base)
    where = embed(counts, voter.idf, voter.directions).astype(np.float64)
    cosine = np.round(where @ voter.vectors.astype(np.float64).T, 6)
    k = min(neighbours, cosine.shape[1])
    last = np.partition(cosine, -k, axis=1)[:, -k, None]
    nearer, level = cosine > last, cosine == last
    chosen = nearer | level & (np.cumsum(level, axis=1) <= k - nearer.sum(1, keepdims=True))  # labelled vectors are in the order of doc_id
    weight = np.exp(12 * (cosine - cosine.max(1, keepdims=True))) * chosen
    share = (weight @ voter.votes.astype(np.float64)) / weight.sum(1)
    return np.where(where.any(1), np.clip(share, 0, 1), voter.base)


def quality_scores(docs: DataFrame, voter: Voter) -> DataFrame:
    """``(doc_id, score)`` of every row, whole texts.

    * null and empty texts, and those of one byte, have no direction: their score is the share of label 1 in the sample;
    * repeated rows each come back, with one score; a null ``doc_id`` stays null;
    * an empty table gives an empty result; other columns are ignored, whatever their names.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                counts = np.stack([histogram(x.as_py() or b"") for x in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vote(voter, counts), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Voter:
    """Fit on at most ``sample`` labelled documents of each label that aren't held out (a bounded read to the driver)."""
    rows = bounded_sample(docs, labels, "quality", FOLDS, HELD_OUT, True, sample).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([((r.text or "").encode(), r.y) for r in rows])


def op9_quality(spark, sf_dir):
    from walkframe.llm.common import table

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op9_quality": op9_quality}
ORACLE_SQL: dict[str, str] = {}

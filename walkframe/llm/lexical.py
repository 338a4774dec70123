"""Ranked lexical search on a bit-sliced index of impacts.

What a term adds to a document's score, its impact, is a whole number. Documents are held in
blocks; of a block, bit s of a term's impacts is a bitmap over the documents. All scores of a
block are added at once by carry arithmetic on bitmaps (a full adder is five bitwise
operations on 64 documents a word), for many items side by side, and stay in slices: the best
documents are found from the most significant slice down, keeping the set of those
surely among the best and the set of those still equal to the last. Only their scores are read from the slices.

Items come in batches whose terms have a bounded size, so that every task holds a batch; each batch
is one pass over all texts, and what it finds of its terms is a stored index with a row a document. Blocks need no exchange: a
task takes documents as it reads them, and hands on the best of all its blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from walkframe.llm.common import slices, term_bytes, terms_of
from walkframe.session import stored

K = 50
#: Documents of a block, bytes of the terms of a batch of items, terms whose slices are held at once, items added side by side.
BLOCK = 8192
BATCH = 1 << 23
HELD = 1024
ITEMS = 64
#: Parts in which an item's candidates are ranked before they meet.
PARTS = 64
WORDS = term_bytes(digits=True)
RESULT = "item_id long, rank int, doc_id long, score long"


def terms_of_items(items: DataFrame) -> DataFrame:
    """``(item_id, terms)``: the distinct terms of each item, in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({t for some in terms_of(text or b"", WORDS) for t in some}) for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "item_id long, terms array<binary>")


def postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of each row with a term: its terms counted, and those that have a number, with their occurrences."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 256):
                ids, ns, ends, terms, tfs = [], [], [0], [], []
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    count: Counter = Counter()
                    for some in terms_of(text or b"", WORDS):
                        count.update(some)
                    if not count:
                        continue
                    found = count.keys() & number.keys()
                    ids.append(doc_id)
                    ns.append(count.total())
                    terms += [number[t] for t in found]
                    tfs += [count[t] for t in found]
                    ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def bit_slices(term: np.ndarray, at: np.ndarray, impact: np.ndarray, terms: int, words: int, bits: int) -> np.ndarray:
    """``[bit, term, word]``: bitmaps over documents of each bit of the impacts; the row behind the last term is empty."""
    out = np.zeros((bits, terms + 1, words), dtype="<u8")
    dense = np.zeros((terms, words * 64), dtype=bool)
    for s in range(bits):
        dense[term, at] = (impact >> s) & 1
        out[s, :terms] = np.packbits(dense, axis=1, bitorder="little").view("<u8")
    return out


def add(total: np.ndarray, one: np.ndarray, rows: np.ndarray) -> None:
    """Add to ``total[bit, item, word]`` the slices ``one[bit, rows[item], word]``."""
    carry = np.zeros(total.shape[1:], dtype="<u8")
    for s in range(len(total)):
        a = total[s]
        if s < len(one):
            b = one[s][rows]
            half = a ^ b
            total[s], carry = half ^ carry, (a & b) | (half & carry)
        elif carry.any():
            total[s], carry = a ^ carry, a & carry
        else:
            break


def best_of_slices(total: np.ndarray, k: int) -> np.ndarray:
    """``[item, document]``: which are the ``k`` highest sums over 0; equal ones in the order of documents."""
    count = lambda bits: np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    sure, equal = np.zeros(total.shape[1:], dtype="<u8"), np.bitwise_or.reduce(total, axis=0)
    for one in total[::-1]:
        higher = sure | (equal & one)
        many = (count(higher) > k)[:, None]
        sure, equal = np.where(many, sure, higher), np.where(many, equal & one, equal & ~one)
    flags = lambda bits: np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").view(bool)
    last = flags(equal)
    return flags(sure) | (last & (np.cumsum(last, axis=1, dtype=np.int32) <= (k - count(sure))[:, None]))


def best_of_block(doc: np.ndarray, impacts: tuple[np.ndarray, np.ndarray, np.ndarray], items: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(item, place, score)`` of the best of a block whose documents are in order; ``impacts`` has term, place and impact of its postings, by term."""
    term, place, impact = impacts
    words = -(-len(doc) // 64)
    here = np.unique(term)
    for first in range(0, len(items), ITEMS):
        asked = [np.intersect1d(x, here, assume_unique=True) for x in items[first : first + ITEMS]]
        union = np.unique(np.concatenate(asked))
        if not len(union):
            continue
        own = np.isin(term, union)
        t, at, what = np.searchsorted(union, term[own]), place[own], impact[own]
        total = np.zeros((int(int(what.max()) * max(map(len, asked))).bit_length(), len(asked), words), dtype="<u8")
        for low in range(0, len(union), HELD):
            n = min(HELD, len(union) - low)
            span = slice(*np.searchsorted(t, [low, low + n]))
            one = bit_slices(t[span] - low, at[span], what[span], n, words, int(what[span].max()).bit_length())
            rows = [np.searchsorted(union, x) - low for x in asked]
            rows = [x[(x >= 0) & (x < n)] for x in rows]
            for j in range(max(map(len, rows))):
                add(total, one, np.array([x[j] if j < len(x) else n for x in rows]))
        item, at = np.nonzero(best_of_slices(total, k))
        score = np.zeros(len(item), dtype=np.int64)
        for s, bits in enumerate(total):
            score |= (((bits[item, at >> 6] >> (at & 63).astype("<u8")) & np.uint64(1)) << np.uint64(s)).astype(np.int64)
        yield item + first, at, score


def best(item: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the ``k`` highest of their item: by score, then by ``doc_id``, null last."""
    order = np.lexsort((doc, null, -score, item))
    starts = np.flatnonzero(np.diff(item[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order)))) < k]


def search(index: DataFrame, items: list[np.ndarray], ids: list[int | None], weight: np.ndarray, n_docs: int, length: int, k: int, block: int) -> DataFrame:
    """``(number, item_id, doc_id, score)``: the best that each task finds; ``number`` tells items apart."""

    def impacts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        null = rows.column("doc_id").is_null().to_numpy()
        doc = rows.column("doc_id").fill_null(0).to_numpy()
        order = np.lexsort((doc, null))
        place = np.empty(len(doc), dtype=np.int64)
        place[order] = np.arange(len(doc))
        # whole numbers of any size, in Python
        m = np.array([100 - 50 + 50 * n * n_docs // length for n in rows.column("n").to_pylist()], dtype=np.int64)
        lists = rows.column("terms").combine_chunks()
        of = np.repeat(np.arange(len(doc)), lists.value_lengths().to_numpy())
        term = lists.flatten().to_numpy()
        tf = rows.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[of]))
        some = np.flatnonzero(impact)
        some = some[np.argsort(term[some], kind="stable")]
        return doc[order], null[order], (term[some], place[of[some]], impact[some])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)]
        for rows in blocks(batches, block):
            doc, null, posted = impacts(rows)
            new = [(item, score, null[at], doc[at]) for item, at, score in best_of_block(doc, posted, items, k)]
            found = [np.concatenate([x, *[n[i] for n in new]]) for i, x in enumerate(found)]
            keep = best(*found, k)
            found = [x[keep] for x in found]
        item, score, null, doc = found
        yield pa.RecordBatch.from_pydict(
            {"number": pa.array(item, pa.int64()), "item_id": pa.array([ids[i] for i in item], pa.int64()), "doc_id": pa.array(doc, pa.int64(), mask=null), "score": pa.array(score, pa.int64())}
        )

    return index.mapInArrow(run, "number long, item_id long, doc_id long, score long")


def blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same rows, so many at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            b = b.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` rows of ``docs`` with the highest scores over 0 for each row of ``items``.

    * null and empty texts have no terms: such documents aren't found and don't count, such items find nothing;
    * equal scores go by ``doc_id``, null last; rows that share an id count and rank each;
    * rows of ``items`` that share an id or text are items of their own; a null ``item_id`` is returned as it is;
    * an empty table gives an empty result; other columns are ignored, whatever their names.

    A batch holds about ``batch`` bytes of terms, an item whole.
    """
    spark = docs.sparkSession
    asked = stored(terms_of_items(items))
    size = asked.select(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.length(t) + 8))).first()[0] or 0
    n = -(-size // batch)
    part = F.pmod(F.xxhash64("item_id", "terms"), F.lit(max(n, 1)))
    found = [search_batch(spark, docs, asked.where(part == i), k, block) for i in range(n)]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], RESULT)


def search_batch(spark: SparkSession, docs: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame:
    rows = sorted(asked.collect(), key=lambda r: (r.item_id is None, r.item_id, r.terms))  # bounded: a batch
    number = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r.terms}))}
    items = [np.array([number[bytes(t)] for t in r.terms], dtype=np.int64) for r in rows]
    index = stored(postings(docs, number))
    n_docs, length = index.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return spark.createDataFrame([], RESULT)
    weight = np.zeros(len(number), dtype=np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a row a term of the batch
        weight[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    best_of_tasks = search(index, items, [r.item_id for r in rows], weight, n_docs, length, k, block)
    by_score = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    cut = best_of_tasks.withColumn("part", F.spark_partition_id() % PARTS)
    cut = cut.withColumn("rank", F.row_number().over(W.partitionBy("number", "part").orderBy(*by_score))).where(F.col("rank") <= k)
    last = cut.withColumn("rank", F.row_number().over(W.partitionBy("number").orderBy(*by_score))).where(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark, sf_dir):
    from walkframe.llm.common import table

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_ranked_search": op12_ranked_search}
TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {
    "op12_ranked_search": f"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWER}, {TERM})) AS term FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, {TERM})) AS term FROM benchmark
), sizes AS (
  SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id
), totals AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS length FROM sizes
), posted AS (
  SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM posted GROUP BY term), totals
), impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // length)))) AS impact
  FROM posted JOIN sizes USING (doc_id) JOIN weights USING (term), totals
), scores AS (
  SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id HAVING sum(impact) > 0
), ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scores
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
}

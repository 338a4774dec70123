"""Embeddings: exact near-duplicates by cosine, and exact top-k by integer inner product.

Both compare blocks of vectors in a rotated basis, in which the leading
dimensions hold most of the length. Products of the leading dimensions come
first; what the others can still add is at most the product of the lengths that
are left in them (Cauchy-Schwarz), so most pairs end there. The basis comes from
a bounded sample: any basis gives exact results, a good one prunes more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from walkframe.operators.components import connected_components, roots
from walkframe.session import cut

#: Vectors that the basis is fitted on, at most.
SAMPLE = 4096
LEADING = 16
#: Above this share of pairs left, a tile is completed by one matrix product.
DENSE = 0.02


def valid(embedding: Column) -> Column:
    """Neither null nor empty, all components finite."""
    x = F.lit(float("inf"))
    return F.coalesce(F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < x)) & (F.size(embedding) > 0), F.lit(False))


def by_size(vectors: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of ``f`` for the vectors of each size, together; only vectors of one size compare."""
    # a row a size: as many as there are embedding models
    sizes = [r.d for r in vectors.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]
    return reduce(DataFrame.union, [f(vectors.where(F.size("embedding") == d)) for d in sizes or [-1]])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def basis(vectors: DataFrame, prepare) -> np.ndarray:
    """Right singular vectors of a sample of at most ``SAMPLE`` vectors, by falling singular value."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    if not rows.num_rows:
        return np.eye(1)
    x = prepare(matrix(rows.column(0)))
    _, v = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(v[:, ::-1])


def in_blocks(vectors: DataFrame, by: list[Column], block: int) -> DataFrame:
    """``vectors`` with the number of its block: ``block`` rows each, in the order of ``by``."""
    n = vectors.count()
    parts = max(1, -(-n // (4 * block)))
    ordered = cut(vectors.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    # a row of two numbers for each partition, of which there is one for each 4 * block rows
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start")
    starts = sizes.select("part", before)
    return (
        ordered.withColumn("part", part)
        .join(F.broadcast(starts), "part")
        .withColumn("block", F.floor((F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)) / block))
        .drop("place", "part", "start")
    )


def candidates(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) whose product may reach ``least`` (of the row of a), both in the rotated basis."""
    k = min(LEADING, a.shape[1])
    rest = lambda x, d: np.sqrt(np.maximum(0.0, (x[:, d:] ** 2).sum(1)))
    got = a[:, :k] @ b[:, :k].T
    bound = np.outer(rest(a, k), rest(b, k))
    bound += got
    i, j = np.nonzero(bound >= least[:, None])
    while k < a.shape[1] and len(i):
        if len(i) > DENSE * got.size:
            got += a[:, k:] @ b[:, k:].T
            return np.nonzero(got >= least[:, None])
        to = min(2 * k, a.shape[1])
        part = got[i, j] + np.einsum("ij,ij->i", a[i, k:to], b[j, k:to])
        got[i, j] = part
        keep = part + rest(a, to)[i] * rest(b, to)[j] >= least[i]
        i, j, k = i[keep], j[keep], to
    return i, j


# ---------------------------------------------------------------- near-duplicates

THRESHOLD = 0.9
BLOCK = 4096
#: Leading directions in which the boxes of blocks are compared, and those whose cells order the rows.
BOX, CELLS = 8, 4
TILE = 256


def linked_pairs(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, threshold: float):
    """Yield index arrays (rows of a, rows of b) of pairs with cosine >= threshold, tile by tile."""
    ua, ub = unit(a) @ rotation, unit(b) @ rotation
    for at in range(0, len(a), TILE):
        i, j = candidates(ua[at : at + TILE], ub, np.full(len(ua[at : at + TILE]), threshold - 1e-9))
        i = i + at
        # decided on the vectors as they are, in double precision
        dot = np.einsum("ij,ij->i", a[i], b[j])
        cosine = dot / (np.linalg.norm(a[i], axis=1) * np.linalg.norm(b[j], axis=1))
        odd = ~np.isfinite(cosine) | (dot == 0)
        if odd.any():
            cosine[odd] = np.einsum("ij,ij->i", unit(a[i[odd]]), unit(b[j[odd]]))
        ok = cosine >= threshold
        yield i[ok], j[ok]


def compare_blocks(rotation: np.ndarray, threshold: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of each vector with links: how many vectors it links with here, and one that it is connected with."""
        empty = pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "parent": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        same = left.column("i")[0].as_py() == left.column("j")[0].as_py()
        a, b = matrix(left.column("embedding")), matrix(right.column("embedding"))
        ids = np.concatenate([left.column("rep").to_numpy(), right.column("rep").to_numpy()])
        weight = np.concatenate([left.column("n").to_numpy(), right.column("n").to_numpy()])
        links = np.zeros(len(ids), dtype=np.int64)
        label = np.arange(len(ids))
        touched = np.zeros(len(ids), dtype=bool)
        for i, j in linked_pairs(a, b, rotation, threshold):
            if same:  # both sides are one block in one order, so every pair is seen twice
                off = i != j
                i, j = i[off], j[off]
                links[: len(a)] += np.bincount(i, weight[j], len(a)).astype(np.int64)
            else:
                links[: len(a)] += np.bincount(i, weight[j + len(a)], len(a)).astype(np.int64)
                links[len(a) :] += np.bincount(j, weight[i], len(b)).astype(np.int64)
                j = j + len(a)
            touched[i] = touched[j] = True
            label = roots(len(ids), np.concatenate([i, np.arange(len(ids))]), np.concatenate([j, label]))
        at = np.flatnonzero(touched)
        return pa.table({"rep": ids[at], "links": links[at], "parent": ids[label[at]]})

    def ordered(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left.sort_by("rep"), right.sort_by("rep"))

    return ordered


def cosine_components(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``embeddings``.

    Rows link when the cosine of their vectors is ``threshold`` or more, in double precision.

    * vectors that are null, empty, zero, or hold null or non-finite components link
      with nothing; so do rows without ``vec_id``; others link with vectors of their size;
    * equal vectors are one class: it is compared once, and its rows count each other;
    * repeated rows are rows; an empty table gives an empty result; other columns are ignored.

    Classes are dealt into blocks in the order of their cells in the leading principal
    directions. Near vectors are ``sqrt(2 - 2 * threshold)`` apart at most, so two blocks
    are compared only if the boxes around them in those directions come so near; blocks that
    may are found through the cells of the first direction. Each pair of blocks is one
    task's work, which reports counts and a spanning set of links, never pairs.
    """
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & valid(F.col("embedding")) & F.exists("embedding", lambda v: v != 0)
    )
    classes = cut(usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    label = by_size(classes, lambda c: class_labels(c, threshold, block))
    everything = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kind = F.when(F.col("vec_id").isNotNull(), F.col("embedding"))  # rows without an id match no class
    named = everything.withColumn("key", kind).join(label.withColumnRenamed("embedding", "key"), "key", "left")
    return named.select(
        "vec_id",
        F.coalesce("class_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("class_component", "vec_id"), F.lit(False)).alias("kept"),
    )


def class_labels(classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """``(embedding, class_links, class_component)`` of classes ``(embedding, rep, n)`` of one size."""
    rotation = basis(classes.withColumnRenamed("rep", "vec_id"), unit)
    leading = np.ascontiguousarray(rotation[:, :BOX])
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-6

    def along(batches):
        for b in batches:
            x = unit(matrix(b.column("embedding"))) @ leading
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(x), pa.list_(pa.float64()))], [*b.schema.names, "x"])

    schema = T.StructType([*classes.schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))])
    directions = range(leading.shape[1])
    x = [F.col("x")[d] for d in directions]
    blocks = in_blocks(classes.mapInArrow(along, schema), [*(F.floor(v / width) for v in x[:CELLS]), x[0], F.col("rep")], block)
    spans = cut(blocks.groupBy("block").agg(*(f(v).alias(f"{name}{d}") for d, v in zip(directions, x) for name, f in (("lo", F.min), ("hi", F.max)))))
    cells = lambda more: F.explode(F.sequence(F.floor(F.col("lo0") / width) - more, F.floor(F.col("hi0") / width) + more)).alias("cell")
    side = lambda name, more: spans.select(F.col("block").alias(name), cells(more), *(F.col(f"{e}{d}").alias(f"{name}_{e}{d}") for d in directions for e in ("lo", "hi")))
    gap = lambda d: F.greatest(F.lit(0.0), F.col(f"j_lo{d}") - F.col(f"i_hi{d}"), F.col(f"i_lo{d}") - F.col(f"j_hi{d}"))
    apart = reduce(lambda a, b: a + b, (gap(d) * gap(d) for d in directions))
    meet = cut(side("i", 0).join(side("j", 1), "cell").where((F.col("i") <= F.col("j")) & (apart <= width * width)).select("i", "j").distinct())
    rows = blocks.select("block", "rep", "n", "embedding")
    left = meet.join(rows.withColumnRenamed("block", "i"), "i")
    right = meet.join(rows.withColumnRenamed("block", "j"), "j")
    right = right.select(*[F.col(c).alias(f"to_{c}" if c in "ij" else c) for c in right.columns])  # attributes of its own
    found = cut(
        left.groupBy("i", "j").cogroup(right.groupBy("to_i", "to_j")).applyInArrow(compare_blocks(rotation, threshold), "rep long, links long, parent long")
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    cc = connected_components(found, "rep", "parent").withColumnRenamed("node", "rep")
    return (
        classes.join(links, "rep", "left")
        .join(cc, "rep", "left")
        .select(
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("class_links"),
            F.coalesce("component", "rep").alias("class_component"),
        )
    )


def op7_embedding_near_dedup(spark, sf_dir):
    from walkframe.llm.common import table

    return cosine_components(table(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- exact top-k

TOP = 10
QUERY_BLOCK = 1 << 13
GROUP = 1 << 11
#: The longest vectors, compared first to give every query a score to beat.
HEAD = 4096
SCALE = 1024


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as 64-bit integers; an error where one doesn't fit."""
    product = np.einsum("ij,ij->i", q, c)
    size = np.einsum("ij,ij->i", np.abs(q), np.abs(c))
    out = np.where(size < 2.0**53, product, 0).astype(np.int64)
    for i in np.flatnonzero(~(size < 2.0**53)):  # sums of doubles aren't exact there
        score = sum(int(a) * int(b) for a, b in zip(q[i], c[i]))
        if not -(1 << 63) <= score < 1 << 63:
            raise OverflowError(f"the inner product {score} has more than 64 bits")
        out[i] = score
    return out


def best_of(ids: np.ndarray, query: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Of rows (query, id, score): those among the k best of their query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    start = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - start < k]


def top_of_group(rotation: np.ndarray, k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ("query_id", "vec_id", "score")
        if not queries.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        q, c = quantised(matrix(queries.column("embedding"))), quantised(matrix(rows.column("embedding")))
        qid, cid = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
        long_first = np.argsort(-(c**2).sum(1), kind="stable")
        c, cid = c[long_first], cid[long_first]
        rq, rc = q @ rotation, c @ rotation
        lq, lc = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
        beat = queries.column("beat").to_numpy().astype(np.float64)
        out: list[list[np.ndarray]] = [[], [], []]
        for at in range(0, len(q), TILE):
            tile = slice(at, at + TILE)
            least, held = beat[tile].copy(), None
            for to in range(0, len(c), 1024):
                part = slice(to, to + 1024)
                slack = 1e-9 * lq[tile] * lc[to]
                go = np.flatnonzero(lq[tile] * lc[to] >= least - slack)  # the longest vector of what is left
                if not len(go):
                    break
                i, j = candidates(rq[tile][go], rc[part], (least - slack - 0.5)[go])
                i, j = go[i], j + to
                other = qid[tile][i] != cid[j]
                i, j = i[other], j[other]
                score = exact_scores(q[tile][i], c[j])
                new = [i, cid[j], score]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
                keep = best_of(held[1], held[0], held[2], k)
                held = [x[keep] for x in held]
                n = np.bincount(held[0], minlength=len(least))
                last = np.full(len(least), -np.inf)
                full = np.flatnonzero(n >= k)
                if len(full):
                    last[full] = held[2][np.searchsorted(held[0], full, side="right") - 1]
                least = np.maximum(least, last)
            if held is not None:
                for o, x in zip(out, (qid[tile][held[0]], held[1], held[2])):
                    o.append(x)
        return pa.table({n: np.concatenate(o) if o else pa.array([], pa.int64()) for n, o in zip(names, out)})

    return run


def top_inner_products(embeddings: DataFrame, every: int = 100, k: int = TOP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows for every row whose ``vec_id`` divides by ``every``.

    The score is the inner product of ``floor(1024 * x)``, exact; one beyond 64 bits raises an error. Ties
    go to the smaller ``vec_id``.

    * vectors that are null, empty, or hold null or non-finite components take no part,
      nor do rows without ``vec_id``; zero vectors do;
    * a row is compared with all others of its vector's size but those of its own ``vec_id``;
    * repeated rows are rows; an empty table gives an empty result; other columns are ignored.

    Rows are dealt into groups of falling length. Each query starts from the k-th best score among
    the longest vectors (a bounded head that every task gets); that score by the query's length is the least
    length a row must have to better it. Queries are dealt into blocks by that least length, and a block meets
    only groups that reach its smallest: others are never sent. What meets ends at a bound of lengths or of partial products.
    """
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    return by_size(cut(usable), lambda v: top_of_size(v, every, k))


def top_of_size(usable: DataFrame, every: int, k: int) -> DataFrame:
    """``top_inner_products`` of usable vectors of one size."""
    rotation = basis(usable, quantised)
    length = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + F.floor(v.cast("double") * SCALE).cast("double") ** 2)
    sized = usable.withColumn("length", length)
    head = sized.orderBy(F.col("length").desc(), "vec_id").limit(HEAD).select("vec_id", "embedding").toArrow()
    head_ids, head_rows = head.column(0).to_numpy(), quantised(matrix(head.column(1))) if head.num_rows else np.zeros((0, 1))

    def with_beat(batches):
        for b in batches:
            q, ids = quantised(matrix(b.column("embedding"))), b.column("vec_id").to_numpy()
            length_of = np.linalg.norm(q, axis=1)
            beat = np.full(len(q), -np.inf)
            for at in range(0, len(q), TILE):
                score = q[at : at + TILE] @ head_rows.T
                score[ids[at : at + TILE, None] == head_ids[None, :]] = -np.inf
                if score.shape[1] >= k:
                    beat[at : at + TILE] = np.partition(score, -k, axis=1)[:, -k]
            least = np.divide(beat, length_of, out=np.full(len(q), -np.inf), where=length_of > 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(beat), pa.array(np.maximum(least, 0.0))], [*b.schema.names, "beat", "least"])

    queries = usable.where(F.col("vec_id") % every == 0)
    schema = T.StructType([*queries.schema.fields, T.StructField("beat", T.DoubleType()), T.StructField("least", T.DoubleType())])
    queries = in_blocks(queries.mapInArrow(with_beat, schema), [F.col("least"), F.col("vec_id")], QUERY_BLOCK).withColumnRenamed("block", "q")
    groups = in_blocks(sized, [F.col("length").desc(), F.col("vec_id")], GROUP).withColumnRenamed("block", "g")
    # blocks and groups, a row each, meet through classes of length an eighth of a power of two wide
    class_of = lambda x: F.floor(8 * F.log2(F.greatest(x, F.lit(1.0))))
    need = queries.groupBy("q").agg(F.min("least").alias("least")).withColumn("class", class_of(F.col("least")))
    have = groups.groupBy("g").agg(F.sqrt(F.max("length")).alias("longest"))
    have = have.withColumn("class", F.explode(F.sequence(F.lit(0).cast("long"), class_of(F.col("longest")) + 1)))
    meet = cut(need.join(have, "class").where(F.col("least") * (1 - 1e-9) <= F.col("longest")).select("q", "g"))
    left = queries.drop("least").join(meet, "q")
    right = groups.drop("length").join(meet.select(F.col("q").alias("to_q"), F.col("g").alias("to_g")), F.col("g") == F.col("to_g")).drop("g")
    found = left.groupBy("q", "g").cogroup(right.groupBy("to_q", "to_g")).applyInArrow(top_of_group(rotation, k), "query_id long, vec_id long, score long")

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark, sf_dir):
    from walkframe.llm.common import table

    return top_inner_products(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_embedding_near_dedup": op7_embedding_near_dedup, "op8_exact_top_k": op8_exact_top_k}
ORACLE_SQL = {
    "op7_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
""",
    "op8_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
}

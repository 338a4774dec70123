"""Mixing sources to target weights, with DataFrame functions only.

Efraimidis-Spirakis sampling: a document draws ``u ** (1 / quality)`` from a keyed
uniform ``u`` and its quality weight; within its source, larger draws come first.
A source's token budget is spent on complete epochs first; what is left goes to
the documents in that order, up to the prefix sum that meets the budget, so the
document on the boundary gives its first words only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from walkframe.session import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """0.05 to 1: the share of letters among what isn't white space."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    solid = F.length(F.regexp_replace(text, SPACE, ""))
    return F.when(solid > 0, 0.05 + 0.95 * letters / solid).otherwise(0.05)


def draw(doc_id: Column, quality: Column, seed: str) -> Column:
    """The document's key, between 0 and 1."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10)
    return F.pow((h.cast("long") + 1) / F.lit(float(1 << 48)), 1.0 / quality)


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Of ``(source, source_size)``: also ``target``, by weights that repeat in the order of sources, null last.

    All sizes times ``share`` are dealt by weight; no target passes ``repeats`` times
    its source, and what is above goes to the others by weight. In the order of
    ``cap / weight`` the capped sources come first, so one pass of running sums finds
    the level of the rest. The table has one row a source.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * repeats).cast("double")
    ordered = W.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    level = (
        sources.withColumn("weight", w.cast("double"))
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(ordered.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything) * share)
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap"))
    return level.select("source", "source_size", target.alias("target"))


def digest_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def planned(docs: DataFrame, more: list[Column], weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` of every row, and ``more``.

    Rows are dealt to ranges of (source, draw), whose bounds Spark samples so that ranges are
    about even at any size and for any source; a range's own sums and the sums of the ranges before it are all prefix sums need.
    """
    q = quality_of(F.col("text"))
    sized = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), draw(F.col("doc_id"), q, seed).alias("draw"), *more))
    order = [F.col("source"), F.col("draw").desc(), F.col("doc_id"), F.col("size")]
    ranged = cut(sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    # a row for each range and source: as many as there are partitions and sources
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("part_before", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    goal = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, repeats)
    p, g = parts.alias("p"), goal.alias("g")
    known = p.join(g, F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.source", "part", "part_before", "source_size", "target")
    s, k = ranged.alias("s"), known.alias("k")
    inside = W.partitionBy("s.source", "s.part").orderBy(F.col("draw").desc(), "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before")
    extra = [c for c in sized.columns if c not in ("doc_id", "source", "size", "draw")]
    return (
        s.join(k, F.col("s.source").eqNullSafe(F.col("k.source")) & (F.col("s.part") == F.col("k.part")))
        .withColumn("before", F.col("part_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("budget", budget)
        .withColumn("epochs", epochs)
        .select(
            "doc_id", "s.source", "size", "source_size", "target",
            (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))).cast("long").alias("taken"), *extra,
        )
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` of every row of ``docs``.

    ``taken`` counts the words that the mix takes of the row, repeats included.

    * null and empty texts have size 0 and give nothing; a null source is a source, the last;
    * ties of the draw go by ``doc_id`` and size; repeated rows each count and are taken in turn;
    * an empty table gives an empty result; other columns are ignored, whatever their names;
    * no row is gathered by source: prefix sums run over ranges of draws.
    """
    return planned(docs, [], **options)


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its n-th word, as it is written."""
    # zipped, so that the text is searched once, however many words it has
    words, spaces = F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, n), F.slice(F.split(text, WORD), 1, n)
    return F.array_join(F.zip_with(spaces, words, lambda space, word: F.concat(space, F.coalesce(word, F.lit("")))), "")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows that a mix of ``docs`` consists of, with the columns of ``docs``.

    A row comes as often as the mix takes it; the last time its text may be cut behind the last
    word that the budget still takes (``n_chars``, if there, follows the text).

    * rows without words aren't taken; a null source or ``doc_id`` is a value like any other;
    * rows that share id, source and text are told apart by a hash of the row, and rows that are alike throughout are interchangeable;
    * an empty table gives an empty result; columns may have any other names.
    """
    own = docs.columns
    key = ["doc_id", "source", "digest"]
    hashable = [f"`{f.name}`" for f in docs.schema.fields if f.name != "text" and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    row_hash = F.xxhash64(*hashable).alias("row_hash")
    # the same rows in the same order on both sides: repeated rows pair off one to one
    twin = F.row_number().over(W.partitionBy(*key).orderBy("row_hash"))
    plan = planned(docs, [digest_of(F.col("text")).alias("digest"), row_hash], **options).withColumn("twin", twin).where("taken > 0")
    plan = plan.select(*[F.col(c).alias(f"plan_{c}") for c in (*key, "twin")], "size", "taken")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), "doc_id", "source", digest_of(F.col("text")).alias("digest"), row_hash).withColumn("twin", twin)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"plan_{c}")) for c in (*key, "twin")))
    out = (
        rows.join(plan, same)
        .select("row", "size", "taken")
        .withColumn("nth", F.explode(F.expr("sequence(1, int(ceil(taken / size)))")))
        .withColumn("part", F.least("size", F.col("taken") - (F.col("nth") - 1) * F.col("size")).cast("int"))
        .withColumn("text", F.when(F.col("part") < F.col("size"), first_words(F.col("row.text"), F.col("part"))).otherwise(F.col("row.text")))
    )
    value = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[value.get(c, F.col(f"row.`{c}`")).alias(c) for c in own])


def op3_mixing(spark, sf_dir):
    from walkframe.llm.common import table

    return mix(table(spark, sf_dir, "documents")).drop("source")


QUERIES = {"op3_mixing": op3_mixing}
ORACLE_SQL = {
    "op3_mixing": r"""
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS solid,
    (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710656.0 AS u
  FROM documents
), drawn AS (
  SELECT doc_id, source, size,
    pow(u, 1.0::DOUBLE / CASE WHEN solid > 0 THEN 0.05::DOUBLE + 0.95::DOUBLE * letters::DOUBLE / solid::DOUBLE ELSE 0.05::DOUBLE END) AS draw
  FROM sized
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM drawn GROUP BY source
), ranked AS (
  SELECT *, 2.0 * source_size::DOUBLE AS cap, (2.0 * source_size::DOUBLE) / weight AS ratio FROM per_source
), levels AS (
  SELECT *,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM ranked
), goals AS (
  SELECT source, source_size,
    least(cap, coalesce((SELECT arg_min(lv, ratio) FROM levels WHERE lv <= ratio) * weight, cap))::DOUBLE AS target
  FROM levels
), placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw DESC, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM drawn d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
), timed AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM timed
"""
}

"""Divergence of sources: how far apart smoothed term shares of two sources of a language are.

The distance of two sources is a sum over all kept terms, nearly all of which neither or only one of
them has. So a pair starts at its baseline, the number of terms times the difference of
two terms that occur in neither, and an inverted index corrects it: postings of a term emit a correction only for sources that have it.

* A term that only one source of a pair has corrects by an amount that depends on its own share
  and on the other source's share of nothing. All such terms of a source are summed at once for every other
  source, from running sums over the shares in falling order.
* A term that both have corrects what the two one-sided corrections got wrong; these come from pairs of postings.

Shares are whole numbers, computed in two steps of long division, so results are exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from walkframe.llm.common import slices, term_bytes, terms_of
from walkframe.operators.prefix import large
from walkframe.session import cut, stored

#: A language keeps the terms that occur in so many of its documents.
LEAST = 30
SMOOTH = 5
#: Ranks of terms that a source reports.
TERMS = 50
#: Entries that a task counts in before it hands them on.
ENTRIES = 1 << 18
#: Bytes of languages and sources up to which they are broadcast.
SMALL = 8 << 20
LETTERS = term_bytes(digits=False)


def counted(batches: Iterable[pa.RecordBatch], entries: int = ENTRIES) -> Iterator[pa.RecordBatch]:
    """``(lang, source, term, n, docs)``: occurrences and documents of terms, counted in the task that reads the texts."""
    occur: dict[tuple[str, str], Counter] = defaultdict(Counter)
    within: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in occur.items():
            docs, names = within[lang, source], list(n)
            for at in range(0, len(names), 1 << 16):
                part = names[at : at + (1 << 16)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([lang] * len(part), pa.string()), "source": pa.array([source] * len(part), pa.string()),
                        "term": pa.array(part, pa.binary()).cast(pa.string()), "n": pa.array([n[t] for t in part], pa.int64()), "docs": pa.array([docs[t] for t in part], pa.int64()),
                    }
                )
        occur.clear()
        within.clear()

    for batch in batches:
        for b in slices(batch, 64):
            for lang, source, text in zip(*[b.column(c).to_pylist() for c in ("lang", "source", "text")], strict=True):
                n, seen = occur[lang, source], set()
                for some in terms_of(text, LETTERS):
                    n.update(some)
                    seen.update(some)
                within[lang, source].update(seen)
            if sum(map(len, occur.values())) > entries:
                yield from handed_on()
    yield from handed_on()


def named(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)


def inverted_index(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(lang, term, lang_n, postings)`` of each kept term; ``postings`` has ``(source, n)`` for each source that has it."""
    texts = docs.select(named("lang"), named("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = texts.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    by_source = rows.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # an array for each term, no longer than the list of sources
    terms = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return terms.where(F.col("docs") >= least).select("lang", "term", "lang_n", "postings")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (n + 5) / (total + 5 * terms)), exact for totals up to 9 * 10^13: in two steps, so that no product overflows."""
    a, b = n + F.lit(SMOOTH), total + F.lit(SMOOTH) * terms
    return F.call_function("div", a * 100_000, b) * 10_000 + F.call_function("div", (a * 100_000) % b * 10_000, b) + 1


def source_divergence(docs: DataFrame, least: int = LEAST, ranks: int = TERMS, small: int = SMALL) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances of sources of a language, and the terms that a source has more of.

    * null texts, languages and sources are ``''``; rows count as documents, also repeated ones;
    * a language that keeps no term has pairs at distance 0 and no terms; a source alone in its language has no pairs;
    * ties go by the item in UTF-8; an empty table gives an empty result; other columns are ignored, whatever their names;
    * languages with their sources are broadcast below ``small`` bytes in all (counted), terms never.
    """
    index = stored(inverted_index(docs, least))
    # Spark takes postings for as small as the file of the index is, packed and before they are taken apart
    postings = large(index.select("lang", "term", "lang_n", F.inline("postings")))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = index.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = docs.select(named("lang"), named("source")).distinct().join(large(totals), ["lang", "source"], "left").join(large(langs), "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")])
    # without a kept term the baseline is 0 times anything
    groups = cut(groups.withColumn("nothing", F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms"))).otherwise(zero)))

    size = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).first()[0] or 0
    shares = postings.join(F.broadcast(groups) if size < small else groups, ["lang", "source"]).select(
        "lang", "term", "source", "nothing", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")
    )
    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    top = over.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= ranks)

    other = groups.select("lang", F.col("source").alias("item"), F.col("nothing").alias("item_nothing"))
    pairs = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", "terms", "nothing", "item_nothing")
    baseline = pairs.select("lang", "source", "item", (F.col("terms") * F.abs(F.col("nothing") - F.col("item_nothing"))).alias("value"))
    fixed = corrections_of_one(shares, pairs).union(corrections_of_both(shares)).where("value <> 0")
    both_ways = fixed.union(fixed.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    distance = baseline.union(both_ways).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = distance.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return ranked.union(top)


def corrections_of_one(shares: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: the corrections of all terms of ``source`` as if ``item`` had none of them.

    The sum of |p - x| over a source's shares p, for the share x of a term that the other source hasn't, needs
    only how many of the shares are over x and what they sum to.
    """
    equal = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    none = F.lit(None).cast("string")
    marks = equal.select("lang", "source", F.col("p").alias("x"), "k", (F.col("k") * F.col("p")).alias("kp"), none.alias("item"), F.lit(None).cast("long").alias("nothing"))
    zero = F.lit(0).cast("long")
    marks = marks.union(pairs.select("lang", "source", F.col("item_nothing").alias("x"), zero, zero, "item", "nothing"))
    whole = W.partitionBy("lang", "source")
    falling = whole.orderBy(F.col("x").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    sums = [F.sum(c).over(w).alias(f"{c}_{name}") for c in ("k", "kp") for name, w in (("over", falling), ("all", whole))]
    found = marks.select("lang", "source", "item", "x", "nothing", *sums).where("item is not null")
    apart = 2 * (F.col("kp_over") - F.col("k_over") * F.col("x")) - (F.col("kp_all") - F.col("k_all") * F.col("x"))
    return found.select("lang", "source", "item", (apart - F.col("k_all") * F.abs(F.col("nothing") - F.col("x"))).alias("value"))


def corrections_of_both(shares: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for terms that both have, once for each pair: what the one-sided corrections got wrong, summed."""
    a = large(shares).select("lang", "term", "source", "p", "nothing")
    b = a.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("nothing").alias("item_nothing"))
    apart = lambda x, y: F.abs(F.col(x) - F.col(y))
    off = apart("p", "r") - apart("p", "item_nothing") - apart("nothing", "r") + apart("nothing", "item_nothing")
    found = a.join(b, ["lang", "term"]).where("source < item").select("lang", "source", "item", off.alias("value"))
    return found.where("value <> 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def op11_source_divergence(spark, sf_dir):
    from walkframe.llm.common import table

    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLE_SQL = {
    "op11_source_divergence": r"""
WITH texts AS (
  SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents
), tokens AS (
  SELECT nr, lang, source, unnest(found) AS term FROM texts
), kept AS (
  SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT nr) >= 30
), vocab AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term
), lang_counts AS (
  SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term
), lang_totals AS (
  SELECT lang, sum(n) AS total FROM lang_counts GROUP BY lang
), groups AS (
  SELECT t.lang, t.source, coalesce(c.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM texts) t
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source) c USING (lang, source)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.total + 5 * v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (l.n + 5)::HUGEINT) // (lt.total + 5 * v.v)::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN vocab v USING (lang) JOIN lang_counts l USING (lang, term) JOIN lang_totals lt USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item ASC))::INTEGER AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
}

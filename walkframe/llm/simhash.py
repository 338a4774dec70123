"""SimHash near-duplicates: fingerprints, and links at a small Hamming distance.

Links are found by a segment-popcount embedding. A fingerprint is mapped to the
number of set bits in each of its 32 two-bit segments. Flipping a bit changes
one count by one, so the Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints: a lower bound that prunes. The range join
under that bound runs on a grid: the segments form groups, six of them or more for
more fingerprints, and two embeddings at Manhattan distance 3 or less agree wholly
in all but three, so they share the unit cell of at least one choice of so many
groups (20 choices of three of six). Pairs that share a cell are compared by the
bound and then exactly. Cells with very many fingerprints aren't compared in pairs:
there, fingerprints link through the values one and two bits away from them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, Window as W

from walkframe.llm.common import slices, whole_groups
from walkframe.operators.components import connected_components, contracted
from walkframe.session import cut

SEED = 42
DISTANCE = 3
#: Fingerprints to expect in a cell of the grid, at most, if they were random: more groups make finer cells.
CELL = 16
#: Over this many fingerprints a cell is dealt to several tasks, in pairs of blocks.
BLOCK = 4096
#: Over this many, its fingerprints link through neighbouring values.
DENSE = 1 << 19
#: Up to this many, a cell's links are compared by shifting; above, as one matrix.
SMALL = 64
LOW = 0x5555555555555555


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def groups_for(n: int) -> int:
    """How many groups: a count of two random bits has 1.5 bits of information, so cells of g groups have 48 * (g - 3) / g."""
    return next((g for g in range(DISTANCE + 3, 12) if n <= CELL * 2 ** (48 * (g - DISTANCE) / g)), 12)


def cell_masks(groups: int) -> list[int]:
    """The bits of each choice of all groups but three, the 32 two-bit segments dealt to groups in turn."""
    of_group = [sum(3 << (2 * s) for s in range(g, 32, groups)) for g in range(groups)]
    return [sum(choice) for choice in combinations(of_group, groups - DISTANCE)]


BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the lower-cased (A-Z only) word shingles of one whole text, unsigned."""
    words = (text or b"").lower().split()  # bytes: lowers ASCII only, splits at \x20 and \x09-\x0D only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    of_byte = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(of_byte[:, i], minlength=256) @ BITS_OF_BYTE for i in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, digest: bool = False) -> DataFrame:
    """``(doc_id, fp)``: one signed 64-bit fingerprint per row; null and wordless texts have 0. With the text's digest, if asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1024):
                fp = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    more = [digest_of(F.col("text")).alias("digest")] if digest else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)
    return rows.mapInArrow(run, "doc_id long, fp long" + ", digest binary" * digest)


def digest_of(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Two-bit counts of set bits, 32 of them in each 64-bit word."""
    return (fp & LOW) + ((fp >> np.uint64(1)) & LOW)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of two embeddings: per segment, counts 0..2 differ by 0..2."""
    # |x-y| of values 0..2 equals the distance of their thermometer codes 00, 01, 11.
    code = lambda c: (c | (c >> np.uint64(1))) & LOW | (c & ~np.uint64(LOW))
    return np.bitwise_count(code(a) ^ code(b))


def near(fa: np.ndarray, fb: np.ndarray, distance: int) -> np.ndarray:
    """Manhattan bound first, then the exact test of what is left."""
    ok = manhattan(segment_counts(fa), segment_counts(fb)) <= distance
    ok[ok] = np.bitwise_count((fa ^ fb)[ok]) <= distance
    return ok


def spanning(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within one block: fewer than its fingerprints."""
    rest, a, b = np.arange(len(fp)), [], []
    while len(rest):
        reached, open_, rest = rest[:1], rest[:1], rest[1:]
        while len(open_) and len(rest):
            hit = np.zeros(len(rest), dtype=bool)
            for x in open_:
                hit |= near(np.full(len(rest), fp[x]), fp[rest], distance)
                if hit.all():
                    break
            open_, rest = rest[hit], rest[~hit]
            a += [reached[:1].repeat(len(open_))]
            b += [open_]
    return np.concatenate(a or [rest]), np.concatenate(b or [rest])


def links_of_cells(batches: Iterable[pa.RecordBatch], groups: int, distance: int = DISTANCE) -> Iterator[pa.RecordBatch]:
    masks = np.array(cell_masks(groups), dtype=np.uint64)
    for t, at in whole_groups(batches, ["k", "cell", "lo", "hi"]):
        fp, rep = t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy()
        k = t.column("k").to_numpy()
        ends = np.append(at[1:], len(fp))
        n = ends - at
        left = np.repeat(ends, n) - np.arange(len(fp)) - 1  # how many of its group follow each row
        left[np.repeat(n > SMALL, n)] = 0
        src, dst = [], []
        shift = 0
        i = np.flatnonzero(left > 0)
        while len(i):
            shift += 1
            i = i[left[i] >= shift]
            j = i + shift
            ok = near(fp[i], fp[j], distance)
            a, b = i[ok], j[ok]
            # a pair that shares several cells is reported from the first only
            differ = segment_counts(fp[a]) ^ segment_counts(fp[b])
            first = np.argmax((differ[:, None] & masks[None, :]) == 0, axis=1) if len(a) else a
            own = first == k[a]
            src.append(a[own])
            dst.append(b[own])
        for g in np.flatnonzero(n > SMALL):
            a, b = spanning(fp[at[g] : ends[g]], distance)
            src.append(a + at[g])
            dst.append(b + at[g])
        s, d = (np.concatenate(x or [np.zeros(0, dtype=np.int64)]) for x in (src, dst))
        yield pa.RecordBatch.from_arrays([pa.array(rep[s]), pa.array(rep[d])], ["src", "dst"])


def flips(bits: int) -> np.ndarray:
    """The masks that flip so many bits at most."""
    return np.array([sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(64), n)], dtype=np.uint64)


def around(bits: int):
    """Of each (fp, rep): a row (value, rep) for each value so many bits away at most."""
    masks = flips(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1024):
                values = b.column("fp").to_numpy().view(np.uint64)[:, None] ^ masks
                yield pa.RecordBatch.from_arrays([pa.array(values.ravel().view(np.int64)), pa.array(np.repeat(b.column("rep").to_numpy(), len(masks)))], ["value", "rep"])

    return run


def links_of_neighbours(dense: DataFrame) -> DataFrame:
    """Of ``(fp, rep)``: links ``(src, dst)`` that connect all that is 3 bits apart or less, in time linear in the rows.

    Where a fingerprint is one bit away from a value at most, all that are two bits away at most link with it,
    and any two that link share such a value. So each links with one fingerprint close to the value, not with each other.
    """
    rows = dense.select("fp", "rep")
    centre = rows.mapInArrow(around(1), "value long, rep long").groupBy("value").agg(F.min("rep").alias("dst"))
    return rows.mapInArrow(around(2), "value long, rep long").join(centre, "value").where("rep <> dst").select(F.col("rep").alias("src"), "dst").distinct()


def near_links(reps: DataFrame, groups: int | None = None) -> DataFrame:
    """Of distinct ``(fp, rep)``: links ``(src, dst)`` between reps, enough to connect all that is near."""
    groups = groups or groups_for(reps.count())
    fp = F.col("fp")
    low = F.lit(LOW)
    half = F.shiftrightunsigned(fp, 1)
    counts = F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseXOR(half).bitwiseAND(low))  # no sum: it may overflow
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col("counts").bitwiseAND(F.lit(signed(m))).alias("cell")) for k, m in enumerate(cell_masks(groups))])
    rows = reps.withColumn("counts", counts).select("fp", "rep", F.explode(cells).alias("c")).select("fp", "rep", "c.k", "c.cell")
    # counted in the tasks first: no task gets all of a cell before it is dealt
    shared = cut(rows.groupBy("k", "cell").agg(F.count("*").alias("n")).where("n > 1"))
    blocks = F.when(F.col("n") > BLOCK, F.ceil(F.col("n") * 2 / BLOCK)).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        rows.join(shared.where(F.col("n") <= DENSE), ["k", "cell"])
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("k", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "rep")
    )
    links = (
        dealt.repartition("k", "cell", "lo", "hi")
        .sortWithinPartitions("k", "cell", "lo", "hi", "fp")
        .mapInArrow(lambda batches: contracted(links_of_cells(batches, groups), ("src", "dst")), "src long, dst long")
    )
    if shared.where(F.col("n") > DENSE).isEmpty():
        return links
    dense = rows.join(shared.where(F.col("n") > DENSE), ["k", "cell"]).select("fp", "rep").distinct()
    return links.union(links_of_neighbours(cut(dense)))


def simhash_components(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs``.

    Documents link when their fingerprints differ in 3 bits or fewer;
    ``component_id`` is the smallest ``doc_id`` reachable by links, itself included.

    * null, empty and wordless texts have fingerprint 0 and link like any other;
    * repeated rows are equal fingerprints: each comes back, in one component;
    * an empty table gives an empty result; other columns are ignored, whatever their names;
    * rows with a null ``doc_id`` are returned, with the component of their fingerprint.

    Equal fingerprints are one row before anything is compared, so copies cost
    nothing beyond counting; large cells are split in pairs of blocks and report
    a spanning set of links, never all pairs; beyond ``DENSE`` they aren't paired at all.
    """
    fps = cut(fingerprints(docs, width))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    cc = connected_components(near_links(reps.where("rep is not null")), contract=False)
    label = reps.join(cc, reps.rep == cc.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


def near_deduplicate(docs: DataFrame) -> DataFrame:
    """Keep one row of every component, with all its columns: of the smallest ``doc_id``; without any, of the smallest digest.

    Fingerprints are linked, whatever ids their rows have: a row without ``doc_id`` is
    kept only where its component has no id at all, and rows that share the kept id
    (and even the text) are one row in the result.
    """
    fps = cut(fingerprints(docs, digest=True).groupBy("fp", "doc_id", "digest").agg(F.count("*").alias("n")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "n")).alias("best")
    of_fp = cut(fps.groupBy("fp").agg(best))
    cc = connected_components(near_links(of_fp.select("fp", F.col("fp").alias("rep"))), contract=False)
    of_component = of_fp.join(cc, of_fp.fp == cc.node, "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("best").alias("best"))
    keep = cut(of_component.select(F.col("best.doc_id").alias("keep_id"), F.col("best.digest").alias("keep_digest"), F.col("best.n").alias("n")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("row_id"), digest_of(F.col("text")).alias("digest"))
    same = F.col("row_id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest"))
    kept = rows.join(keep.where("n = 1"), same, "left_semi").select("row")
    if not keep.where("n > 1").isEmpty():
        # rows of one id and text: one is taken, where they differ elsewhere any
        several = rows.join(keep.where("n > 1"), same, "left_semi")
        kept = kept.union(several.groupBy("row_id", "digest").agg(F.any_value("row").alias("row")).select("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op10_simhash_near_dedup(spark, sf_dir):
    from walkframe.llm.common import table

    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}

"""Suffix-array deduplication: bytes covered by 50-byte strings that an earlier document has as well.

Prefix doubling: Spark sorts pairs of ranks of positions at growing offsets, names each pair
by the smallest position that has it, and drops what is unique.

1. *Filter of positions.* Lengths below 24 bytes are not sorted: of each 50-byte window only the
   position whose 24-byte prefix has the smallest hash is looked at (its anchor, which depends on the window's
   bytes alone), and anchors whose prefix is in one text only are dropped, with all windows they stand for.
   Equal hashes keep too much at most, never too little. What is left are *contexts*: runs of windows of one anchor.
2. *Offset 16.* Pairs of the first 16 bytes of a context and the 16 bytes after them, compared as they are,
   give ranks of 32 bytes. Unique ones are dropped.
3. *Offset 32.* Pairs of these ranks and the 18 to 44 bytes that follow give ranks of whole contexts, 50 to 76 bytes.
   Where an earlier document has the same, all its windows are repeats.
4. Contexts that differ, but share their anchor's prefix, are taken apart. A window has 26 bytes beside the prefix, so 13 at least
   on one side: the prefix with 13 bytes to its left, and with 13 to its right (37 bytes, a *side*), are ranked, and sides that
   one document alone has are dropped with their windows.
5. *On to 50.* A window is the rank of its side, the place of the side in it, and the 13 bytes that are left over: one row,
   sorted and named again.

Ranks stand for bytes that were compared whole, so equality is exact. Equal texts are one class from the start: its first
document is compared, and the others are removed whole (by SHA-256). Equal contexts of a group of texts are sent once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from walkframe.session import cut, discard, release, stored

LENGTH = 50
PREFIX = 24
#: Bytes that a rank of the first sort stands for.
RANKED = 32
#: A window has so many bytes at least on one side of its anchor's prefix.
SIDE = (LENGTH - PREFIX) // 2
KEY = ["k0", "k1", "k2", "k3"]
#: Bytes of text in a group (a task's unit of work), and whose prefixes share a bucket of round 1.
GROUP_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20
#: Windows handled at a time within a group: arrays that stay in a core's cache.
STEP = 1 << 18
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
LOW32 = (1 << 32) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= B
    x ^= x >> np.uint64(29)
    return x


@lru_cache(maxsize=8)
def byte_values(seed: int) -> np.ndarray:
    """A fixed 64-bit number for each byte."""
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(seed) * np.uint64(256) + np.uint64(1)) * A)


def prefix_ranks(x: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Fingerprints of the ``length`` bytes from each position, by doubling: rank pairs at offsets 1, 2, 4, ..."""

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a * C
        h += b
        h ^= h >> np.uint64(32)
        return h

    h, size, out, have = byte_values(seed)[x], 1, None, 0
    while True:
        if length & size:
            n = max(0, len(h) - have)
            out, have = (h, size) if out is None else (pair(out[:n], h[have : have + n]), have + size)
        if 2 * size > length:
            return mix(out[: max(0, len(x) - length + 1)])
        h = pair(h[:-size], h[size:]) if len(h) > size else h[:0]
        size *= 2


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by minima of 1, 2, 4, ... neighbours."""
    n, size = len(a) - width + 1, 1
    if n <= 0:
        return a[:0]
    while 2 * size <= width:
        a, size = np.minimum(a[:-size], a[size:]), 2 * size
    return np.minimum(a[:n], a[width - size : width - size + n])


class Group:
    """The distinct texts of one group, joined in the order of doc_id."""

    def __init__(self, t: pa.Table) -> None:
        rows = sorted(zip(t.column("doc_id").to_pylist(), t.column("key").to_pylist(), range(len(t))))
        text = t.column("text").combine_chunks()
        keep = [r for k, r in enumerate(rows) if not k or r[:2] != rows[k - 1][:2]]
        parts = [text[i].as_py() for _, _, i in keep]
        self.docs = np.array([d for d, _, _ in keep], dtype=np.int64)
        self.keys = [k for _, k, _ in keep]
        self.starts = np.cumsum([0] + [len(x) for x in parts])
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)
        # texts that share a doc_id are told apart by a number, 0 for all others
        self.first = np.searchsorted(self.docs, self.docs)
        self.twin = np.arange(len(self.docs)) - self.first

    def at(self, which: np.ndarray, offset: np.ndarray) -> np.ndarray:
        return (self.twin[which] << 32) | offset

    def find(self, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, position in the joined texts) of places given by doc_id and ``at``."""
        which = np.searchsorted(self.docs, doc) + (at >> 32)
        return which, self.starts[which] + (at & LOW32)

    def anchors(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Chunks of (text, prefix rank, anchor, first window, last window); positions are in the joined texts."""
        total = len(self.bytes)
        low = np.uint64((1 << 24) - 1)
        for at in range(0, max(0, total - LENGTH + 1), STEP):
            x = self.bytes[at : at + STEP + LENGTH - 1]
            ranks = prefix_ranks(x, PREFIX, 1)
            # the smallest rank, and of equal ones the last: position counts down in the low bits
            packed = ranks & ~low
            packed |= low - np.arange(len(ranks), dtype=np.uint64)
            least = sliding_min(packed, LENGTH - PREFIX + 1)
            inside = np.ones(len(least), dtype=bool)
            ends = self.starts[np.searchsorted(self.starts, at + 1) : np.searchsorted(self.starts, at + len(least) + LENGTH)]
            across = (ends[:, None] - np.arange(1, LENGTH)[None, :] - at).ravel()
            inside[across[(across >= 0) & (across < len(inside))]] = False
            first = np.flatnonzero(inside)
            if not len(first):
                continue
            anchor = (low - (least[first] & low)).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)]))
            last = first[np.append(new[1:], len(first)) - 1] + at
            anchor, first = anchor[new], first[new] + at
            yield np.searchsorted(self.starts, first, side="right") - 1, ranks[anchor], anchor + at, first, last


def bucket_keys(rank: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of round 1 in the high half, 32 bits of the rank in the low half."""
    return ((rank % np.uint64(buckets)) << np.uint64(32)) | (rank >> np.uint64(32))


def distinct_ranks(group: Group, buckets: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each bucket, the sorted distinct 32-bit ranks and whether two texts have them."""
    found = list(group.anchors())
    if not found:
        return {}
    which, key = np.concatenate([f[0] for f in found]), bucket_keys(np.concatenate([f[1] for f in found]), buckets)
    order = np.argsort(key, kind="stable")  # texts come in order, so they stay sorted within a key
    key, which = key[order], which[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = which[at] != which[np.append(at[1:], len(key)) - 1]
    key = key[at]
    edges = np.searchsorted(key, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
    return {b: (key[s:e].astype(np.uint32), several[s:e]) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s}


def empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


BLOBS = "bucket int, grp int, ranks binary, several binary"
REPLY = "grp int, bucket int, shared binary"
REPLY_PA = pa.schema([("grp", pa.int32()), ("bucket", pa.int32()), ("shared", pa.binary())])
CONTEXTS = "id long, same long, first long, rank long, doc_id long, at long, size int, anchor int"
CONTEXTS_PA = pa.schema([*((c, pa.int64()) for c in ("id", "same", "first", "rank", "doc_id", "at")), ("size", pa.int32()), ("anchor", pa.int32())])
STARTS = "id long, doc_id long, at long, size int, k0 long, k1 long, k2 long, k3 long"
STARTS_PA = pa.schema([*((c, pa.int64()) for c in ("id", "doc_id", "at")), ("size", pa.int32()), *((c, pa.int64()) for c in KEY)])
#: ``rest``: what follows the bytes that ``rank`` stands for.
RESTS = "id long, doc_id long, rank long, rest binary"
RESTS_PA = pa.schema([*((c, pa.int64()) for c in ("id", "doc_id", "rank")), ("rest", pa.binary())])
#: ``bytes``: a side with 13 bytes before and 13 after it; ``before``: of these, how many the window that starts at ``start`` has.
SIDES = "id long, doc_id long, start long, lo int, hi int, before int, bytes binary"
SIDES_PA = pa.schema([*((c, pa.int64()) for c in ("id", "doc_id", "start")), *((c, pa.int32()) for c in ("lo", "hi", "before")), ("bytes", pa.binary())])
RESULT = "doc_id long, key string, n_removed long, n_spans long, kept_sha256 string"
RESULT_PA = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def without_copies(t: pa.Table, names: list[bytes]) -> pa.Table:
    """``t`` without the texts that a smaller doc_id has as a whole."""
    known = set(names)
    own = [f"{d}:{k}".encode() not in known for d, k in zip(t.column("doc_id").to_pylist(), t.column("key").to_pylist())]
    return t.filter(pa.array(own, pa.bool_()))


def send_ranks(buckets: int):
    def run(t: pa.Table, copies: pa.Table) -> pa.Table:
        """The filter, from a group: the distinct prefix ranks of its texts, by bucket."""
        of = distinct_ranks(Group(without_copies(t, copies.column("name").to_pylist())), buckets)
        grp = t.column("grp")[0].as_py() if len(t) else 0
        return pa.table(
            {
                "bucket": pa.array(list(of), pa.int32()),
                "grp": pa.array([grp] * len(of), pa.int32()),
                "ranks": pa.array([r.tobytes() for r, _ in of.values()], pa.binary()),
                "several": pa.array([np.packbits(s).tobytes() for _, s in of.values()], pa.binary()),
            }
        )

    return run


def shared_ranks(t: pa.Table) -> pa.Table:
    """The filter, in a bucket: tell each group which of its ranks two or more texts have."""
    ranks = [np.frombuffer(x, dtype=np.uint32) for x in t.column("ranks").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(r)).astype(bool) for x, r in zip(t.column("several").to_pylist(), ranks)]
    if not ranks:
        return empty(REPLY_PA)
    everything = np.sort(np.concatenate(ranks))
    twice = np.unique(np.concatenate([everything[1:][everything[1:] == everything[:-1]], *(r[s] for r, s in zip(ranks, several))]))
    own = [r[np.isin(r, twice, assume_unique=True)].tobytes() for r in ranks]
    return pa.table({"grp": t.column("grp"), "bucket": t.column("bucket"), "shared": pa.array(own, pa.binary())})


def first_equal(group: Group, start: np.ndarray, size: np.ndarray, rank: np.ndarray, step: int = STEP) -> np.ndarray:
    """For each context of a group, which one is the first with the same bytes.

    Equal ones have one anchor, so one prefix rank, and one size: only those that share both are compared, some ``step`` at a time.
    """
    same, order = np.arange(len(start)), np.lexsort((size, rank))
    new = np.flatnonzero(np.concatenate([[True], (rank[order[1:]] != rank[order[:-1]]) | (size[order[1:]] != size[order[:-1]])]))
    count = np.diff(np.append(new, len(order)))
    order = order[np.repeat(count > 1, count)]
    # whole runs of contexts that may be equal
    ends = np.cumsum(count[count > 1])
    at = 0
    while at < len(order):
        to = ends[max(np.searchsorted(ends, at + step, side="right") - 1, np.searchsorted(ends, at, side="right"))]
        some = np.sort(order[at:to])
        same[some] = some[equal_bytes(group, start[some], size[some])]
        at = to
    return same


def equal_bytes(group: Group, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each string of a group, which one is the first with the same bytes."""
    widest = int(size.max())
    rows = np.zeros((len(start), widest), dtype=np.uint8)
    column = np.arange(widest)
    for lo in range(0, len(start), STEP):
        s, n = start[lo : lo + STEP, None], size[lo : lo + STEP, None]
        place = np.minimum(s + column, len(group.bytes) - 1)
        rows[lo : lo + STEP] = np.where(column < n, group.bytes[place], 0)
    # strings of two sizes differ, also where the longer one goes on with zeros
    rows = np.concatenate([rows, size.astype(np.uint8)[:, None]], axis=1)
    _, at, of = np.unique(rows.view(np.dtype((np.void, widest + 1))).ravel(), return_index=True, return_inverse=True)
    return at[of.ravel()]


def open_contexts(buckets: int):
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        """From a group: the contexts of all anchors that aren't unique, numbered; ``same`` and ``first`` are the number
        and the doc_id of the first context in the group that has the same bytes."""
        if not len(t) or not len(replies):
            return empty(CONTEXTS_PA)
        copy = replies.column("bucket").to_numpy() < 0
        group = Group(without_copies(t, replies.filter(pa.array(copy)).column("shared").to_pylist()))
        replies = replies.filter(pa.array(~copy))
        if not len(replies):
            return empty(CONTEXTS_PA)
        shared = np.sort(
            np.concatenate(
                [
                    (np.uint64(b) << np.uint64(32)) | np.frombuffer(x, dtype=np.uint32).astype(np.uint64)
                    for b, x in zip(replies.column("bucket").to_pylist(), replies.column("shared").to_pylist())
                ]
            )
        )
        if not len(shared):
            return empty(CONTEXTS_PA)
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for which, rank, anchor, first, last in group.anchors():
            key = bucket_keys(rank, buckets)
            keep = shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] == key
            which, rank, anchor, first, last = (x[keep] for x in (which, rank, anchor, first, last))
            at = group.at(which, first - group.starts[which])
            for o, v in zip(out, (rank.view(np.int64), group.docs[which], at, (last - first + LENGTH).astype(np.int32), (anchor - first).astype(np.int32))):
                o.append(v)
        if not out[0]:
            return empty(CONTEXTS_PA)
        rank, doc, at, size, anchor = (np.concatenate(o) for o in out)
        if not len(rank):
            return empty(CONTEXTS_PA)
        same = first_equal(group, group.find(doc, at)[1], size, rank)
        base = t.column("grp")[0].as_py() << 28
        return pa.table([base + np.arange(len(rank)), base + same, doc[same], rank, doc, at, size, anchor], schema=CONTEXTS_PA)

    return run


def send_starts(t: pa.Table, strings: pa.Table) -> pa.Table:
    """From a group: the first 32 bytes of each string as four numbers."""
    if not len(t) or not len(strings):
        return empty(STARTS_PA)
    group = Group(t)
    start = group.find(strings.column("doc_id").to_numpy(), strings.column("at").to_numpy())[1]
    keys = np.empty((len(KEY), len(start)), dtype=np.int64)
    for lo in range(0, len(start), STEP):
        part = group.bytes[start[lo : lo + STEP, None] + np.arange(RANKED)]
        keys[:, lo : lo + STEP] = part.view("<i8").T
    return pa.table([*(strings.column(c) for c in ("id", "doc_id", "at", "size")), *keys], schema=STARTS_PA)


def send_rests(t: pa.Table, strings: pa.Table) -> pa.Table:
    """From a group: what follows the first 32 bytes of each string, beside their rank."""
    if not len(t) or not len(strings):
        return empty(RESTS_PA)
    group = Group(t)
    size = strings.column("size").to_numpy() - RANKED
    start = group.find(strings.column("doc_id").to_numpy(), strings.column("at").to_numpy())[1] + RANKED
    offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    data = np.empty(int(offsets[-1]), dtype=np.uint8)
    for lo in range(0, len(start), STEP):
        n, to = size[lo : lo + STEP], offsets[lo : lo + STEP + 1]  # one offset more than sizes
        data[to[0] : to[-1]] = group.bytes[np.repeat(start[lo : lo + STEP] - to[:-1], n) + np.arange(to[0], to[-1])]
    rest = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pa.table([*(strings.column(c) for c in ("id", "doc_id", "rank")), rest], schema=RESTS_PA)


def earlier(by_group, strings: DataFrame, group_of) -> DataFrame:
    """``(id, first)`` of the strings that an earlier document has as well: the smallest doc_id that has the same bytes.

    ``strings`` has ``id, doc_id, at, size`` (50 to 76 bytes) and ``grp``; no group has two that are equal, so
    a string meets one row a group, and one exchange serves each round's counts and join. A popular start is
    a hot key of the first round's join, which adaptive execution splits.
    """
    spark = strings.sparkSession
    starts = by_group.cogroup(strings.groupBy("grp")).applyInArrow(send_starts, STARTS).repartition(*KEY)
    ranked = stored(starts.join(smallest(starts, KEY).drop("first"), KEY).select("id", "doc_id", "at", "size", "rank"))
    release(spark)
    rests = by_group.cogroup(ranked.withColumn("grp", group_of).groupBy("grp")).applyInArrow(send_rests, RESTS).repartition("rank", "rest")
    found = stored(rests.join(smallest(rests, ["rank", "rest"]), ["rank", "rest"]).where("doc_id > first").select("id", "first"))
    discard(ranked)
    release(spark)
    return found


def smallest(rows: DataFrame, name: list[str]) -> DataFrame:
    """``(*name, rank, first)`` of the names that two documents or more have: the smallest id as rank (where ``rows`` have an id and no rank), and the smallest doc_id.

    Aggregated in the tasks first, so a popular name is one row of each.
    """
    id_ = [] if "rank" in name or "id" not in rows.columns else [F.min("id").alias("rank")]
    of_name = rows.groupBy(*name).agg(*id_, F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return of_name.where("first < last").drop("last").hint("merge")


def send_sides(t: pa.Table, sides: pa.Table) -> pa.Table:
    """From a group: the bytes of each side, with 13 on either side (where the text ends sooner, any: no window has them)."""
    if not len(t) or not len(sides):
        return empty(SIDES_PA)
    group = Group(t)
    start, at = (sides.column(c).to_numpy() for c in ("start", "at"))
    _, place = group.find(sides.column("doc_id").to_numpy(), at)
    width = PREFIX + 3 * SIDE
    data = np.empty((len(place), width), dtype=np.uint8)
    for lo in range(0, len(place), STEP):
        where = place[lo : lo + STEP, None] + np.arange(-SIDE, width - SIDE)
        data[lo : lo + STEP] = group.bytes[np.clip(where, 0, len(group.bytes) - 1)]
    offsets = pa.py_buffer(np.arange(0, (len(place) + 1) * width, width, dtype=np.int32))
    around = pa.Array.from_buffers(pa.binary(), len(place), [None, offsets, pa.py_buffer(data)])
    kept = [sides.column(c) for c in ("id", "doc_id", "start", "lo", "hi")]
    return pa.table([*kept, pa.array((at - start).astype(np.int32)), around], schema=SIDES_PA)


def repeated_windows(by_group, sides: DataFrame) -> DataFrame:
    """``(doc_id, at, size)`` of the windows of ``sides`` that an earlier document has as well.

    ``sides`` has ``id, doc_id, start, at, lo, hi`` and ``grp``: 37 bytes at ``at``, and the windows that start ``lo`` to ``hi`` after ``start``.
    """
    spark = sides.sparkSession
    around = stored(by_group.cogroup(sides.groupBy("grp")).applyInArrow(send_sides, SIDES))
    release(spark)
    side = around.withColumn("side", F.substring("bytes", SIDE + 1, PREFIX + SIDE))
    rest = F.concat(F.substring("bytes", 1, SIDE), F.substring("bytes", PREFIX + 2 * SIDE + 1, SIDE))
    ranked = stored(side.join(smallest(side, ["side"]), "side").select("rank", F.col("first").alias("side_first"), "doc_id", "start", "lo", "hi", "before", rest.alias("rest")))
    discard(around)
    release(spark)
    windows = ranked.withColumn("k", F.explode(F.sequence("lo", "hi"))).withColumn("p", F.col("before") - F.col("k"))
    # of the 13 bytes before the side the last p, and of those after it the first 13 - p: neighbours in rest
    windows = windows.select(
        (F.col("rank") * 16 + F.col("p")).alias("side"), F.substring("rest", SIDE + 1 - F.col("p"), F.lit(SIDE)).alias("rest"), "doc_id", (F.col("start") + F.col("k")).alias("at"), "side_first"
    )
    name = ["side", "rest"]
    # the first document that has a side has no window of it from an earlier one
    repeats = windows.where("doc_id > side_first").join(smallest(windows, name), name).where("doc_id > first")
    repeats = stored(repeats.select("doc_id", "at", F.lit(LENGTH).alias("size")))
    discard(ranked)
    release(spark)
    return repeats


def remove(t: pa.Table, repeats: pa.Table) -> pa.Table:
    """Of each text of a group: what is left without the bytes of its repeated windows."""
    group = Group(t)
    covered = np.zeros(len(group.bytes) + 1, dtype=np.int32)
    if len(repeats):
        _, place = group.find(repeats.column("doc_id").to_numpy(), repeats.column("at").to_numpy())
        np.add.at(covered, place, 1)
        np.add.at(covered, place + repeats.column("size").to_numpy(), -1)
    gone = np.cumsum(covered, out=covered)[:-1] > 0
    rows = []
    for doc, key, s, e in zip(group.docs.tolist(), group.keys, group.starts[:-1], group.starts[1:]):
        off = gone[s:e]
        if not off.any():
            continue  # nothing removed: the digest of the text is known
        spans = int(np.count_nonzero(off[1:] & ~off[:-1])) + bool(off[0])
        rows.append((doc, key, int(off.sum()), spans, hashlib.sha256(group.bytes[s:e][~off].tobytes()).hexdigest()))
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(RESULT_PA)], schema=RESULT_PA)


def one_of_each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, key, text)``, the key being the text's SHA-256; of equal texts in a batch the row with the smallest doc_id: copies don't reach the exchange."""
    for b in batches:
        best: dict[str, tuple[int, int]] = {}
        for i, (d, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
            k = hashlib.sha256(text.as_buffer()).hexdigest()
            if k not in best or d < best[k][0]:
                best[k] = (d, i)
        keys = {i: k for k, (_, i) in best.items()}
        kept = b.take(pa.array(sorted(keys), pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column(0), pa.array([keys[i] for i in sorted(keys)], pa.string()), kept.column(1)], ["doc_id", "key", "text"])


def repeated_bytes_removed(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row of ``docs``.

    A byte goes if a 50-byte string that covers it starts in a document with a
    smaller ``doc_id`` too. Strings don't cross documents and are judged on the input.

    * null and empty texts have 0 bytes, nothing removed, and the digest of no bytes;
    * a row that repeats the whole text of a smaller ``doc_id`` loses all of it (50 bytes or more);
    * rows that share ``doc_id`` and text get one result each; one without ``doc_id`` keeps its
      text and removes nothing elsewhere;
    * texts are read whole; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ids = cut(rows.select("doc_id", F.sha2("text", 256).alias("key"), F.octet_length("text").cast("long").alias("n_bytes")))
    total = ids.agg(F.sum("n_bytes")).first()[0] or 0
    groups, buckets = max(1, -(-total // GROUP_BYTES)), max(1, -(-total // BUCKET_BYTES))
    group_of = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("grp")
    texts = (
        rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
        .mapInArrow(one_of_each, "doc_id long, key string, text binary")
        .withColumn("grp", group_of)
        .repartition(groups, "grp")
    )
    by_group = texts.groupBy("grp")
    # the filter of positions
    of_text = ids.groupBy("key").agg(F.min("doc_id").alias("rep"))
    named = ids.join(of_text, "key")
    copies = named.where("doc_id > rep").select(group_of, F.concat_ws(":", F.col("doc_id").cast("string"), "key").cast("binary").alias("name")).distinct()
    ranks = by_group.cogroup(copies.groupBy("grp")).applyInArrow(send_ranks(buckets), BLOBS)
    replies = ranks.groupBy("bucket").applyInArrow(shared_ranks, REPLY)
    replies = replies.union(copies.select("grp", F.lit(-1).alias("bucket"), "name"))
    contexts = stored(by_group.cogroup(replies.groupBy("grp")).applyInArrow(open_contexts(buckets), CONTEXTS))
    release(spark)
    # ranks of contexts
    found = earlier(by_group, contexts.where("id = same").withColumn("grp", group_of), group_of)
    judged = contexts.join(found.select(F.col("id").alias("same"), F.col("first").alias("before")), "same", "left")
    judged = stored(judged.select("id", "rank", "doc_id", "at", "size", "anchor", F.coalesce("before", "first").alias("first")))
    discard(contexts)
    discard(found)
    release(spark)
    # contexts of one prefix that differ: each place in a context's first document may hold windows of a smaller doc_id
    differ = judged.groupBy("rank").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b")
    asked = judged.where("doc_id = first").join(differ, "rank", "left_semi")
    # starts of windows (from the context's) that have 13 bytes or more to the left of the prefix, and of the others
    last = F.col("size") - LENGTH
    left = F.struct((F.col("id") * 2).alias("id"), (F.col("at") + F.col("anchor") - SIDE).alias("at"), F.lit(0).alias("lo"), F.least(F.col("anchor") - SIDE, last).alias("hi"))
    lo = F.greatest(F.lit(0), F.col("anchor") - SIDE + 1)
    right = F.struct((F.col("id") * 2 + 1).alias("id"), (F.col("at") + F.col("anchor")).alias("at"), lo.alias("lo"), last.alias("hi"))
    sides = asked.select("doc_id", F.col("at").alias("start"), F.explode(F.array(left, right)).alias("side"))
    sides = sides.select("doc_id", "start", "side.*", group_of).where("lo <= hi")
    open_repeats = repeated_windows(by_group, sides)
    repeats = judged.where("doc_id > first").select("doc_id", "at", "size", group_of).union(open_repeats.withColumn("grp", group_of))
    kept = by_group.cogroup(repeats.groupBy("grp")).applyInArrow(remove, RESULT)
    # copies of a text go whole, but for the first
    whole = F.coalesce((F.col("doc_id") > F.col("rep")) & (F.col("n_bytes") >= LENGTH), F.lit(False))
    cut_up = F.col("n_removed").isNotNull()
    return named.join(kept, ["doc_id", "key"], "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).when(cut_up, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).when(cut_up, F.col("n_spans")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).when(cut_up, F.col("kept_sha256")).otherwise(F.col("key")).alias("kept_sha256"),
    )


def op2_repeated_substrings(spark, sf_dir):
    from walkframe.llm.common import table

    return repeated_bytes_removed(table(spark, sf_dir, "documents"))


QUERIES = {"op2_repeated_substrings": op2_repeated_substrings}
ORACLE_SQL: dict[str, str] = {}

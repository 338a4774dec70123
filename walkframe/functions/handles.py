"""Handles: an oriented node (or path) as one integer, ``2 * id + is_reverse``. Pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode(node_id: Column | str, is_rev: Column | str) -> Column:
    """Handle of a node or path id and an orientation."""
    return F.shiftleft(col(node_id).cast("long"), 1).bitwiseOR(col(is_rev).cast("long"))


def id_of(handle: Column | str) -> Column:
    return F.shiftright(col(handle), 1)


def is_reverse(handle: Column | str) -> Column:
    return col(handle).bitwiseAND(1) == 1


def decode(handle: Column | str) -> Column:
    return F.struct(id_of(handle).alias("id"), is_reverse(handle).alias("is_rev"))


def flip(handle: Column | str) -> Column:
    return col(handle).bitwiseXOR(F.lit(1))


def orientation_name(is_rev: Column | str) -> Column:
    return F.when(col(is_rev), "reverse").otherwise("forward")


def position(node_id: Column | str, is_rev: Column | str, offset: Column | str) -> Column:
    """A place in the graph, ordered by node, orientation and offset."""
    return F.struct(col(node_id).alias("node_id"), col(is_rev).alias("is_rev"), col(offset).alias("offset"))


def edge_is_canonical(source: Column | str, target: Column | str) -> Column:
    """Of an edge and its mirror image, the one that goes up in node ids; loops need a forward end."""
    a, b = id_of(source), id_of(target)
    return F.when(is_reverse(source), (b > a) | ((b == a) & ~is_reverse(target))).otherwise(b >= a)


def path_is_canonical(first: Column | str, last: Column | str) -> Column:
    """By the end handles of a path; null ends (an empty path) are canonical."""
    same = is_reverse(first) == is_reverse(last)
    return F.coalesce(F.when(same, ~is_reverse(first)).otherwise(edge_is_canonical(first, last)), F.lit(True))


def reverse_path(handles: Column | str) -> Column:
    """The same walk from its other end: flipped handles in reverse order."""
    return F.reverse(F.transform(col(handles), flip))


def intersect(a_lo: Column | str, a_hi: Column | str, b_lo: Column | str, b_hi: Column | str) -> tuple[Column, Column]:
    """Common part of two half-open ranges; it may come out inverted, which is empty."""
    return F.greatest(a_lo, b_lo), F.least(a_hi, b_hi)

"""Sequences of nodes as text, and positions in them. Pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from walkframe.functions.handles import col, id_of, is_reverse

#: Bits of a tag that hold the offset in a node.
OFFSET_BITS = 10


def reverse_complement(seq: Column | str) -> Column:
    """Upper case; what isn't A, C, G or T becomes N."""
    return F.translate(F.reverse(F.regexp_replace(F.upper(col(seq)), "[^ACGT]", "N")), "ACGT", "TGCA")


def oriented(seq: Column | str, handle: Column | str) -> Column:
    """Sequence read along a handle; forward visits keep their bytes."""
    return F.when(is_reverse(handle), reverse_complement(seq)).otherwise(col(seq))


def step_suffix(name: Column | str, is_rev: Column | str) -> Column:
    """A step of a P line: ``name+`` or ``name-``."""
    return F.concat(col(name), F.when(col(is_rev), "-").otherwise("+"))


def step_prefix(name: Column | str, is_rev: Column | str) -> Column:
    """A step of a W line: ``>name`` or ``<name``."""
    return F.concat(F.when(col(is_rev), "<").otherwise(">"), col(name))


def tag(handle: Column | str, offset: Column | str) -> Column:
    """Node, orientation and offset in one integer; null where the offset needs more bits than there are."""
    fits = col(offset) < (1 << OFFSET_BITS)
    packed = F.shiftleft(id_of(handle), OFFSET_BITS + 1) + is_reverse(handle).cast("long") * (1 << OFFSET_BITS) + col(offset)
    return F.when(fits, packed)

"""Path names and sizes as text. Pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from walkframe.functions.handles import col

# Fixed value of the graph formats: the sample of paths that have a plain name only.
GENERIC_SAMPLE = "_gbwt_ref"


def name_or_id(name: Column | str, key: Column | str) -> Column:
    return F.coalesce(col(name), col(key).cast("string"))


def pansn_name(sample, haplotype, contig) -> Column:
    return F.concat_ws("#", col(sample), col(haplotype).cast("string"), col(contig))


def fragment_name(sample, haplotype, contig, fragment, end) -> Column:
    """``sample#haplotype#contig[fragment-end]``"""
    return F.concat(pansn_name(sample, haplotype, contig), F.lit("["), col(fragment).cast("string"), F.lit("-"), col(end).cast("string"), F.lit("]"))


def display_name(sample, haplotype, contig, fragment) -> Column:
    """Shortest form that keeps the name apart: contig, sample#contig, or all with ``@fragment``."""
    plain = (col(haplotype) == 0) & (col(fragment) == 0)
    full = F.concat(pansn_name(sample, haplotype, contig), F.lit("@"), col(fragment).cast("string"))
    return F.when(col(sample) == GENERIC_SAMPLE, col(contig)).when(plain, F.concat_ws("#", col(sample), col(contig))).otherwise(full)


def path_name(sample, contig, haplotype=0, fragment=0) -> Column:
    """A full path name as a struct; a reference path has haplotype and fragment 0."""
    whole = lambda c: (F.lit(c) if isinstance(c, int) else col(c)).cast("long")
    return F.struct(col(sample).alias("sample"), col(contig).alias("contig"), whole(haplotype).alias("haplotype"), whole(fragment).alias("fragment"))


def generic_name(contig) -> Column:
    """The full name of a plainly named path."""
    return path_name(F.lit(GENERIC_SAMPLE), contig)


def is_predecessor(fragment, other_fragment, *same: tuple) -> Column:
    """Whether a fragment is at or before another of the same haplotype."""
    ok = col(fragment) <= col(other_fragment)
    for a, b in same:
        ok = ok & (col(a) == col(b))
    return ok


def readable_size(n_bytes: Column | str) -> tuple[Column, Column]:
    """A number of bytes in the largest binary unit that it reaches, and that unit."""
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    value = col(n_bytes).cast("double")
    scaled, unit = value, F.lit(units[0])
    for i, name in enumerate(units[1:], 1):
        at_least = value >= float(1 << (10 * i))
        scaled = F.when(at_least, value / float(1 << (10 * i))).otherwise(scaled)
        unit = F.when(at_least, name).otherwise(unit)
    return scaled, unit

"""Byte codes of integers and runs, as column expressions over arrays.

Integers take seven bits a byte, low bits first, with the high bit set where more
follow. A run of ``value`` in an alphabet of ``sigma`` is one byte with room for
``256 div sigma`` lengths, followed by what is left of a longer one; from 255 values on
(or 0: unknown) it is two integers.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from walkframe.functions.handles import col


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def hex_of(value: Column) -> Column:
    """Hexadecimal bytes of one non-negative integer's code."""
    bits = F.length(F.bin(value))
    groups = F.ceil(bits / 7).cast("int")
    byte = lambda i: F.call_function("shiftright", value, i * 7).bitwiseAND(127) + F.when(i < groups - 1, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")


def encode_integers(values: Column | str) -> Column:
    """Binary code of an array of non-negative integers."""
    return F.unhex(F.array_join(F.transform(col(values), hex_of), ""))


def hex_of_run(value: Column, length: Column, sigma) -> Column:
    s = lit(sigma)
    short = F.when((s > 0) & (s < 255), F.floor(F.lit(256) / s))
    basic = lambda n: F.lpad(F.hex((value + s * (n - 1)).cast("long")), 2, "0")
    return (
        F.when(length == 0, "")
        .when(short.isNull(), F.concat(hex_of(value), hex_of(length - 1)))
        .when(length < short, basic(length))
        .otherwise(F.concat(basic(short), hex_of(length - short)))
    )


def encode_runs(runs: Column | str, sigma) -> Column:
    """Binary code of an array of ``(value, len)`` below ``sigma``; runs of length 0 leave nothing."""
    return F.unhex(F.array_join(F.transform(col(runs), lambda r: hex_of_run(r["value"], r["len"], sigma)), ""))


def bytes_of(code: Column | str) -> Column:
    """Array of the bytes of a binary."""
    text = F.hex(col(code))
    n = F.length(text) / 2
    at = F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))


def decode_integers(code: Column | str) -> Column:
    """Array of the integers of a code; a cut last one is left out."""
    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("shift"), F.array().cast("array<bigint>").alias("out"))

    def step(s, b):
        value = s["value"] + F.call_function("shiftleft", b.bitwiseAND(127), s["shift"])
        more = F.struct(value.alias("value"), (s["shift"] + 7).alias("shift"), s["out"].alias("out"))
        done = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("shift"), F.concat(s["out"], F.array(value)).alias("out"))
        return F.when(b >= 128, more).otherwise(done)

    return F.aggregate(bytes_of(code), start, step)["out"]


def decode_runs(code: Column | str, sigma) -> Column:
    """Array of ``(value, len)`` of a code; a cut last run is left out."""
    s = lit(sigma)
    short = F.floor(F.lit(256) / s)
    kind = "array<struct<value:bigint,len:bigint>>"
    start = F.struct(
        F.lit(-1).cast("long").alias("run"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("shift"), F.array().cast(kind).alias("out")
    )  # run: the value of a run whose length is still to come

    def state(run, value, shift, out):
        return F.struct(run.cast("long").alias("run"), value.cast("long").alias("value"), shift.cast("int").alias("shift"), out.alias("out"))

    def step(st, b):
        none = F.lit(-1)
        value = b % s
        n = F.floor(b / s) + 1
        whole = state(none, F.lit(0), F.lit(0), F.concat(st["out"], F.array(F.struct(value.alias("value"), n.cast("long").alias("len")))))
        begun = state(value, F.lit(0), F.lit(0), st["out"])
        rest = st["value"] + F.call_function("shiftleft", b.bitwiseAND(127), st["shift"])
        more = state(st["run"], rest, st["shift"] + 7, st["out"])
        ended = state(none, F.lit(0), F.lit(0), F.concat(st["out"], F.array(F.struct(st["run"].alias("value"), (rest + short).cast("long").alias("len")))))
        return F.when((st["run"] < 0) & (n < short), whole).when(st["run"] < 0, begun).when(b >= 128, more).otherwise(ended)

    small = F.aggregate(bytes_of(code), start, step)["out"]
    ints = decode_integers(code)
    pairs = F.floor(F.size(ints) / 2).cast("int")
    large = F.when(pairs > 0, F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: F.struct(F.get(ints, i * 2).alias("value"), (F.get(ints, i * 2 + 1) + 1).alias("len")))).otherwise(F.array().cast(kind))
    return F.when((s > 0) & (s < 255), small).otherwise(large)

"""Variable-byte coding of whole numbers: seven bits a byte, low bits first, the high bit set on the last byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that a 32-bit number takes at most; a longer run is invalid.
LONGEST = 5


def length(value: Column) -> Column:
    out = F.lit(LONGEST)
    for n in range(LONGEST - 1, 0, -1):
        out = F.when(value < (1 << 7 * n), n).otherwise(out)
    return out.cast("long")


def encode(value: Column) -> Column:
    """array<int> of the bytes of one number."""
    last = length(value) - 1
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: (F.call_function("shiftright", value.cast("long"), (i * 7).cast("int")).bitwiseAND(F.lit(127)) + F.when(i == last, 128).otherwise(0)).cast("int"))


def encode_all(values: Column) -> Column:
    """array<int> of the bytes of an array of numbers, one after another."""
    return F.flatten(F.transform(values, encode))


def decode_all(data: Column) -> Column:
    """The numbers of an array of bytes. A run over LONGEST bytes and an unfinished last number are errors."""
    state = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("shift"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        part = F.call_function("shiftleft", b.cast("long").bitwiseAND(F.lit(127)), s["shift"])
        value = s["value"] + F.when(s["shift"] < 7 * LONGEST, part).otherwise(F.raise_error(F.lit("a number takes too many bytes")).cast("long"))
        done = b >= 128
        return F.struct(F.when(done, F.lit(0).cast("long")).otherwise(value).alias("value"), F.when(done, F.lit(0)).otherwise(s["shift"] + 7).alias("shift"), F.when(done, F.concat(s["out"], F.array(value))).otherwise(s["out"]).alias("out"))

    return F.aggregate(data, state, step, lambda s: F.when(s["shift"] > 0, F.raise_error(F.lit("the last number has no end")).cast("array<bigint>")).otherwise(s["out"]))


def to_binary(data: Column) -> Column:
    """An array of bytes as a binary value."""
    return F.unhex(F.array_join(F.transform(data, lambda b: F.lpad(F.hex(b), 2, "0")), ""))

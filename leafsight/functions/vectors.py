"""Vectors as arrays; sums in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x).cast("float"))


def truncate(v: Column, size: int) -> Column:
    """The first `size` axes, of length one again."""
    return unit(F.slice(v, 1, size))


def hashed_encoder(tokens: Column, size: int = 64) -> Column:
    """Deterministic stand-in for a text encoder: signed counts of hashed terms, of length one."""
    slots = F.transform(tokens, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(size)).alias("i"), F.when(F.crc32(t.cast("binary")) % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    return unit(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(slots, F.lit(0.0), lambda a, x: a + F.when(x["i"] == i, x["s"]).otherwise(0.0))))

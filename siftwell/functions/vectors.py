"""Vectors as arrays, and numbers drawn from hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, first component first."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalized(v: Column) -> Column:
    """Unit length; a zero vector gives nulls."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm))


def minmax(value: Column, low: Column, high: Column) -> Column:
    """(value - low) / range, a zero range counting as 1."""
    return (value - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))


def hash_number(key: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of the md5 of a text as a whole number; the same in any engine."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, digits), 16, 10).cast("long")


def hash_embed(tokens: Column, dims: int = 32) -> Column:
    """A stand-in for a text model: signed counts of hashed tokens. Its scores mean nothing next to a model's."""
    slots = F.transform(tokens, lambda t: F.struct((hash_number(t) % dims).alias("at"), F.when(hash_number(t, 1) % 2 == 0, 1).otherwise(-1).alias("sign")))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(slots, lambda s: s["at"] == d), F.lit(0), lambda acc, s: acc + s["sign"]))

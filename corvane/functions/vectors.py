"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """over the shorter length; 0 for a zero vector."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    length = norm(a) * norm(b)
    return F.when(length == 0, 0.0).otherwise(dot(a, b) / length)


def resized(a: Column, dimension: int) -> Column:
    """cut or zero-padded to a dimension."""
    return F.slice(F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), dimension)), 1, dimension)


def sign_bits(a: Column) -> Column:
    """sign bits, first element highest, as unsigned 32-bit words."""
    bits = F.transform(a, lambda x: F.when(x > 0, 1).otherwise(0).cast("bigint"))
    words = F.sequence(F.lit(0), F.ceil(F.size(a) / 32).cast("int") - 1)
    return F.transform(words, lambda w: F.aggregate(F.slice(bits, w * 32 + 1, 32), F.lit(0).cast("bigint"), lambda acc, b: acc * 2 + b))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def token_hash(token: Column) -> Column:
    """F8: FNV-1a, 32 bits, over code units of ASCII text."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))

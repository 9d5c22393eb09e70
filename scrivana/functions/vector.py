"""Distances between vectors and between hashes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def cosine(a: Column, b: Column) -> Column:
    """Dot product over the shorter vector, magnitudes over whole vectors; 0 if either is a zero vector."""
    n = F.least(F.size(a), F.size(b))
    dot = _sum(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")))
    size = F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(_sum(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(size > 0, dot / size).otherwise(0.0)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hex hashes; 999 if one is missing or malformed."""
    number = lambda h: F.when(h.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(h, 16, -10).cast("long"))
    return F.coalesce(F.bit_count(number(a).bitwiseXOR(number(b))), F.lit(999))

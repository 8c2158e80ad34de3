"""Vectors as arrays: quantisation with one global scale, dot products, norms, sign codes. All in the JVM.

Blocks of many queries against many vectors use quarry.operators.vector_index, which multiplies matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantise(v: Column, scale: float) -> Column:
    """Components over scale, to the nearest whole number (half to even), cut to +-127. Never normalised again."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") / F.lit(scale)))).cast("tinyint"))


def dequantise(q: Column, scale: float) -> Column:
    return F.transform(q, lambda x: (x.cast("double") * F.lit(scale)).cast("float"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def int_dot(a: Column, b: Column) -> Column:
    """Exact for 8-bit components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def sign_code(v: Column, dims: int) -> Column:
    """Sign bits, 63 to a number (so that none is negative): bit i is set where component i > 0."""
    words = []
    for lo in range(0, dims, 63):
        part = F.slice(v, lo + 1, min(63, dims - lo))
        words.append(F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s * 2 + (x > 0).cast("long")))
    return F.array(*words)


def hamming_score(a: Column, b: Column, dims: int) -> Column:
    """dims less the number of differing signs."""
    return F.lit(dims) - F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)

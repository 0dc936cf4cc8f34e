"""Vector functions as column expressions, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreforge.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def unit(a: Column) -> Column:
    """Length 1; a zero vector stays."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n)))


def quantise(a: Column) -> Column:
    """struct(q array<tinyint>, scale): unit vector over scale, where scale is
    the largest part / 127, rounded half away from zero."""
    part = lambda x, scale: F.when(scale == 0, 0).otherwise(F.round(x / scale)).cast("tinyint")
    parts = lambda u, scale: F.struct(F.transform(u, lambda x: part(x, scale)).alias("q"), scale.alias("scale"))
    # a value that a lambda names is made once a row, not once an element
    return let(unit(a), lambda u: let(F.array_max(F.transform(u, F.abs)) / 127, lambda scale: parts(u, scale)))


def dequantise(z: Column) -> Column:
    """The vector that a quantise() struct stands for."""
    # named, or the struct would be made anew for each element
    return let(z, lambda s: F.transform(s["q"], lambda x: x.cast("double") * s["scale"]))


def legacy_vector(blob: Column, dim: int) -> Column:
    """A vector stored as little-endian 32-bit floats; null if the blob has
    another length than dim of them."""
    b = F.hex(blob)

    def one(i: Column) -> Column:
        byte = lambda j: F.substring(b, i * 8 + 2 * j + 1, F.lit(2))
        n = F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("long")
        sign = F.when(n >= 2**31, -1.0).otherwise(1.0)
        exp, frac = F.floor(n / 2**23) % 256, n % 2**23
        value = F.when(exp == 0, frac / 2.0**23 * 2.0**-126).otherwise((1 + frac / 2.0**23) * F.pow(F.lit(2.0), exp - 127))
        return F.when(exp == 255, F.lit(None).cast("double")).otherwise(sign * value)

    return F.when(F.octet_length(blob) == 4 * dim, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one))

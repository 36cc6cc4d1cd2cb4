"""Scalar encodings of vectors as Column expressions: 8-bit, half precision, sign bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import metrics


def int8_scale(vec: Column) -> Column:
    """The step of the symmetric 8-bit code: the largest magnitude over 127."""
    return F.array_max(F.transform(vec.cast("array<double>"), lambda x: F.abs(x))) / 127


def int8_encode(vec: Column) -> Column:
    """round(x * 127 / max|x|), half away from zero, within -127 and 127; zeros for a zero vector."""
    scale = int8_scale(vec)
    step = F.when(scale == 0, F.lit(1.0)).otherwise(scale)
    code = lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x / step)))
    return F.transform(vec.cast("array<double>"), lambda x: code(x).cast("tinyint"))


def int8_decode(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: c.cast("double") * scale)


def fp16_round(vec: Column) -> Column:
    """Each element as half precision holds it, by arithmetic; for magnitudes up to 65504."""

    def half(x: Column) -> Column:
        size = F.abs(x)
        exponent = F.greatest(F.floor(F.log2(F.when(size == 0, F.lit(1.0)).otherwise(size))), F.lit(-14)) - 10
        unit = F.pow(F.lit(2.0), exponent.cast("double"))
        return F.when(size == 0, F.lit(0.0)).otherwise(F.rint(x / unit) * unit)

    return F.transform(vec.cast("array<double>"), half)


def binary_encode(vec: Column) -> Column:
    """Signs (1 for x >= 0) packed into 64-bit words, element i at bit i mod 64 of word i div 64."""
    words = F.sequence(F.lit(0), F.floor((F.size(vec) - 1) / 64).cast("int"))

    def pack(w: Column) -> Column:
        part = F.slice(vec, w * 64 + 1, 64)
        bits = F.transform(part, lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(b))

    return F.transform(words, pack)


def binary_decode(bits: Column, dims: int, norm: Column) -> Column:
    """The sign pattern scaled to the vector's norm: an approximation."""
    size = norm / F.sqrt(F.lit(float(dims)))
    sign = lambda i: F.call_function("shiftright", F.element_at(bits, F.floor(i / 64).cast("int") + 1), (i % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.when(sign(i) == 1, size).otherwise(-size))


def binary_columns(vec: Column) -> tuple[Column, Column]:
    """The code and the norm that a binary index stores."""
    return binary_encode(vec), metrics.norm(vec)

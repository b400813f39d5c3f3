"""Buckets, sketches and means as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Samples up to this size count as zero in a relative-error sketch (fixed value).
SKETCH_ZERO = 1e-18


def log2_bucket(x: Column) -> Column:
    """Power-of-two bucket of a non-negative integer, 0 for 0: the number of binary digits less one."""
    return F.greatest(F.lit(0), F.length(F.bin(x.cast("bigint"))) - 1)


def percent_bucket(share: Column) -> Column:
    """4 % steps; all from 128 % on share the last (124 % to 128 %)."""
    return F.floor(F.when(share >= 1.28, F.lit(1.24)).otherwise(share) / 0.04 + F.lit(1e-9)).cast("int")


def linear_bucket(x: Column, low: float, high: float, steps: int = 31) -> Column:
    """Equal steps between the bounds; below is the first, from ``high`` on one more than the last."""
    return F.when(x < low, 0).when(x >= high, steps).otherwise(F.floor((x - low) * steps / (high - low))).cast("int")


def sketch_gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def sketch_bucket(x: Column, error: float) -> Column:
    """Index of a sample's bucket; null for samples that count as zero."""
    return F.when(x > SKETCH_ZERO, F.ceil(F.ln(x) / math.log(sketch_gamma(error)))).cast("int")


def sketch_value(bucket: Column, error: float) -> Column:
    """The value that stands for a bucket, within ``error`` of all its samples."""
    g = sketch_gamma(error)
    return F.lit(2.0) * F.pow(F.lit(g), bucket) / (1 + g)


def geometric_mean(x: Column) -> Column:
    """An aggregate: exp(mean(log(1 + |x|))) - 1."""
    return F.exp(F.avg(F.log1p(F.abs(x)))) - 1


def interleave(x: Column, y: Column, bits: int = 31) -> Column:
    """Z-order: the bits of x at odd places, those of y at even ones."""
    if not 0 < bits <= 31:
        raise ValueError("at most 31 bits of each go into a bigint")
    out = F.lit(0).cast("bigint")
    for k in range(bits):
        for c, shift in ((x, 2 * k + 1), (y, 2 * k)):
            bit = F.shiftright(c.cast("bigint"), k).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, shift))
    return out


def unlace(z: Column, odd: bool, bits: int = 31) -> Column:
    """One coordinate of a z-order value."""
    out = F.lit(0).cast("bigint")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(z, 2 * k + int(odd)).bitwiseAND(F.lit(1)), k))
    return out

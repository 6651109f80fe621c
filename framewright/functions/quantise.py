"""Sample and weight quantisation as column expressions. Values are clamped before they are cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def _clamp(x: Column, limit: float) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), x.cast("double")))


def half_away(x: Column) -> Column:
    """Rounds halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def pcm16_truncated(x: Column) -> Column:
    """Clamp to 0.99, times 32767, towards zero."""
    return (_clamp(x, 0.99) * 32767).cast("int")


def pcm16_half_up(x: Column) -> Column:
    """Clamp to 0.99, times 32767, halves upwards."""
    return F.floor(_clamp(x, 0.99) * 32767 + 0.5).cast("int")


def pcm16_half_away(x: Column) -> Column:
    """Clamp to 1, times 32767, halves away from zero."""
    return half_away(_clamp(x, 1.0) * 32767).cast("int")


def pcm16_asymmetric(x: Column) -> Column:
    """Clamp to 1, negative values times 32768 and others times 32767, halves away from zero."""
    y = _clamp(x, 1.0)
    return half_away(F.when(y < 0, y * 32768).otherwise(y * 32767)).cast("int")


def pcm16_to_float(sample: Column, divisor: int = 32767) -> Column:
    return sample.cast("double") / F.lit(float(divisor))


def pcm24_to_float(b0: Column, b1: Column, b2: Column) -> Column:
    """Three little-endian bytes (0 .. 255) as a signed sample."""
    raw = b0 + b1 * 256 + b2 * 65536
    return F.when(raw >= 8388608, raw - 16777216).otherwise(raw).cast("double") / F.lit(8388608.0)


def _usable(top: Column) -> Column:
    return (top > 0) & (top < F.lit(float("inf"))) & ~F.isnan(top)


def _top(row: Column) -> Column:
    return F.array_max(F.transform(row, lambda x: F.abs(x.cast("double"))))


def symmetric_scale(row: Column, limit: int) -> Column:
    """max |x| / limit over an array; 1 for a row that is all zeros or isn't finite."""
    return let(_top(row), lambda top: F.when(_usable(top), top / F.lit(float(limit))).otherwise(F.lit(1.0)))


def symmetric_row(row: Column, limit: int, half_even: bool) -> Column:
    """array<int> of an array's values by its own scale: half to even (int8 weights) or half away from zero (int16 inputs)."""
    rounded = (lambda x: F.rint(x)) if half_even else half_away

    def scaled(scale):
        one = lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.nanvl(rounded(x.cast("double") / scale), F.lit(0.0)).cast("int")))
        return F.when(scale > 0, F.transform(row, one)).otherwise(F.transform(row, lambda x: F.lit(0)))

    # A row that isn't finite has scale 0 here and becomes zeros; one of zeros has scale 1.
    return let(let(_top(row), lambda top: F.when(_usable(top), top / F.lit(float(limit))).when(top == 0, F.lit(1.0)).otherwise(F.lit(0.0))), scaled)


def whole_dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays of whole numbers, as a long; the shorter one's length counts."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def dequantised(dot: Column, input_scale: Column, row_scale: Column, bias: Column) -> Column:
    """A whole-number dot product as a value again: bias + dot * input scale * row scale, each step in single precision."""
    one = lambda x: x.cast("float")
    return one(one(bias) + one(one(one(dot) * one(input_scale)) * one(row_scale)))


def erf(x: Column) -> Column:
    """The error function: exp(-x^2) times a series of positive terms, so that nothing cancels; beyond 6 it is 1."""

    def series(y):
        start = F.struct(y.alias("term"), y.alias("total"))
        grow = lambda s, n: let(s["term"] * 2 * y * y / (2 * n + 1), lambda t: F.struct(t.alias("term"), (s["total"] + t).alias("total")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, grow)["total"] * F.exp(-y * y) * F.lit(1.1283791670955126)

    return F.when(F.abs(x) > 6, F.signum(x)).otherwise(let(x.cast("double"), series))


def gelu(x: Column) -> Column:
    """x times the normal distribution function of x."""
    return x * F.lit(0.5) * (erf(x / F.lit(2.0**0.5)) + 1)


def quantise_logit(x: Column, step: float) -> Column:
    """To a multiple of ``step``; halves go down. Values that aren't finite stay."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(x / F.lit(step) + F.lit(0.5 - 2.0**-40)) * F.lit(step))


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(F.lit(alpha) * F.expm1(x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))

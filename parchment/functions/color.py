"""Colours and tint functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(x: Column) -> Column:
    """Clamp to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def to255(x: Column) -> Column:
    """Unit value to a byte, half rounded up."""
    return F.floor(unit(x) * 255 + 0.5).cast("int")


def mul255(a: Column, b: Column) -> Column:
    """Product of two bytes as fractions of 255, rounded."""
    t = a * b + 128
    return F.shiftright((t + F.shiftright(t, 8)).cast("int"), 8)


def over(src: Column, dst: Column, alpha: Column) -> Column:
    """Source over destination: bytes mixed by a byte of coverage."""
    return mul255(src, alpha) + mul255(dst, 255 - alpha)


def gray_of_rgb(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def rgb_of_cmyk(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, Column, Column]:
    """Additive black: each channel is 1 - min(1, ink + black)."""
    one = lambda x: 1.0 - F.least(F.lit(1.0), unit(x) + unit(k))
    return one(c), one(m), one(y)


def css(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of three unit values."""
    hexed = lambda x: F.lower(F.lpad(F.hex(to255(x)), 2, "0"))
    return F.concat(F.lit("#"), hexed(r), hexed(g), hexed(b))


def exponential(x: Column, c0: float, c1: float, n: float) -> Column:
    """Type 2 function on the domain 0..1; an exponent of 0 counts as 1."""
    return c0 + F.pow(unit(x), F.lit(float(n or 1))) * (c1 - c0)


def stitched(x: Column, bounds: list[float], parts: list[tuple[float, float, float]]) -> Column:
    """Type 3 function on 0..1: each part is an exponential over its own stretch, encoded to 0..1."""
    x = unit(x)
    edges = [0.0, *bounds, 1.0]
    out = None
    for i in reversed(range(len(parts))):
        low, high = edges[i], edges[i + 1]
        value = exponential((x - low) / (high - low) if high > low else F.lit(0.0), *parts[i])
        out = value if out is None else F.when(x < high, value).otherwise(out)
    return out


def separation_gray(tints: list[Column]) -> Column:
    """Gray of a separation colour whose tint transform is not used."""
    return 1.0 - unit(F.greatest(*tints) if len(tints) > 1 else tints[0])


def decoded_sample(raw: Column, bits: int, low: float, high: float) -> Column:
    """A sample of an image mapped by its Decode pair to a byte."""
    return to255(low + raw * (high - low) / float((1 << bits) - 1))

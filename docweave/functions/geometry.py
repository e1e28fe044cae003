"""Integer geometry of frames, pictures and charts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _wide(x: Column) -> Column:
    """A whole number of up to 19 digits, wide enough to be multiplied without overflow."""
    return x.cast("decimal(19,0)")


def whole(a: Column, b: Column) -> Column:
    """a div b for whole numbers, exact also where ``a`` is a product of two 64-bit numbers; null where b is 0."""
    divisor = b.cast("decimal(38,0)")
    return F.call_function("div", a.cast("decimal(38,0)"), F.when(divisor != 0, divisor))


def contain(sw: Column, sh: Column, width: Column, height: Column) -> Column:
    """The largest frame of a picture's shape inside width x height, centred: x, y, w, h."""
    sw, sh, width, height = map(_wide, (sw, sh, width, height))
    wide = sw * height > width * sh
    w = F.when(wide, width.cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), whole(height * sw, sh)))
    h = F.when(wide, F.greatest(F.lit(1).cast("long"), whole(width * sh, sw))).otherwise(height.cast("long"))
    half = lambda x: whole(x, F.lit(2))
    return F.struct(half(width - w).alias("x"), half(height - h).alias("y"), w.alias("w"), h.alias("h"))


def cover_crop(sw: Column, sh: Column, width: Column, height: Column) -> Column:
    """What each side loses, in 1/100 000, when a picture covers width x height: horizontal, vertical; at most 49 999."""
    sw, sh, width, height = map(_wide, (sw, sh, width, height))
    # products of pixels (32 bits) and slide units (64 bits) times 100 000 stay below 38 digits
    a, b = ((x * y).cast("decimal(32,0)") for x, y in ((sw, height), (sh, width)))
    parts = F.lit(100_000).cast("decimal(6,0)")
    side = lambda lost, total: F.least(F.lit(49_999).cast("long"), whole(lost.cast("decimal(32,0)") * parts + total, total * F.lit(2).cast("decimal(1,0)")))
    none = F.lit(0).cast("long")
    return F.struct(F.when(a > b, side(a - b, a)).otherwise(none).alias("horizontal"), F.when(b > a, side(b - a, b)).otherwise(none).alias("vertical"))


def line_height(size: Column, unit: int = 12_700) -> Column:
    """Height of a line of a font size (in 1/100 pt): six fifths of it."""
    return whole(whole(size * unit, F.lit(100)) * 6, F.lit(5))


def png_size(content: Column) -> Column:
    """Width and height of a PNG from its header, or null."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def mix_channel(a: Column, b: Column, percent: Column) -> Column:
    """A colour channel ``percent`` of the way from a to b, rounded half up."""
    return whole(a * (100 - percent) + b * percent + 50, F.lit(100))

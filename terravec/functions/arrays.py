"""Array (vector) expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12
COSINE_FLOOR = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def array_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(x: Column, y: Column) -> Column:
    return array_sum(F.zip_with(x, y, lambda a, b: a * b))


def norm(v: Column) -> Column:
    return F.sqrt(array_sum(F.transform(v, lambda x: x * x)))


def divided(v: Column, by: Column) -> Column:
    """Each entry by a scalar; the scalar is taken into the array once, so that it isn't computed for each entry."""
    return F.flatten(F.transform(F.array(by), lambda d: F.transform(v, lambda x: x / d)))


def l2_normalize(v: Column) -> Column:
    return divided(v, F.greatest(norm(v), F.lit(NORM_FLOOR)))


def center_normalize(v: Column, mean: Column) -> Column:
    """Normalise, subtract the mean vector, normalise."""
    return l2_normalize(F.zip_with(l2_normalize(v), mean, lambda a, b: a - b))


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / (F.greatest(norm(x), F.lit(COSINE_FLOOR)) * F.greatest(norm(y), F.lit(COSINE_FLOOR)))


def l0(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x != 0))


def count_positive(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x > 0))


def scale_bands(bands: Column, is_int: Column) -> Column:
    """array<array<double>>: by 10000 if stored as integers or above 10; 12 bands get a zero plane at index 10."""
    peak = F.array_max(F.transform(bands, lambda b: F.array_max(b)))
    by = F.when(is_int | (peak > 10), F.lit(10000.0)).otherwise(F.lit(1.0))
    scaled = F.flatten(F.transform(F.array(by), lambda d: F.transform(bands, lambda b: F.transform(b, lambda x: x / d))))
    zero = F.array(F.transform(F.element_at(scaled, 1), lambda x: x * 0.0))
    return F.when(F.size(bands) == 12, F.concat(F.slice(scaled, 1, 10), zero, F.slice(scaled, 11, 2))).otherwise(scaled)


def rgb_bytes(scaled: Column) -> Column:
    """Bands 3, 2, 1 of scaled bands, clipped to [0, 1], as whole numbers to 255 (truncated)."""
    byte = lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return F.array(*(F.transform(F.get(scaled, F.lit(k)), byte) for k in (3, 2, 1)))


def strip_cls(tokens: Column) -> Column:
    """1 + s*s tokens lose the first one; s*s stay."""
    side = F.floor(F.sqrt(F.size(tokens).cast("double")) + 1e-9)
    return F.when(side * side == F.size(tokens), tokens).otherwise(F.slice(tokens, 2, F.size(tokens)))


def clip_box(cx: Column, cy: Column, side: Column, width: Column, height: Column) -> Column:
    """struct(x, y, w, h): a square centred on (cx, cy) (half to even), shifted to stay inside the image."""
    s = F.least(F.greatest(side, F.lit(1)), width, height).cast("int")
    place = lambda c, most: F.greatest(F.lit(0), F.least((F.bround(c, 0) - F.floor(s / 2)).cast("int"), (most - s).cast("int")))
    return F.struct(place(cx, width).alias("x"), place(cy, height).alias("y"), s.alias("w"), s.alias("h"))

"""Lookups of points in raster tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravec.functions import encodings
from terravec.operators.shared import cut, lookup


#: Pixels of a block's side (without the overlap); bytes of blocks that are broadcast at most.
BLOCK, BROADCAST_BYTES = 32, 64 << 20


def raster_blocks(raster: DataFrame, height: int, width: int, block: int = BLOCK) -> DataFrame:
    """(br, bc, pixels): blocks of raster (row, col, values), each with the first row and column of its neighbours; pixels lie row
    by row, (block + 1) in each, and are null where the raster has none. A NaN or null value counts 0."""
    clean = raster.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).select("row", "col", F.transform("values", lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v)).alias("values"))
    at = lambda c: F.floor(F.col(c) / block)
    own = lambda c: F.when((F.col(c) % block == 0) & (F.col(c) > 0), F.array(at(c), at(c) - 1)).otherwise(F.array(at(c)))
    dealt = clean.withColumn("br", F.explode(own("row"))).withColumn("bc", F.explode(own("col")))
    place = (F.col("row") - F.col("br") * block) * (block + 1) + F.col("col") - F.col("bc") * block
    dealt = dealt.select("br", "bc", place.cast("int").alias("place"), "values")
    every = dealt.select("br", "bc").distinct().withColumn("place", F.explode(F.sequence(F.lit(0), F.lit((block + 1) ** 2 - 1))))
    listed = F.sort_array(F.collect_list(F.struct("place", "values")))
    return every.join(dealt, ["br", "bc", "place"], "left").groupBy("br", "bc").agg(F.transform(listed, lambda p: p["values"]).alias("pixels"))


def raster_lookup(points: DataFrame, raster: DataFrame, height: int, width: int, nan_coords: float | None = None, *, key: str = "point_id", x: str = "x", y: str = "y", block: int = BLOCK) -> DataFrame:
    """(key, values): bilinear blend of the four pixels around points in [-1, 1] x [-1, 1], y upwards, of raster
    (row, col, values array<double>); a NaN pixel counts 0, and a missing one too. nan_coords: what a NaN coordinate becomes in
    [0, 1]. Points outside, or with none of their pixels there, are left out.

    All four pixels of a point are in one block, so each point is one row that meets one row. Small rasters are broadcast; a block
    that many points fall into isn't one task.
    """
    fx, fy = (F.col(x) + 1) / 2.0, 1 - (F.col(y) + 1) / 2.0
    if nan_coords is not None:
        fx, fy = F.when(F.isnan(fx), nan_coords).otherwise(fx), F.when(F.isnan(fy), nan_coords).otherwise(fy)
    p = points.select(key, (fx * (width - 1)).alias("px"), (fy * (height - 1)).alias("py"))
    p = p.withColumns({"c0": F.floor("px").cast("int"), "r0": F.floor("py").cast("int")}).filter(F.col("c0").between(0, width - 1) & F.col("r0").between(0, height - 1))
    p = p.select(key, (F.col("px") - F.col("c0")).alias("dx"), (F.col("py") - F.col("r0")).alias("dy"), "r0", "c0", F.floor(F.col("r0") / block).alias("br"), F.floor(F.col("c0") / block).alias("bc"))
    blocks = cut(raster_blocks(raster, height, width, block))
    small = blocks.agg(F.coalesce(F.sum(F.aggregate("pixels", F.lit(0).cast("long"), lambda s, v: s + 8 * F.greatest(F.size(v), F.lit(1)))), F.lit(0))).first()[0] <= BROADCAST_BYTES
    met = p.join(F.broadcast(blocks), ["br", "bc"]) if small else lookup(p, blocks, ["br", "bc"])
    row, col = F.col("r0") - F.col("br") * block, F.col("c0") - F.col("bc") * block
    down, right = F.when(F.col("r0") < height - 1, 1).otherwise(0), F.when(F.col("c0") < width - 1, 1).otherwise(0)
    pixel = lambda r, c: F.get("pixels", (r * (block + 1) + c).cast("int"))
    dx, dy = F.col("dx"), F.col("dy")
    four = [(pixel(row, col), (1 - dx) * (1 - dy)), (pixel(row, col + right), dx * (1 - dy)), (pixel(row + down, col), (1 - dx) * dy), (pixel(row + down, col + right), dx * dy)]
    met = met.select(key, *(v.alias(f"v{i}") for i, (v, _) in enumerate(four)), *(w.alias(f"w{i}") for i, (_, w) in enumerate(four)))
    bands = F.greatest(*(F.size(f"v{i}") for i in range(4)))
    blend = lambda k: sum((F.coalesce(F.get(f"v{i}", k), F.lit(0.0)) * F.col(f"w{i}") for i in range(4)), F.lit(0.0))
    return met.filter(bands > 0).select(key, F.transform(F.sequence(F.lit(0), bands - 1), blend).alias("values"))


def harmonics_discretized(points: DataFrame, degree: int, key: str = "point_id") -> DataFrame:
    """(key, v): analytic harmonics on the 360 x 180 grid of evenly spaced longitudes and latitudes, ends included, at the floor and
    the ceiling pixel, weighted (1-fx)(1-fy) and fx(1-fy). They depend on the pixel alone, so no table is joined."""
    x, y = F.col("lon") + 180, F.col("lat") + 90
    clamp = lambda v, n: F.least(F.greatest(v.cast("int"), F.lit(0)), F.lit(n - 1))
    at = lambda r, c: encodings.spherical_harmonics_analytic(-180 + r * F.lit(360.0) / 359, -90 + c * F.lit(180.0) / 179, degree)
    p = points.select(key, (x - F.floor(x)).alias("fx"), (y - F.floor(y)).alias("fy"), at(clamp(F.floor(x), 360), clamp(F.floor(y), 180)).alias("y0"), at(clamp(F.ceil(x), 360), clamp(F.ceil(y), 180)).alias("y1"))
    p = p.withColumns({"w0": (1 - F.col("fx")) * (1 - F.col("fy")), "w1": F.col("fx") * (1 - F.col("fy"))})
    return p.select(key, F.zip_with("y0", "y1", lambda a, b: a * F.col("w0") + b * F.col("w1")).alias("v"))

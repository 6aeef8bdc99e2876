"""Point sets: draws on the sphere, grids, filters by polygon, exact samples and splits.

Every draw is a function of (key, seed), so it doesn't depend on partitioning; samplers order by a hash of the key, or by an
order column that the caller gives.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravec.functions import geo
from terravec.operators.polygons import EdgeIndex, edge_index, regions_of
from terravec.operators.shared import cut

RING = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
POLYGONS = T.StructType([T.StructField("region", T.StringType()), T.StructField("rings", T.ArrayType(RING))])
SEED = 42


#: (key, number of the draw) -> a column in [0, 1).
Draw = Callable[[Column, int], Column]
#: Up to so many first rows are taken by one task from each partition's own; more are cut by ranks.
TAKE = 10_000


def uniform(key: Column, seed: int, salt: int = 0) -> Column:
    """In [0, 1), from the upper 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(salt)), 11).cast("double") / float(1 << 53)


def seeded(seed: int) -> Draw:
    return lambda key, salt: uniform(key, seed, salt)


def keyed_order(key: str, seed: int = SEED) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def drop_bad_coords(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows whose coordinates are there and no NaN."""
    return df.dropna(subset=[lon, lat]).filter(~F.isnan(lon) & ~F.isnan(lat))


def swap_axes(lon: Column, lat: Column, lon_first: bool) -> Column:
    return F.array(lon, lat) if lon_first else F.array(lat, lon)


def polygons_from(spark: SparkSession, shapes: dict[str, list[list[tuple[float, float]]]]) -> DataFrame:
    """Regions with rings of (lon, lat), closed where they aren't; holes are rings like any other."""
    close = lambda r: r if r[0] == r[-1] else [*r, r[0]]
    return spark.createDataFrame([(name, [close(r) for r in rings]) for name, rings in shapes.items()], POLYGONS)


def assign_regions(points: DataFrame, polygons: DataFrame | EdgeIndex) -> DataFrame:
    """points with region, one row for each region that strictly holds the point; see ``polygons``. An index made before serves
    several sets of points."""
    return regions_of(points, polygons if isinstance(polygons, EdgeIndex) else edge_index(polygons))


def points_within(points: DataFrame, polygons: DataFrame | EdgeIndex) -> DataFrame:
    """Points strictly inside the union of polygons (regions that don't overlap each other), boundary points out."""
    return regions_of(points, polygons if isinstance(polygons, EdgeIndex) else edge_index(polygons, whole=True)).drop("region")


def select_regions(polygons: DataFrame, names: list[str], merged: str | None = None) -> DataFrame:
    """Polygons by name; with ``merged``, their rings as one region of that name."""
    some = polygons.filter(F.col("region").isin(names))
    return some if merged is None else some.agg(F.lit(merged).alias("region"), F.flatten(F.collect_list("rings")).alias("rings"))


def on_sphere(u: Column, v: Column, lat_range: tuple[float, float] = (-90.0, 90.0)) -> tuple[Column, Column]:
    """(lon, lat) of two uniform draws: longitude even, latitude the arcsine of an even draw between two sines."""
    lo, hi = F.sin(F.radians(F.lit(lat_range[0]))), F.sin(F.radians(F.lit(lat_range[1])))
    return u * 360 - 180, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), lo + v * (hi - lo)))))


def sphere_points(spark: SparkSession, draws: int, seed: int = SEED, lat_range: tuple[float, float] = (-90.0, 90.0), start: int = 0, draw: Draw | None = None) -> DataFrame:
    """draw_id, lon, lat: uniform on the sphere between two latitudes."""
    d, of = spark.range(start, start + draws).withColumnRenamed("id", "draw_id"), draw or seeded(seed)
    lon, lat = on_sphere(of(F.col("draw_id"), 0), of(F.col("draw_id"), 1), lat_range)
    return d.select("draw_id", lon.alias("lon"), lat.alias("lat"))


def union_draws(spark: SparkSession, polygons: DataFrame, n: int, seed: int = SEED, oversample: int = 10, max_rounds: int = 20, draw: Draw | None = None) -> DataFrame:
    """Ranges of draws, appended until n are within the polygons: the first n of them in draw order. Each range is checkpointed and
    counted once."""
    found, start, have, index = None, 0, 0, edge_index(polygons, whole=True)
    for _ in range(max_rounds):
        some = cut(points_within(sphere_points(spark, n * oversample, seed, start=start, draw=draw), index))
        found = some if found is None else found.unionByName(some)
        start, have = start + n * oversample, have + some.count()
        if have >= n:
            return take_first(found, n)
    raise ValueError(f"fewer than {n} of {start} draws are within the polygons")


def take_first(df: DataFrame, n: int, order: str = "draw_id") -> DataFrame:
    """The first n rows by a key."""
    return _first(df, n, F.col(order), order)


def _first(df: DataFrame, n: int, order: Column, key: str) -> DataFrame:
    """The first n rows by (order, key). Beyond TAKE, no task gathers them: their ranks are cut at n."""
    if n <= TAKE:
        return df.withColumn("_o", order).orderBy("_o", key).limit(n).drop("_o")
    return ranked_by(df, order, key).filter(F.col("_rank") < n).drop("_rank")


def grid_in_polygon(polygons: DataFrame, step: float = 0.5) -> DataFrame:
    """region, lon, lat: the points of a regular grid from the bounds' minimum that are strictly inside; a region that holds
    none gets the centroid of its first ring."""
    ring = F.flatten("rings")
    b = polygons.select("region", geo.ring_bounds(ring).alias("b"), geo.ring_centroid(F.element_at("rings", 1)).alias("c"))
    axis = lambda lo, hi: F.transform(F.sequence(F.lit(0), F.ceil((hi - lo) / step).cast("int")), lambda k: lo + k * F.lit(step))
    g = b.select(F.col("region").alias("own"), F.explode(axis(F.col("b.x0"), F.col("b.x1"))).alias("lon"), F.col("b").alias("b")).select("own", "lon", F.explode(axis(F.col("b.y0"), F.col("b.y1"))).alias("lat"))
    hits = assign_regions(g, polygons).filter("own = region").select("region", "lon", "lat")
    none = b.join(hits.select("region").distinct(), "region", "left_anti").select("region", F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"))
    return hits.unionByName(none)


def coord_grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """row, col, lon (-180 to 180), lat (90 to -90), ends included, row by row."""
    g = spark.range(height * width).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    return g.select("row", "col", (-180 + F.col("col") * 360.0 / (width - 1)).alias("lon"), (90 - F.col("row") * 180.0 / (height - 1)).alias("lat"))


def coord_grid_of_split(grid: DataFrame, splits: DataFrame, split: int) -> DataFrame:
    """The grid's points whose cell is of one split."""
    return grid.join(splits.filter(F.col("split") == split).select("row", "col"), ["row", "col"])


def checkerboard_split(mask: DataFrame, cell_size: int, train_amount: float = 1.0, seed: int = SEED, order: Column | None = None) -> DataFrame:
    """row, col, split: blocks of even index sum 2 (test), others 1 (train), masked 0; floor(n (1 - train_amount)) train cells
    become 0, by the order column."""
    i, j = F.floor(F.col("row") / cell_size), F.floor(F.col("col") / cell_size)
    s = mask.withColumn("split", F.when(F.col("valid") == 0, 0).when(F.pmod(i + j, F.lit(2)) == 0, 2).otherwise(1))
    if train_amount >= 1.0:
        return s.select("row", "col", "split")
    s = s.withColumn("_o", F.xxhash64("row", "col", F.lit(seed)) if order is None else order)
    train = s.filter("split = 1")
    out = sample_n(train.withColumn("_key", F.struct("row", "col")), int(train.count() * (1.0 - train_amount)), "_key", order=F.col("_o")).select("row", "col", F.lit(True).alias("_out"))
    return s.join(out, ["row", "col"], "left").select("row", "col", F.when(F.col("_out"), 0).otherwise(F.col("split")).alias("split"))


def random_locations(spark: SparkSession, n: int, kind: str = "uniform", seed: int = SEED, draw: Draw | None = None) -> DataFrame:
    """id, x, y in [-1, 1]: uniform in the square, or on the sphere."""
    of = draw or seeded(seed)
    u, v = of(F.col("id"), 0), of(F.col("id"), 1)
    return spark.range(n).select("id", *located_draw(u, v, kind))


def located_draw(u: Column, v: Column, kind: str) -> tuple[Column, Column]:
    if kind == "uniform":
        return (u * 2 - 1).alias("x"), (v * 2 - 1).alias("y")
    if kind == "spherical":
        return (u * 2 - 1).alias("x"), (1 - 2 * F.acos(2 * v - 1) / geo.PI).alias("y")
    raise ValueError(f"unknown kind: {kind}")


def jitter_points(points: DataFrame, key: str = "point_id", radius: float = 0.01, seed: int = SEED, draws: tuple[Column, Column] | None = None) -> DataFrame:
    """Adds a uniform draw times radius to each coordinate."""
    u, v = draws or (uniform(F.col(key), seed, 0), uniform(F.col(key), seed, 1))
    return points.withColumns({"lon": F.col("lon") + u * radius, "lat": F.col("lat") + v * radius})


def rbf_anchors(points: DataFrame, n: int, key: str = "point_id", seed: int = SEED, order: Column | None = None) -> DataFrame:
    """n anchors among the points; drawn with replacement if there are fewer."""
    have = points.count()
    if have >= n:
        return sample_n(points, n, key, seed, order)
    if not have:
        return points
    ranked = ranked_by(points, F.xxhash64(key, F.lit(seed)) if order is None else order, key)
    draws = points.sparkSession.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(have)).alias("_rank"))
    return draws.join(ranked, "_rank").drop("_rank")


def relative_anchors(n: int, radius: float, seed: int = SEED, draws: np.ndarray | None = None) -> list[tuple[float, float]]:
    """The origin first, then uniform draws within the radius of either axis; draws: (n - 1, 2) numbers in [0, 1)."""
    u = np.random.default_rng(seed).random((n - 1, 2)) if draws is None else np.asarray(draws, dtype=float)
    return [(0.0, 0.0), *map(tuple, ((2 * u - 1) * radius).tolist())]


def rff_params(n: int, sigma: float, seed: int = SEED, draws: np.ndarray | None = None) -> tuple[list[tuple[float, float]], list[float]]:
    """n normal directions of variance sigma, and shifts even in a full turn. draws: (n, 3) numbers in [0, 1); two of them make a
    direction by the polar form of a normal pair."""
    u = np.random.default_rng(seed).random((n, 3)) if draws is None else np.asarray(draws, dtype=float)
    far, turn = np.sqrt(-2 * sigma * np.log(1 - u[:, 0])), 2 * np.pi * u[:, 1]
    return list(zip((far * np.cos(turn)).tolist(), (far * np.sin(turn)).tolist(), strict=True)), (2 * np.pi * u[:, 2]).tolist()


def ranked_by(df: DataFrame, order: Column, key: str) -> DataFrame:
    """Adds _rank from 0 in the order of (order, key), without a window over all rows.

    Rows are range-partitioned and sorted; the partitions' counts (a number for each) give each one its start. The sorted
    table is checkpointed, as a second run could draw other borders.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s = df.withColumn("_order", order).repartitionByRange(parts, "_order", key).sortWithinPartitions("_order", key)
    s = cut(s.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = {r[0]: (r[1], r[2]) for r in s.groupBy("_part").agg(F.count(F.lit(1)), F.min("_at")).collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total, counts[p][1]))
        total += counts[p][0]
    if not starts:
        return s.withColumn("_rank", F.lit(0).cast("bigint")).drop("_order", "_part", "_at")
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _start bigint, _first bigint"))  # one row per partition
    return s.join(offsets, "_part").withColumn("_rank", F.col("_start") + F.col("_at") - F.col("_first")).drop("_order", "_part", "_at", "_start", "_first")


def sample_n(df: DataFrame, n: int, key: str, seed: int = SEED, order: Column | None = None) -> DataFrame:
    """Exactly n rows without replacement (all if there are no more), by order, then key."""
    return _first(df, n, F.xxhash64(F.col(key), F.lit(seed)) if order is None else order, key)


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: int = SEED, order: Column | None = None) -> DataFrame:
    """round(fraction n) rows, half to even."""
    return sample_n(df, round(fraction * df.count()), key, seed, order)


def split_train_val(df: DataFrame, val_fraction: float, key: str, seed: int = SEED, order: Column | None = None) -> DataFrame:
    """Adds split: floor(n f) rows are val, the first ones of the order; the rest train."""
    ranked = ranked_by(df, F.xxhash64(F.col(key), F.lit(seed)) if order is None else order, key)
    return ranked.withColumn("split", F.when(F.col("_rank") < int(df.count() * val_fraction), "val").otherwise("train")).drop("_rank")


def split_train_val_test(df: DataFrame, val_fraction: float, test_fraction: float, key: str, seed: int = SEED, order: Column | None = None) -> DataFrame:
    """Adds split: ceil(n t) rows test first, then ceil of the share of the rest val."""
    n = df.count()
    test = int(np.ceil(n * test_fraction))
    val = int(np.ceil((n - test) * val_fraction))
    ranked = ranked_by(df, F.xxhash64(F.col(key), F.lit(seed)) if order is None else order, key)
    split = F.when(F.col("_rank") < test, "test").when(F.col("_rank") < test + val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_rank")

"""Filters by files, labels, cells and activations; reshapes between wide and long activations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_IMAGE_BYTES = 10_000


def keep_existing_files(index: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    return index.join(listing.select(path), path, "left_semi")


def loaded_report(index: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: loaded, total."""
    return kept.agg(F.count(F.lit(1)).alias("loaded")).join(F.broadcast(index.agg(F.count(F.lit(1)).alias("total"))))


def keep_large_files(index: DataFrame, listing: DataFrame, path: str = "path", min_bytes: int = MIN_IMAGE_BYTES) -> DataFrame:
    return index.join(listing.select(path, "length"), path).filter(F.col("length") >= min_bytes).drop("length")


def size_report(index: DataFrame, listing: DataFrame, path: str = "path", min_bytes: int = MIN_IMAGE_BYTES) -> DataFrame:
    """One row: skipped, total."""
    met = index.join(listing.select(path, "length"), path)
    return met.agg(F.count_if(F.col("length") < min_bytes).alias("skipped"), F.count(F.lit(1)).alias("total"))


def check_integrity(required: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Required paths that are missing."""
    return required.select(path).distinct().join(listing.select(path), path, "left_anti")


missing_inputs = check_integrity


def check_schema(df: DataFrame) -> str:
    """The name of the text column (text before caption); an error without one, or without coordinates."""
    if not {"lat", "lon"} <= set(df.columns):
        raise ValueError("the columns lat and lon are needed")
    for name in ("text", "caption"):
        if name in df.columns:
            return name
    raise ValueError("a column text or caption is needed")


def with_text(df: DataFrame, vectors: str = "text_embedding") -> DataFrame:
    """lat, lon, text, and the ready-made vectors if there are any."""
    return df.select("lat", "lon", F.col(check_schema(df)).alias("text"), *([vectors] if vectors in df.columns else []))


def filter_label(df: DataFrame, target: int | None, label: str = "label") -> DataFrame:
    return df if target is None else df.filter(F.col(label) == target)


def activations_to_long(wide: DataFrame, *keys: str) -> DataFrame:
    """act{i} columns as rows (keys, neuron = i - 1, act), zeros left out."""
    acts = [c for c in wide.columns if c.startswith("act") and c[3:].isdigit()]
    long = wide.unpivot(list(keys), acts, "_name", "act")
    return long.filter("act != 0").select(*keys, (F.substring("_name", 4, 9).cast("int") - 1).alias("neuron"), "act")


def activations_to_wide(long: DataFrame, n: int, *keys: str) -> DataFrame:
    """act1 to actn by key, zeros filled in."""
    out = long.groupBy(*keys).pivot("neuron", list(range(n))).agg(F.sum("act"))
    return out.select(*keys, *(F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"act{i + 1}") for i in range(n)))


def positive_activations(long: DataFrame, min_positive: int = 10, max_features: int | None = None) -> DataFrame:
    """Rows with act > 0 of features with min_positive such rows; of these the first max_features.

    Features are counted by an aggregate, combined before its shuffle, so a feature that fires on most rows isn't gathered.
    """
    positive = long.filter("act > 0")
    enough = positive.groupBy("neuron").count().filter(F.col("count") >= min_positive).select("neuron")
    if max_features is not None:
        enough = enough.orderBy("neuron").limit(max_features)
    return positive.join(enough, "neuron", "left_semi")


def mask_rare_neurons(long: DataFrame, min_rows: int = 20) -> DataFrame:
    """Features with fewer non-zero rows are dropped, which is zero in the long form."""
    often = long.filter("act != 0").groupBy("neuron").count().filter(F.col("count") >= min_rows).select("neuron")
    return long.join(often, "neuron", "left_semi")


def intervene(weights: DataFrame, concepts: list[int]) -> DataFrame:
    """Long weights without the chosen concepts."""
    return weights.filter(~F.col("concept_id").isin(concepts))


def first_existing_path(candidates: DataFrame, listing: DataFrame, key: str, path: str = "path", priority: str = "priority") -> DataFrame:
    """(key, path): of a key's candidates that exist the one of lowest priority; null if none does."""
    met = candidates.join(listing.select(path, F.lit(True).alias("_there")), path, "left")
    return met.groupBy(key).agg(F.min_by(F.when(F.col("_there"), F.col(path)), F.when(F.col("_there"), F.col(priority))).alias(path))


def in_cell(x: Column, y: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Inside or on the edge of a box."""
    return x.between(x0, x1) & y.between(y0, y1)


def grid_cells(points: DataFrame, k: int = 3, pad: float = 0.05) -> DataFrame:
    """k*k rows: row, col and bounds of a grid over the points' range, padded by a share of it."""
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    px, py = pad * (F.col("x1") - F.col("x0") + 1e-6), pad * (F.col("y1") - F.col("y0") + 1e-6)
    b = b.select((F.col("x0") - px).alias("xa"), (F.col("x1") + px).alias("xb"), (F.col("y0") - py).alias("ya"), (F.col("y1") + py).alias("yb"))
    ids = points.sparkSession.range(k * k).select((F.col("id") / k).cast("int").alias("row"), (F.col("id") % k).cast("int").alias("col"))
    edge = lambda lo, hi, i: lo + (hi - lo) * i / k
    xa, xb, ya, yb = (F.col(c) for c in ("xa", "xb", "ya", "yb"))
    c, r = F.col("col"), F.col("row")
    return ids.join(F.broadcast(b)).select("row", "col", edge(xa, xb, c).alias("x0"), edge(xa, xb, c + 1).alias("x1"), edge(ya, yb, r).alias("y0"), edge(ya, yb, r + 1).alias("y1"))


def assign_grid_cells(points: DataFrame, k: int = 3, pad: float = 0.05) -> DataFrame:
    """Each point with row and col of the cells that hold it (two if it is on a common edge). The k*k cells are broadcast."""
    cells = grid_cells(points, k, pad)
    hit = in_cell(F.col("p.x"), F.col("p.y"), F.col("c.x0"), F.col("c.x1"), F.col("c.y0"), F.col("c.y1"))
    return points.alias("p").join(F.broadcast(cells).alias("c"), hit).select("p.*", "c.row", "c.col")


def cell_views(points: DataFrame, k: int = 3, pad: float = 0.05, view_pad: float = 0.1) -> DataFrame:
    """Per cell the padded bounds of its points, or its own bounds if it has none."""
    inner = assign_grid_cells(points, k, pad).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    met = grid_cells(points, k, pad).join(inner, ["row", "col"], "left")
    px, py = view_pad * (F.col("b") - F.col("a") + 1e-6), view_pad * (F.col("d") - F.col("c") + 1e-6)
    return met.select("row", "col", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("a") - px, "x0").alias("view_x0"), F.coalesce(F.col("b") + px, "x1").alias("view_x1"), F.coalesce(F.col("c") - py, "y0").alias("view_y0"), F.coalesce(F.col("d") + py, "y1").alias("view_y1"))


def union_datasets(named: dict[str, DataFrame], features: dict[str, list[int]]) -> DataFrame:
    """Activation sets with a dataset label, each with its own features; those absent from a set are passed over."""
    out = None
    for name, df in named.items():
        some = df.filter(F.col("neuron").isin(features[name])).withColumn("dataset", F.lit(name))
        out = some if out is None else out.unionByName(some, allowMissingColumns=True)
    return out


def distinct_features(features: dict[str, list[int]]) -> list[int]:
    """In the order in which they are first met."""
    return list(dict.fromkeys(x for some in features.values() for x in some))


def marker_strength(df: DataFrame, value: str = "value", by: str = "neuron") -> DataFrame:
    """Adds strength: 8 (1 + 6 min-max share) per feature; a single row, or a constant feature, 1 times 8 or 1."""
    ends = df.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    lo, hi = F.col("_lo"), F.col("_hi")
    share = F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.0)
    out = df.join(ends, by).withColumn("strength", F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(8.0 * (1.0 + 6.0 * share)))
    return out.select(*(c for c in df.columns if c != "strength"), "strength")

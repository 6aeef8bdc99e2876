"""Sparse non-negative decomposition of vectors into named concepts, and its reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravec.functions.arrays import center_normalize, doubles, l2_normalize
from terravec.functions.text import format_metric
from terravec.operators.screening import active_set, split_weights
from terravec.operators.shared import cut, lookup
from terravec.operators.vectors import vector_mean

L1, RHO, TOL, MAX_ROUNDS = 0.175, 5.0, 1e-6, 2000
#: Weights at or below this count as zero.
ZERO = 1e-7
MAX_CONCEPTS = 200_000
#: Bounds of the dictionary that is brought to the driver and broadcast, and of one dense block of weights.
MAX_BYTES, BLOCK_BYTES = 1 << 30, 1 << 25


def build_dictionary(concepts: DataFrame, vector: str = "embedding") -> DataFrame:
    """concepts with vector: rows normalised, centred on the concepts' mean, normalised."""
    mean = vector_mean(concepts.select(l2_normalize(doubles(F.col(vector))).alias("u")), "u")
    return concepts.join(F.broadcast(mean)).select("concept_id", "concept", center_normalize(doubles(F.col(vector)), F.col("mean")).alias("vector"))


def fits(dictionary: DataFrame) -> bool:
    """Whether a dictionary is within the bounds of a broadcast."""
    n, size = dictionary.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector").cast("bigint")), F.lit(0))).first()
    return n <= MAX_CONCEPTS and 8 * size <= MAX_BYTES


def dictionary_matrix(dictionary: DataFrame) -> tuple[list[int], np.ndarray]:
    """Ids and matrix on the driver, for a broadcast; of a dictionary that ``fits``."""
    rows = dictionary.select("concept_id", doubles(F.col("vector")).alias("vector")).orderBy("concept_id").toArrow()
    if not rows.num_rows:
        return [], np.zeros((0, 0))
    return rows.column("concept_id").to_pylist(), rows.column("vector").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)


def admm(c: np.ndarray, v: np.ndarray, lam: float = L1, rho: float = RHO, tol: float = TOL, rounds: int = MAX_ROUNDS) -> np.ndarray:
    """Rows w >= 0 of least |w C - v|^2 + lam |w|_1, from zero. The factor is D x D by the Woodbury identity; each row stops
    by its own residuals, looked at every ten rounds."""
    inner = np.linalg.inv(rho / 2 * np.eye(c.shape[1]) + c.T @ c)
    solve = lambda r: (r - ((r @ c) @ inner) @ c.T) / rho
    cv = 2 * v @ c.T
    z, u = np.zeros_like(cv), np.zeros_like(cv)
    out, live = np.zeros_like(cv), np.arange(len(cv))
    for k in range(rounds):
        x = solve(cv[live] + rho * (z - u))
        new = np.maximum(x + u - lam / rho, 0)
        u = u + x - new
        primal, dual, z = np.linalg.norm(x - new, axis=1), rho * np.linalg.norm(new - z, axis=1), new
        if k % 10 == 9:
            done = (primal < tol) & (dual < tol)
            if done.any():
                out[live[done]] = z[done]
                live, z, u = live[~done], z[~done], u[~done]
            if not len(live):
                return out
    out[live] = z
    return out


def lasso(c: np.ndarray, v: np.ndarray, lam: float = L1, tol: float = TOL) -> np.ndarray:
    """The same by active sets: descent runs over the few concepts that a row uses, never over all of them."""
    return active_set(c, v, lam, tol * 1e-2)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def splice_encode(df: DataFrame, dictionary: DataFrame, mean: np.ndarray, key: str, vector: str = "embedding", solver: str = "admm", lam: float = L1, extra: list[str] | None = None, rebuilt: bool = False, tol: float = TOL) -> DataFrame:
    """(key, extra..., concepts, weights, l0, mse, cosine [, rebuilt]), one row for each input row, active concepts only.

    Rows are normalised, centred on ``mean``, normalised and decomposed; the rebuilt vector is
    normalise(normalise(w C) + mean). Dictionary and factor are broadcast; nothing is shuffled. Rows are solved in blocks whose
    dense weights take BLOCK_BYTES. A dictionary that is too large for that is split, and the rows (no stream then) are solved by
    active sets, whichever solver is named: the optimum is one.
    """
    if not fits(dictionary):
        return _encode_split(df, dictionary, mean, key, vector, lam, extra, rebuilt, tol)
    ids, c = dictionary_matrix(dictionary)
    shared = df.sparkSession.sparkContext.broadcast((np.array(ids), c, np.asarray(mean)))
    keep = [key, *(extra or [])]
    solve = {"admm": admm, "lasso": lasso}[solver]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, c, m = shared.value
        step = max(1, BLOCK_BYTES // (8 * max(1, len(c))))
        for whole in frames:
            for a in range(0, len(whole), step):
                pdf = whole.iloc[a : a + step]
                x = unit(np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vector]]))
                w = solve(c, unit(x - m), lam, tol=tol)
                w[w <= ZERO] = 0
                again = recompose(w, c, m)
                out = pdf[keep].copy()
                out["concepts"] = [names[r > 0].tolist() for r in w]
                out["weights"] = [r[r > 0].tolist() for r in w]
                out["l0"] = (w > 0).sum(axis=1)
                out["mse"] = ((x - again) ** 2).mean(axis=1)
                out["cosine"] = (x * again).sum(axis=1)
                if rebuilt:
                    out["rebuilt"] = list(again)
                yield out

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    schema = f"{fields}, concepts array<int>, weights array<double>, l0 bigint, mse double, cosine double" + (", rebuilt array<double>" if rebuilt else "")
    return df.select(*keep, vector).filter(F.col(vector).isNotNull()).mapInPandas(run, schema)


def _encode_split(df: DataFrame, dictionary: DataFrame, mean: np.ndarray, key: str, vector: str, lam: float, extra: list[str] | None, rebuilt: bool, tol: float) -> DataFrame:
    keep, m = [key, *(extra or [])], np.asarray(mean)
    centre = df.sparkSession.sparkContext.broadcast(m)

    def centred(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = unit(np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vector]]))
                yield pdf[keep].assign(_x=list(x), _v=list(unit(x - centre.value)))

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    # a row's number holds, as the rows are checkpointed with it
    rows = df.select(*keep, vector).filter(F.col(vector).isNotNull()).mapInPandas(centred, f"{fields}, _x array<double>, _v array<double>")
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    w = split_weights(rows.select(F.col("_row").alias("row"), F.col("_v").alias("v")), dictionary, len(m), lam, tol * 1e-2)

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            x, again = np.stack(pdf["_x"].to_list()), unit(unit(np.stack(pdf["sum"].to_list())) + centre.value)
            on = [np.asarray(v) > ZERO for v in pdf["w"]]
            out = pdf[keep].copy()
            out["concepts"] = [np.asarray(v)[k].tolist() for v, k in zip(pdf["names"], on, strict=True)]
            out["weights"] = [np.asarray(v)[k].tolist() for v, k in zip(pdf["w"], on, strict=True)]
            out["l0"], out["mse"], out["cosine"] = [int(k.sum()) for k in on], ((x - again) ** 2).mean(axis=1), (x * again).sum(axis=1)
            if rebuilt:
                out["rebuilt"] = list(again)
            yield out

    schema = f"{fields}, concepts array<int>, weights array<double>, l0 bigint, mse double, cosine double" + (", rebuilt array<double>" if rebuilt else "")
    return rows.join(w, rows["_row"] == w["row"]).select(*keep, "_x", "names", "w", "sum").mapInPandas(measured, schema)


def recompose(w: np.ndarray, c: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return unit(unit(w @ c) + mean)


def recompose_long(weights: DataFrame, dictionary: DataFrame, mean: np.ndarray, key: str) -> DataFrame:
    """(key, rebuilt) from long weights (key, concept_id, weight): the weighted sum of each key's concepts, normalised, moved by the
    mean, normalised. Sums are made before the shuffle by key; the dictionary is looked up, whatever its size."""
    long = cut(weights.select(key, "concept_id", F.col("weight").cast("double")))  # looked at more than once
    met = lookup(long, dictionary.select("concept_id", "vector"), ["concept_id"])
    mean_of = vector_to_array(Summarizer.mean(array_to_vector(doubles(F.col("vector"))), F.col("weight")))
    sums = met.filter("weight > 0").groupBy(key).agg(mean_of.alias("m"))  # the sum's direction is the mean's
    centre = F.array(*map(F.lit, np.asarray(mean, dtype=float).tolist()))
    return sums.select(key, l2_normalize(F.zip_with(l2_normalize(F.col("m")), centre, lambda a, b: a + b)).alias("rebuilt"))


def long_weights(encoded: DataFrame, *keys: str) -> DataFrame:
    """(keys, concept_id, weight) of active concepts."""
    return encoded.select(*keys, F.inline(F.arrays_zip("concepts", "weights"))).withColumnsRenamed({"concepts": "concept_id", "weights": "weight"})


def reconstruction_metrics(encoded: DataFrame) -> DataFrame:
    """One row: n_samples, mean and standard deviation of squared error, cosine, and active concepts."""
    pairs = (("mse", "mse"), ("cosine_sim", "cosine"), ("mean_active_concepts", "l0"))
    return encoded.agg(F.count(F.lit(1)).alias("n_samples"), *(F.avg(c).alias(f"{n}_mean") for n, c in pairs), *(F.stddev_samp(c).alias(f"{n}_std") for n, c in pairs))


def decompose_dataset(encoded: DataFrame, key: str) -> DataFrame:
    """(concept_id, weight): mean over all rows, those without the concept too."""
    n = encoded.agg(F.count(F.lit(1)).alias("n"))
    return long_weights(encoded, key).groupBy("concept_id").agg(F.sum("weight").alias("s")).join(F.broadcast(n)).select("concept_id", (F.col("s") / F.col("n")).alias("weight"))


def decompose_classes(encoded: DataFrame, by: str, key: str) -> DataFrame:
    """(by, concept_id, weight): mean over the rows of each class or region."""
    n = encoded.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    s = long_weights(encoded, key, by).groupBy(by, "concept_id").agg(F.sum("weight").alias("s"))
    return s.join(n, by).select(by, "concept_id", (F.col("s") / F.col("n")).alias("weight"))


decompose_regions = decompose_classes


def top_concepts(weights: DataFrame, k: int, *by: str) -> DataFrame:
    """Adds rank: the first k concepts with weight above zero, ties in concept order."""
    w = Window.partitionBy(*by).orderBy(F.desc("weight"), "concept_id")
    return weights.filter("weight > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def check_single_lambda(reports: DataFrame) -> None:
    """An error if a model's reports have more than one l1_penalty."""
    bad = reports.groupBy("model").agg(F.count_distinct("l1_penalty").alias("n")).filter("n > 1").orderBy("model").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['model']} has {bad[0]['n']} values of l1_penalty")


def reconstruction_table(reports: DataFrame, models: list[str], datasets: list[str], metrics: dict[str, int], include_std: bool = False) -> DataFrame:
    """One row per model in the given order, one formatted column per dataset and metric (decimals by metric)."""
    cells = [(F.format_string("%s", format_metric(F.first(f"{m}_mean"), F.first(f"{m}_std") if include_std else None, p))).alias(m) for m, p in metrics.items()]
    wide = reports.filter(F.col("model").isin(models) & F.col("dataset").isin(datasets)).groupBy("model").pivot("dataset", datasets).agg(*cells)
    rank = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    one = len(metrics) == 1
    names = [(ds if one else f"{ds}_{m}", f"{ds}_{m}") for ds in datasets for m in metrics]
    return wide.orderBy(rank).select("model", *(F.col(f"`{a}`").alias(b) for a, b in names))

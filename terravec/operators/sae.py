"""Sparse autoencoder features: encode, decode, batch top-k, feature statistics and monosemanticity scores.

Activations are long tables (key, neuron, act) without zeros; means and minima use the full number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravec.functions.arrays import doubles, l2_normalize, norm
from terravec.operators.sampling import class_ranked
from terravec.operators.shared import cut, lookup
from terravec.operators.vectors import blocks_of

DEAD_AFTER_ROWS = 10_000_000
EMA_BETA, EMA_FROM_STEP = 0.999, 300
MIN_ROWS = 20


@dataclass
class Params:
    """w_enc (N, D), b_enc (N), w_dec (D, N) with unit columns, b_dec (D), threshold, k."""

    w_enc: np.ndarray
    b_enc: np.ndarray
    w_dec: np.ndarray
    b_dec: np.ndarray
    threshold: float = 0.0
    k: int = 20

    def __post_init__(self):
        self.w_dec = self.w_dec / np.maximum(np.linalg.norm(self.w_dec, axis=0, keepdims=True), 1e-12)

    def scaled_biases(self, by: float) -> Params:
        return Params(self.w_enc, self.b_enc * by, self.w_dec, self.b_dec * by, self.threshold * by, self.k)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.b_dec) @ self.w_enc.T + self.b_enc, 0)

    def decode(self, f: np.ndarray) -> np.ndarray:
        return f @ self.w_dec.T + self.b_dec


def sae_encode(df: DataFrame, params: Params, key: str, vector: str, use_threshold: bool = True, extra: list[str] | None = None) -> DataFrame:
    """(key, extra..., neuron, act): positive activations; with use_threshold only those strictly above it. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(params)
    keep = [key, *(extra or [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for pdf in frames:
            if pdf.empty:
                continue
            f = p.encode(np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vector]]))
            row, neuron = np.nonzero(f > (p.threshold if use_threshold else 0.0))
            yield pdf[keep].iloc[row].assign(neuron=neuron.astype(np.int32), act=f[row, neuron])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, vector).filter(F.col(vector).isNotNull()).mapInPandas(run, f"{fields}, neuron int, act double")


def sae_decode(points: DataFrame, long: DataFrame, params: Params, key: str) -> DataFrame:
    """(key, decoded) of every point; one without activations decodes to the bias. The decoder's rows (one per feature) are broadcast."""
    spark = points.sparkSession
    rows = spark.createDataFrame([(i, params.w_dec[:, i].tolist()) for i in range(params.w_dec.shape[1])], "neuron int, w array<double>")
    met = long.join(F.broadcast(rows), "neuron").withColumn("w", array_to_vector("w"))
    mean = met.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("w"), F.col("act"))).alias("m"), F.sum("act").alias("a"))
    bias = F.array(*map(F.lit, params.b_dec.tolist()))
    out = points.select(key).join(mean, key, "left")
    return out.select(key, F.when(F.col("m").isNull(), bias).otherwise(F.zip_with(F.transform("m", lambda x: x * F.col("a")), bias, lambda a, b: a + b)).alias("decoded"))


#: Bins of activations in each doubling.
BINS = 32


def batch_topk(long: DataFrame, sizes: DataFrame, k: int, key: str, batch: str = "batch_id") -> DataFrame:
    """Of each batch the k * rows largest positive activations; ties by key and feature. sizes: (batch, n).

    A histogram of the activations' logarithms tells in which bin a batch's cut lies. Rows of higher bins are taken as they are;
    only those of that bin are ranked, by ranges, so that neither a large batch nor many equal activations are one task.
    """
    rows = long.filter("act > 0").withColumn("_bin", F.floor(F.log2("act") * BINS))
    counts = rows.groupBy(batch, "_bin").agg(F.count(F.lit(1)).alias("_m"))
    down = F.sum("_m").over(Window.partitionBy(batch).orderBy(F.desc("_bin")))
    at = counts.withColumn("_down", down).join(sizes.select(batch, (F.col("n") * k).alias("_want")), batch)
    cuts = cut(at.filter(F.col("_down") >= F.col("_want")).groupBy(batch).agg(F.max("_bin").alias("_cut"), F.max_by(F.col("_want") - F.col("_down") + F.col("_m"), "_bin").alias("_left")))
    whole = at.groupBy(batch).agg(F.max("_want").alias("_want")).join(cuts, batch, "left").select(batch, F.coalesce("_cut", F.lit(-(1 << 40))).alias("_cut"), F.coalesce("_left", F.lit(0)).alias("_left"))
    met = lookup(rows, cut(whole), [batch])
    some = class_ranked(met.filter(F.col("_bin") == F.col("_cut")), batch, [key, "neuron"], -F.col("act"))
    kept = met.filter(F.col("_bin") > F.col("_cut")).unionByName(some.filter(F.col("_rank") <= F.col("_left")).drop("_rank", "_n"))
    return kept.drop("_bin", "_cut", "_left")


def norm_factor(df: DataFrame, vector: str, batch: str = "batch_id", steps: int | None = None) -> DataFrame:
    """One row, factor: root of the plain mean over (the first steps + 1) batches of the mean squared norm."""
    some = df if steps is None else df.filter(F.col(batch) <= steps)
    per = some.groupBy(batch).agg(F.avg(F.pow(norm(doubles(F.col(vector))), 2)).alias("m"))
    return per.agg(F.sqrt(F.avg("m")).alias("factor"))


def nonzero_counts(long: DataFrame) -> DataFrame:
    return long.filter("act != 0").groupBy("neuron").agg(F.count(F.lit(1)).alias("n"))


def minmax_scale_columns(long: DataFrame, rows: int) -> DataFrame:
    """act as its share between a feature's minimum and maximum over all ``rows`` rows (0 where one has no activation).
    Features of one value are left out: they are dead. The statistics are one row for each feature."""
    stats = long.groupBy("neuron").agg(F.min("act").alias("lo"), F.max("act").alias("hi"), F.count(F.lit(1)).alias("n"))
    stats = stats.select("neuron", F.when(F.col("n") < rows, F.least(F.col("lo"), F.lit(0.0))).otherwise(F.col("lo")).alias("lo"), "hi").filter("hi > lo")
    return long.join(stats, "neuron").withColumn("act", (F.col("act") - F.col("lo")) / (F.col("hi") - F.col("lo"))).drop("lo", "hi")


def _weights(long: DataFrame) -> DataFrame:
    """Per feature the sums that every pair denominator needs."""
    return long.groupBy("neuron").agg(F.sum("act").alias("s1"), F.sum(F.col("act") * F.col("act")).alias("s2"), F.count_if(F.col("act") > 0).alias("n"))


def monosemanticity_visual(long: DataFrame, embeddings: DataFrame, key: str = "point_id", vector: str = "embedding") -> DataFrame:
    """(neuron, score): over all pairs of rows, their cosine weighted by the product of activations. One pass: with unit
    vectors the sum over pairs is (|sum a x|^2 - sum a^2 |x|^2) / 2. Features with one active row have a null score."""
    unit = embeddings.select(key, l2_normalize(doubles(F.col(vector))).alias("u"))
    unit = unit.select(key, array_to_vector("u").alias("u"), F.pow(norm(F.col("u")), 2).alias("u2"))
    a, met = F.col("act"), long.filter("act > 0").join(unit, key)
    g = met.groupBy("neuron").agg(F.sum("act").alias("s1"), F.sum(a * a).alias("s2"), F.sum(a * a * F.col("u2")).alias("q"), F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(F.col("u"), a)).alias("m"))
    top = F.pow(norm(F.col("m")) * F.col("s1"), 2) - F.col("q")
    return g.select("neuron", F.when(F.col("n") > 1, top / (F.col("s1") * F.col("s1") - F.col("s2"))).alias("score"))


#: Features that a task of the distance form has dense at once.
FEATURE_TILE = 256


def monosemanticity_geo(long: DataFrame, located: DataFrame, neurons: int, key: str = "point_id", blocks: int | None = None, scale_km: float = 500.0, radius: float = 6371.0) -> DataFrame:
    """(neuron, score): the same with exp(-km / scale) for the cosine. Rows are dealt to pairs of blocks, as many as the table takes;
    a pair is two numpy matrices, some features of them at a time, and gives one number per feature."""
    blocks = blocks or blocks_of(located)
    dense = long.groupBy(key).agg(F.collect_list(F.struct("neuron", "act")).alias("acts"))
    rows = located.select(key, "lon", "lat").join(dense, key).withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    dealt = rows.select("*", other).withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other")

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        entries = [(i, x["neuron"], x["act"]) for i, row in enumerate(pdf.acts) for x in row]
        at, of, value = (np.array(x) for x in zip(*entries, strict=True)) if entries else (np.zeros(0, int),) * 3
        order = np.argsort(of, kind="stable")
        at, of, value = at[order], of[order], value[order]
        lat, lon = np.radians(pdf.lat.to_numpy(float)), np.radians(pdf.lon.to_numpy(float))
        first, same = pdf.block.to_numpy() == pdf.bi.iloc[0], pdf.bi.iloc[0] == pdf.bj.iloc[0]
        left = np.flatnonzero(first)
        right = left if same else np.flatnonzero(~first)
        total = np.zeros(neurons)
        for s in range(0, len(left), 1024):
            i = left[s : s + 1024]
            h = np.sin((lat[i, None] - lat[None, right]) / 2) ** 2 + np.cos(lat[i])[:, None] * np.cos(lat[right])[None] * np.sin((lon[i, None] - lon[None, right]) / 2) ** 2
            h = np.clip(h, 0, 1)
            kernel = np.exp(-2 * radius * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) / scale_km)
            if same:
                kernel *= i[:, None] < right[None]
            for n in range(0, neurons, FEATURE_TILE):
                a, b = np.searchsorted(of, [n, n + FEATURE_TILE])
                if a == b:
                    continue
                acts = np.zeros((len(pdf), min(FEATURE_TILE, neurons - n)))
                acts[at[a:b], of[a:b] - n] = value[a:b]
                total[n : n + FEATURE_TILE] += (acts[i] * (kernel @ acts[right])).sum(axis=0)
        return pd.DataFrame({"neuron": np.arange(neurons, dtype=np.int32), "top": total})

    top = dealt.groupBy("bi", "bj").applyInPandas(pairs, "neuron int, top double").groupBy("neuron").agg(F.sum("top").alias("top"))
    return _weights(long).join(top, "neuron").select("neuron", F.when(F.col("n") > 1, 2 * F.col("top") / (F.col("s1") * F.col("s1") - F.col("s2"))).alias("score"))


def score_summary(scores: DataFrame, metric: str, total: int) -> DataFrame:
    """metric, min, max, mean, sample standard deviation over live features; dead and total."""
    s = scores.agg(F.min("score").alias("min"), F.max("score").alias("max"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.count("score").alias("live"))
    return s.select(F.lit(metric).alias("metric"), "min", "max", "mean", "std", (F.lit(total) - F.col("live")).alias("dead"), F.lit(total).cast("bigint").alias("total"))


def top_bottom_features(scores: DataFrame, n: int = 10) -> DataFrame:
    """(side, neuron, score): the n highest and the n lowest live scores."""
    live = scores.filter(F.col("score").isNotNull())
    top = live.orderBy(F.desc("score"), "neuron").limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(live.orderBy("score", "neuron").limit(n).withColumn("side", F.lit("bottom"))).select("side", "neuron", "score")


def top_features(scores: DataFrame, k: int, largest: bool = True) -> DataFrame:
    order = F.desc_nulls_last("score") if largest else F.asc_nulls_last("score")
    return scores.orderBy(order, "neuron").limit(k)


def top_rows_per_feature(long: DataFrame, k: int, key: str = "point_id", salts: int = 16) -> DataFrame:
    """Per feature the k rows of largest activation (rank from 1), ties by key. Each of a feature's salts keeps k first, so a
    feature that fires on most rows isn't one task."""
    w = lambda *by: Window.partitionBy(*by).orderBy(F.desc("act"), key)
    some = long.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(salts))).withColumn("_r", F.row_number().over(w("neuron", "_s"))).filter(F.col("_r") <= k).drop("_s", "_r")
    return some.withColumn("rank", F.row_number().over(w("neuron"))).filter(F.col("rank") <= k)


def fired_features(long: DataFrame, batch: str = "batch_id") -> DataFrame:
    return long.filter("act > 0").select(batch, "neuron").distinct()


def min_active(long: DataFrame, batches: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch, min_active) of every batch; 0 if nothing is active."""
    least = long.filter("act > 0").groupBy(batch).agg(F.min("act").alias("m"))
    return batches.select(batch).distinct().join(least, batch, "left").select(batch, F.coalesce("m", F.lit(0.0)).alias("min_active"))


def ema(values: np.ndarray, beta: float = EMA_BETA, start: float | None = None) -> np.ndarray:
    out, t = np.empty(len(values)), start
    for i, v in enumerate(values):
        t = v if t is None else beta * t + (1 - beta) * v
        out[i] = t
    return out


def threshold_ema(steps: DataFrame, run: str = "run", beta: float = EMA_BETA, after: int = EMA_FROM_STEP, width: int = 10_000) -> DataFrame:
    """(run, step, threshold): of steps above ``after``, the first minimum, then the moving average.

    A step maps the average to beta times it plus a number; such maps of a range of ``width`` steps are one of their kind. So each
    range is averaged from zero, a run's ranges (one row each) are chained, and each step adds its share of what came before.
    """
    some = steps.filter(F.col("step") > after).select(F.col(run).alias("_run"), "step", F.col("min_active").cast("double").alias("m"), F.floor(F.col("step") / width).alias("part"))
    kind = steps.schema[run].dataType.simpleString()

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        return pdf.assign(place=np.arange(1, len(pdf) + 1), own=ema(pdf["m"].to_numpy(float), beta, 0.0))

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, start, before = pdf.sort_values("part"), None, []
        for n, end, first in zip(pdf["n"], pdf["end"], pdf["first"], strict=True):
            before.append(first if start is None else start)  # the first minimum is the first average
            start = beta**n * before[-1] + end
        return pdf[["_run", "part"]].assign(before=before)

    local = cut(some.groupBy("_run", "part").applyInPandas(within, f"_run {kind}, step bigint, m double, part bigint, place bigint, own double"))
    ends = local.groupBy("_run", "part").agg(F.count(F.lit(1)).alias("n"), F.max_by("own", "step").alias("end"), F.min_by("m", "step").alias("first"))
    starts = ends.groupBy("_run").applyInPandas(chained, f"_run {kind}, part bigint, before double")
    met = local.join(starts, local["_run"].eqNullSafe(starts["_run"]) & (local["part"] == starts["part"]))
    return met.select(local["_run"].alias(run), "step", (F.col("own") + F.pow(F.lit(beta), F.col("place")) * F.col("before")).alias("threshold"))


def rows_since_fired(log: DataFrame, dead_after: int = DEAD_AFTER_ROWS, steps: int = 10_000) -> DataFrame:
    """(neuron, step, since, dead) of rows (neuron, step, batch_size, fired): rows seen since a feature last fired.

    Sums run within ranges of ``steps`` steps first, and then over the ranges' totals, so that a feature isn't one task.
    """
    w = Window.partitionBy("neuron", "part").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    seen = log.select("neuron", "step", "batch_size", "fired", F.floor(F.col("step") / steps).alias("part")).withColumn("seen", F.sum("batch_size").over(w))
    return settled(seen.withColumn("last", F.coalesce(F.max(F.when(F.col("fired"), F.col("seen"))).over(w), F.lit(0))), dead_after)


def settled(seen: DataFrame, dead_after: int = DEAD_AFTER_ROWS) -> DataFrame:
    """(neuron, step, since, dead) of rows (neuron, part, step, seen, last): the rows seen in a range of steps up to a step, and how
    many of them when the feature last fired there (0: not yet)."""
    parts = seen.groupBy("neuron", "part").agg(F.max("seen").alias("_rows"), F.max("last").alias("_fired"))
    over = Window.partitionBy("neuron").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(over), F.lit(0)))
    parts = parts.withColumn("_old", F.coalesce(F.max(F.when(F.col("_fired") > 0, F.col("_before") + F.col("_fired"))).over(over), F.lit(0)))
    since = F.when(F.col("last") > 0, F.col("seen") - F.col("last")).otherwise(F.col("_before") + F.col("seen") - F.col("_old"))
    out = seen.join(parts.select("neuron", "part", "_before", "_old"), ["neuron", "part"]).select("neuron", "step", since.alias("since"))
    return out.withColumn("dead", F.col("since") >= dead_after)


def sae_validation(df: DataFrame, params: Params, vector: str, factor: float = 1.0, batch: str = "batch_id") -> DataFrame:
    """(mode, l0, l2, frac_variance_explained) for "topk" and "threshold": plain means over batches of batch means; the
    explained share is 1 - sum var(e) / sum var(x) with sample variances. A batch is one group."""
    shared = df.sparkSession.sparkContext.broadcast(params)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p, x = shared.value, np.stack([np.asarray(v, float) for v in pdf[vector]]) / factor
        out = []
        for mode in ("topk", "threshold"):
            f = p.encode(x)
            if mode == "threshold":
                f = np.where(f > p.threshold, f, 0)
            elif f.size > p.k * len(f):
                cut = np.partition(f.reshape(-1), -p.k * len(f))[-p.k * len(f)]
                f = np.where(f >= cut, f, 0)
            e = x - p.decode(f)
            explained = 1 - e.var(axis=0, ddof=1).sum() / x.var(axis=0, ddof=1).sum() if len(x) > 1 else np.nan
            out.append((mode, float((f != 0).sum(axis=1).mean()), float((e**2).sum(axis=1).mean()), explained))
        return pd.DataFrame(out, columns=["mode", "l0", "l2", "frac"])

    per = df.select(batch, vector).groupBy(batch).applyInPandas(one, "mode string, l0 double, l2 double, frac double")
    return per.groupBy("mode").agg(F.avg("l0").alias("l0"), F.avg("l2").alias("l2"), F.avg("frac").alias("frac_variance_explained"))


def sae_recon_error(df: DataFrame, decoded: DataFrame, key: str, vector: str) -> DataFrame:
    """One row, error: mean over rows of the squared distance to the decoded vector."""
    met = df.select(key, doubles(F.col(vector)).alias("_x")).join(decoded, key)
    e = F.aggregate(F.zip_with("_x", "decoded", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return met.agg(F.avg(e).alias("error"))

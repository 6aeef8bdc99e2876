"""Operators whose groups may be hot: ranks, selections, scans and lookups against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terravec.functions import encodings
from terravec.operators import nets, raster, sae, sampling
from terravec.streaming import stream


def test_topk_of_a_hot_batch_with_ties(spark):
    rng = np.random.default_rng(31)
    batch = np.where(rng.uniform(size=4000) < 0.6, 7, rng.integers(0, 40, 4000))
    act = np.where(rng.uniform(size=4000) < 0.5, 1.0, np.round(rng.lognormal(0, 3, 4000), 2))
    act[:5] = [0.0, -1.0, 1e-300, 1e300, 5e-324]
    rows = pd.DataFrame({"batch_id": batch, "vec_id": rng.integers(0, 500, 4000), "neuron": np.arange(4000), "act": act})
    long = spark.createDataFrame(rows, "batch_id long, vec_id long, neuron int, act double")
    n = pd.Series(rng.integers(0, 60, 50), name="n")
    n[7] = 600
    sizes = spark.createDataFrame([(i, int(x)) for i, x in n.items()], "batch_id long, n long")
    got = {(r.batch_id, r.vec_id, r.neuron, r.act) for r in sae.batch_topk(long, sizes, 2, "vec_id").collect()}
    want = set()
    for b, g in rows[rows.act > 0].groupby("batch_id"):
        g = g.sort_values(["act", "vec_id", "neuron"], ascending=[False, True, True]).head(2 * int(n[b]))
        want |= {tuple(r) for r in g[["batch_id", "vec_id", "neuron", "act"]].itertuples(index=False)}
    assert got == want
    assert sae.batch_topk(long.limit(0), sizes, 2, "vec_id").count() == 0


def test_ranges_are_even_when_most_scores_are_equal(spark):
    rng = np.random.default_rng(32)
    n = 20_000
    cls, score = np.where(rng.uniform(size=n) < 0.8, 1, rng.integers(2, 20, n)), np.round(rng.uniform(size=n), 3)
    score[cls == 1] = np.where(rng.uniform(size=(cls == 1).sum()) < 0.9, 0.5, score[cls == 1])
    df = spark.createDataFrame(pd.DataFrame({"class": cls, "row_id": np.arange(n), "score": score, "y_true": rng.integers(0, 2, n)}))
    sizes = [r["count"] for r in sampling.class_ranges(df, ["class"], ["row_id"], -F.col("score")).groupBy("_b").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * np.median(sizes)
    got = {r["class"]: r.ap for r in sampling.average_precision(df).collect()}
    for c, g in df.toPandas().groupby("class"):
        y = g.sort_values(["score", "row_id"], ascending=[False, True]).y_true.to_numpy()
        assert abs(got[c] - (np.cumsum(y) / np.arange(1, len(y) + 1) * y).sum() / y.sum()) < 1e-9


def test_a_long_run_is_many_groups(spark):
    """A million steps, with gaps, beside a short run: against the loop. No group has more than a range of steps."""
    log = spark.range(1_000_000).select(F.lit(1).alias("run"), (F.col("id") + F.floor(F.col("id") / 1000) * 77).alias("step"), F.abs(F.sin(F.col("id") * 0.37)).alias("min_active"))
    log = log.unionByName(spark.createDataFrame([(2, 299, 9.0), (2, 301, 0.5), (2, 5000, 0.25), (None, 400, 1.0)], "run int, step long, min_active double"))
    out = sae.threshold_ema(log)
    got = out.filter("run = 1").select("step", "threshold").toPandas().sort_values("step")
    k = np.arange(1_000_000)
    step, m = k + k // 1000 * 77, np.abs(np.sin(k * 0.37))
    want = sae.ema(m[step > 300])
    assert len(got) == len(want) and np.abs(got.threshold.to_numpy() - want).max() < 1e-9
    assert [(r.run, r.step, round(r.threshold, 9)) for r in out.filter("run = 2 OR run IS NULL").orderBy("step").collect()] == [(2, 301, 0.5), (None, 400, 1.0), (2, 5000, 0.49975)]


def test_stream_and_batch_agree_over_arrivals(spark, tmp_path):
    rng = np.random.default_rng(33)
    rows = spark.createDataFrame(pd.DataFrame({"run": rng.integers(0, 3, 6000), "step": np.arange(6000) // 3, "value": rng.uniform(size=6000)}), "run int, step long, value double")
    parts = [rows.filter(F.col("step").between(a, b)) for a, b in ((0, 700), (701, 701), (702, 5000))]
    got = stream.run_arrivals(parts, stream.stream_threshold_ema, "ema", str(tmp_path / "a")).toPandas()
    want = sae.threshold_ema(rows.groupBy("run", "step").agg(F.min("value").alias("min_active")), width=50).toPandas()
    both = got.merge(want, on=["run", "step"])
    assert len(got) == len(want) == len(both) and (both.threshold_x - both.threshold_y).abs().max() < 1e-6
    log = rows.select(F.col("run").alias("neuron"), "step", F.lit(2).alias("batch_size"), (F.col("value") < 0.01).alias("fired")).dropDuplicates(["neuron", "step"])
    log = spark.createDataFrame(log.toPandas(), "neuron int, step long, batch_size long, fired boolean")
    parts = [log.filter(F.col("step").between(a, b)) for a, b in ((0, 700), (701, 701), (702, 5000))]
    emitted = stream.run_arrivals(parts, lambda s: stream.stream_rows_since_fired(s, 100), "fired", str(tmp_path / "b"))
    key = lambda df: sorted(map(tuple, df.select("neuron", "step", "since", "dead").collect()))
    assert key(sae.settled(emitted, 300)) == key(sae.rows_since_fired(log, 300, 10_000)) == key(sae.rows_since_fired(log, 300, 64))
    assert emitted.groupBy("neuron", "part").count().agg(F.max("count")).first()[0] <= 100


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_raster_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(raster, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(34)
    h, w = 13, 21
    v = rng.normal(size=(h, w, 2))
    v[3, 4, 0] = np.nan
    gone = {(5, 5), (0, 0)}
    table = spark.createDataFrame([(r, c, v[r, c].tolist()) for r in range(h) for c in range(w) if (r, c) not in gone], "row int, col int, values array<double>")
    x, y = rng.uniform(-1, 1, 400), rng.uniform(-1, 1, 400)
    x[:4], y[:4] = [-1, 1, 1, -1], [-1, 1, -1, 1]
    x[4:300], y[4:300] = 0.25, -0.3  # a hot place
    x[300] = 1.5  # outside
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "point_id long, x double, y double")
    full = np.where(np.isnan(v), 0, v)
    for r, c in gone:
        full[r, c] = 0
    want = {}
    for i in range(400):
        px, py = (x[i] + 1) / 2 * (w - 1), (1 - (y[i] + 1) / 2) * (h - 1)
        c, r = int(np.floor(px)), int(np.floor(py))
        if not 0 <= c < w:
            continue
        dx, dy, c1, r1 = px - c, py - r, min(c + 1, w - 1), min(r + 1, h - 1)
        want[i] = full[r, c] * (1 - dx) * (1 - dy) + full[r, c1] * dx * (1 - dy) + full[r1, c] * (1 - dx) * dy + full[r1, c1] * dx * dy
    for block in (4, 32):
        got = {r.point_id: r["values"] for r in raster.raster_lookup(pts, table, h, w, block=block).collect()}
        assert set(got) == set(want) and all(np.allclose(got[i], want[i], atol=1e-12) for i in want)


def test_precomputed_embeddings_are_written_by_split(spark, tmp_path):
    import os

    net = nets.residual_fc((np.eye(4), np.zeros(4)), [], unit=True)
    rows = spark.range(200).select("id", (F.col("id") % 180).cast("double").alias("lon"), (F.col("id") % 90).cast("double").alias("lat"), F.lit("t").alias("text"))
    path = str(tmp_path / "out")
    out = nets.precompute_embeddings(rows, encodings.wrap(F.col("lon"), F.col("lat")), net, path, "id")
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"test": 20, "val": 18, "train": 162}
    assert {d for d in os.listdir(path) if d.startswith("split=")} == {"split=test", "split=val", "split=train"}
    assert set(out.columns) == {"id", "lon", "lat", "text", "split", "location_embedding"}
    again = nets.precompute_embeddings(rows.withColumn("split", F.lit("all")), encodings.wrap(F.col("lon"), F.col("lat")), net, path, "id", keep=["id"])
    assert set(again.columns) == {"id", "split", "location_embedding"} and again.filter("split = 'all'").count() == 200

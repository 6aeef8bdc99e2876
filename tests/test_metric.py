"""The metric index against all pairs, and what it visits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravec.operators import metric, shared


def frame(spark, x, keys=None):
    return spark.createDataFrame([(int(k), None if r is None else [float(v) for v in r]) for k, r in zip(range(len(x)) if keys is None else keys, x, strict=True)], "k long, v array<double>")


def brute(x, keys, k):
    out = {}
    for i, a in zip(keys, x, strict=True):
        found = sorted((float(np.sqrt(((a - b) ** 2).sum())), j) for j, b in zip(keys, x, strict=True))[:k]
        out[i] = [(j, d) for d, j in found]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.k, []).append((r.neighbour, r.dist))
    return out


@pytest.mark.parametrize("tile", [8192, 9])
def test_knn_with_copies_ties_and_outliers(spark, monkeypatch, tile):
    monkeypatch.setattr(metric, "TILE_ROWS", tile)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.integers(0, 3, (60, 3)).astype(float), np.repeat(rng.normal(size=(1, 3)), 50, axis=0), 1e4 * rng.normal(size=(3, 3))])
    keys = rng.permutation(len(x)).tolist()
    want = brute(x, keys, 4)
    for cell_rows in (1000, 12, 3):
        got = listed(metric.knn(frame(spark, [*x, None], [*keys, 999]), "k", "v", 4, cell_rows))
        assert set(got) == set(want)
        for i in want:
            assert [j for j, _ in got[i]] == [j for j, _ in want[i]] and np.allclose([d for _, d in got[i]], [d for _, d in want[i]], atol=1e-12)


def test_knn_of_few_and_none(spark):
    assert metric.knn(frame(spark, []), "k", "v", 3).count() == 0
    assert listed(metric.knn(frame(spark, [[1.0], [2.0], None]), "k", "v", 3)) == {0: [(0, 0.0), (1, 1.0)], 1: [(1, 0.0), (0, 1.0)]}
    assert metric.knn(spark.createDataFrame([(1, [None, 1.0])], "k long, v array<double>"), "k", "v", 3).count() == 0


def test_knn_visits_few_cells_of_clustered_rows(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(150, 24))
    x = np.repeat(centres, 20, axis=0) + 0.03 * rng.normal(size=(3000, 24))
    found = metric.cells(frame(spark, x), "k", "v", 5, 30)
    assert len(found.pivots) > 80
    own = metric.own_cell(found, 5)
    visited = metric.visiting(found, own, 5).agg(F.avg("cells"), F.max("cells")).first()
    assert 1 + visited[0] < 10
    got = listed(metric.knn(frame(spark, x), "k", "v", 5, 30))
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    assert np.allclose([[e for _, e in got[i]] for i in range(3000)], np.sort(d, axis=1)[:, :5], atol=1e-6)


def test_lookup_of_hot_keys(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") == 1, F.lit(None)).otherwise(F.col("id")).alias("k"), "id")
    right = spark.createDataFrame([(7, "hot"), (2, "two"), (100_000, "none")], "k long, name string")
    for how, rows in (("inner", 1669), ("left", 5000)):
        out = shared.lookup(left, right, ["k"], how)
        assert out.count() == rows and out.filter("name = 'hot'").count() == 1668 and out.filter("name = 'two'").count() == 1

"""Decomposition by active sets, in memory and over a split dictionary, against the conditions of the optimum."""

import numpy as np
import pytest

from terravec.operators import screening, splice


def data(n, k, d, seed, noise=0.2):
    rng = np.random.default_rng(seed)
    c = splice.unit(rng.normal(size=(k, d)) + 0.5 * rng.normal(size=d))
    w = np.zeros((n, k))
    for r in w:
        r[rng.integers(0, k, 5)] = rng.uniform(0.2, 1, 5)
    return c, splice.unit(w @ c + noise * rng.normal(size=(n, d)))


def optimal(c, v, w, lam=splice.L1):
    """No weight can be moved to lower the sum."""
    slope = 2 * (w @ c - v) @ c.T + lam
    return (w >= 0).all() and slope[w == 0].min() > -1e-5 and np.abs(slope[w > 0]).max(initial=0) < 1e-5


def test_active_sets_are_optimal_and_equal_admm():
    for n, k, d in ((40, 600, 24), (10, 3, 8), (5, 2000, 12)):
        c, v = data(n, k, d, k)
        c = np.concatenate([c, c[:2]])  # equal concepts
        w = screening.active_set(c, v, splice.L1, 1e-9)
        assert optimal(c, v, w)
        a = splice.admm(c, v, tol=1e-9, rounds=20_000)
        assert np.abs(w @ c - a @ c).max() < 1e-4
    assert screening.active_set(np.zeros((0, 4)), np.zeros((3, 4)), 0.1, 1e-9).shape == (3, 0)
    assert not screening.active_set(c, np.zeros((2, 12)), splice.L1, 1e-9).any()


def test_screening_leaves_out_what_is_zero(monkeypatch):
    """The concepts still looked at in the end are fewer than half, and the answer is that of looking at all."""
    c, v = data(30, 4000, 32, 7, noise=0.05)
    seen, whole = [], np.union1d
    monkeypatch.setattr(np, "union1d", lambda a, b: seen.append(len(a)) or whole(a, b))
    w = screening.active_set(c, v, splice.L1, 1e-9)
    assert optimal(c, v, w) and min(seen) < 2000


@pytest.mark.parametrize("bytes_", [1 << 26, 8 * 12 * 40])
def test_split_dictionary_equals_the_whole(spark, bytes_):
    c, v = data(50, 300, 12, 9)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row long, v array<double>")
    dictionary = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(c)], "concept_id int, vector array<double>")
    want = screening.active_set(c, v, splice.L1, 1e-9)
    got = np.zeros_like(want)
    found = screening.split_weights(rows, dictionary, 12, splice.L1, 1e-9, bytes_).collect()
    assert len(found) == 50
    for r in found:
        assert r.names == sorted(r.names)
        got[r.row, np.array(r.names, int) // 3] = r.w
        assert np.allclose(r.sum, got[r.row] @ c, atol=1e-9)
    assert np.abs(got - want).max() < 1e-6


def test_encoding_with_more_concepts_than_are_broadcast(spark):
    """200,050 concepts: the conditions of the optimum hold over all of them."""
    n, d = 200_050, 24
    assert n > splice.MAX_CONCEPTS
    rng = np.random.default_rng(11)
    v, mean = rng.normal(size=(12, d)), 0.1 * rng.normal(size=d)
    dictionary = spark.range(n).selectExpr("cast(id as int) concept_id", f"transform(sequence(1, {d}), j -> pmod(xxhash64(id, j), 2000003) / 1000001.5 - 1) x")
    dictionary = dictionary.selectExpr("concept_id", "transform(x, y -> y / sqrt(aggregate(x, 0D, (s, z) -> s + z * z))) vector")
    df = spark.createDataFrame([(i, x.tolist(), "k") for i, x in enumerate(v)] + [(99, None, "k")], "id int, embedding array<double>, label string")
    out = splice.splice_encode(df, dictionary, mean, "id", extra=["label"], rebuilt=True).collect()
    assert sorted(r.id for r in out) == list(range(12)) and {r.label for r in out} == {"k"}
    c = dictionary.orderBy("concept_id").select("vector").toArrow().column("vector").combine_chunks().flatten().to_numpy().reshape(n, d)
    x = splice.unit(v)
    for r in out:
        w = np.zeros((1, n))
        w[0, r.concepts] = r.weights
        u = splice.unit(x[[r.id]] - mean)
        slope = 2 * (w @ c - u) @ c.T + splice.L1
        assert slope.min() > -1e-4 and np.abs(slope[w > 0]).max() < 1e-4 and r.l0 == len(r.concepts) > 0
        again = splice.recompose(w, c, mean)[0]
        assert np.allclose(r.rebuilt, again, atol=1e-6) and abs(r.cosine - x[r.id] @ again) < 1e-6 and abs(r.mse - ((x[r.id] - again) ** 2).mean()) < 1e-6

"""The tree of distance scores against all pairs: the error stays under tau, for even, clustered and equal places."""

import numpy as np
import pytest

from terravec.operators import geotree, sae


def exact(lon, lat, a):
    x = np.radians(np.stack([lon, lat]))
    h = np.sin((x[1][:, None] - x[1]) / 2) ** 2 + np.cos(x[1])[:, None] * np.cos(x[1]) * np.sin((x[0][:, None] - x[0]) / 2) ** 2
    k = np.exp(-2 * 6371 * np.arcsin(np.sqrt(np.clip(h, 0, 1))) / 500)
    np.fill_diagonal(k, 0)
    return ((a * (k @ a)).sum(0)) / (a.sum(0) ** 2 - (a * a).sum(0))


def places(kind, n, rng):
    lon, lat = rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    if kind != "even":  # a third within a few km, a third at one place
        lon[: n // 3], lat[: n // 3] = 11 + 0.05 * rng.normal(size=n // 3), 48 + 0.05 * rng.normal(size=n // 3)
        lon[n // 3 : 2 * n // 3], lat[n // 3 : 2 * n // 3] = 12.0, 48.5
        lat[-2:] = 90, -90
    return lon, lat


def frames(spark, lon, lat, a):
    at = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lon, lat, strict=True))], "point_id long, lon double, lat double")
    long = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "point_id long, neuron int, act double")
    return long, at


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_scores_stay_within_the_bound(spark, kind):
    rng = np.random.default_rng(12)
    n = 2500
    lon, lat = places(kind, n, rng)
    a = rng.uniform(0, 2, (n, 4)) * (rng.uniform(size=(n, 4)) < 0.4)
    a[:, 2] *= lon > 0
    want = exact(lon, lat, a)
    long, at = frames(spark, lon, lat, a)
    for tau, leaf in ((3e-2, 1), (1e-3, 8)):
        got = {r.neuron: r.score for r in geotree.monosemanticity_geo_tree(long, at, 4, tau, leaf_sites=leaf, block_sites=200).collect()}
        assert all(abs(got[j] - want[j]) <= tau for j in range(4)), (tau, got, want)
    if kind == "even":
        whole = {r.neuron: r.score for r in sae.monosemanticity_geo(long, at, 4).collect()}
        assert all(abs(whole[j] - want[j]) < 1e-9 for j in range(4))


def test_expansions_stay_within_the_bound():
    """For random cells and points beyond them: what the order says holds for each single pair."""
    rng = np.random.default_rng(13)
    seen = set()
    for tau in (1e-2, 1e-4):
        kernel = geotree.Kernel(6371 / 500, tau)
        for _ in range(1500):
            c = rng.normal(size=3)
            c /= np.linalg.norm(c)
            level = int(rng.integers(3, 16))
            code = geotree.codes(c[None], level)
            low, side = geotree.corners(np.array([level]), code)
            y = low + side[:, None] * rng.uniform(size=(40, 3))
            x = c + rng.normal(size=3) * 10 ** rng.uniform(-4, 0)
            x /= np.linalg.norm(x)
            least, most = geotree.chords(low, side, x[None], np.zeros(1))
            order = int(kernel.order(least, most, np.sqrt(0.75) * side)[0])
            seen.add(order)
            true = kernel.value(np.linalg.norm(x - y, axis=1))
            d = x - (low + side[:, None] / 2)[0]
            r = np.linalg.norm(d)
            if order == -1:
                assert true.max() <= tau
            elif order == 0:
                assert np.abs(true - kernel.value(r)).max() <= tau
            elif order == 2:
                g, g1, g2 = kernel.slopes(r)
                u, delta = d / r, y - (low + side[:, None] / 2)
                h = g2 * np.outer(u, u) + g1 / r * (np.eye(3) - np.outer(u, u))
                assert np.abs(true - (g - g1 * delta @ u + 0.5 * np.einsum("ij,jk,ik->i", delta, h, delta))).max() <= tau
    assert seen == {-1, 0, 2, 9}


def test_cells_hold_their_points():
    rng = np.random.default_rng(14)
    x = rng.normal(size=(500, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:2] = [[1, 0, 0], [-1, 0, 0]]
    for level in (1, 5, geotree.LEVELS):
        code = geotree.codes(x, level)
        low, side = geotree.corners(np.full(500, level), code)
        assert (x >= low - 1e-12).all() and (x <= low + side[:, None] + 1e-12).all()
        assert (geotree.codes(x, geotree.LEVELS) >> 3 * (geotree.LEVELS - level) == code).all()


def test_blocks_need_a_few_cells_however_many_rows(spark):
    """Every block meets each site once: as a site, or in one cell's sums; and what is sent grows far slower than pairs do."""
    rng = np.random.default_rng(15)
    sent = []
    for n in (8000, 32000):
        lon, lat = places("even", n, rng)
        x = np.stack([np.cos(np.radians(lat)) * np.cos(np.radians(lon)), np.cos(np.radians(lat)) * np.sin(np.radians(lon)), np.sin(np.radians(lat))], axis=1)
        full = geotree.codes(x, geotree.LEVELS)
        kernel, cells, blocks = geotree.Kernel(6371 / 500, 1e-2), {}, set()
        for level in range(geotree.LEVELS + 1):
            code, back, count = np.unique(full >> 3 * (geotree.LEVELS - level), return_inverse=True, return_counts=True)
            for c, k in zip(code.tolist(), count.tolist(), strict=True):
                up = cells.get((level - 1, c >> 3))
                if level == 0 or up is not None and up > 2:
                    cells[level, c] = k
                if k <= 256 and (level == 0 or np.count_nonzero(full >> 3 * (geotree.LEVELS - level + 1) == c >> 3) > 256):
                    blocks.add((level, c))
        tree = geotree.Blocks(sorted(blocks))
        level, code = (np.array(v) for v in zip(*cells, strict=True))
        leaf = np.array([k <= 2 for k in cells.values()])
        i, to, kind = tree.needs(level, code, leaf, kernel)
        some = np.flatnonzero(tree.ends)[::40]
        for b in some:
            met = np.zeros(n, int)
            for c in i[to == b]:
                met += full >> 3 * (geotree.LEVELS - int(level[c])) == code[c]
            assert met.max() <= 1  # those of no cell are too far
            lost = x[met == 0]
            if len(lost):
                n_lost, zero = len(lost), np.zeros(len(lost))
                assert kernel.value(geotree.chords(lost, zero, np.repeat(tree.low[[b]], n_lost, 0), np.repeat(tree.side[b], n_lost))[0]).max() <= 1e-2
        assert {0, 2} & set(kind.tolist()) and 9 in kind
        size = np.where(leaf, np.array(list(cells.values())), 1)
        sent.append(size[i].sum() / tree.ends.sum())
    assert sent[1] < 3 * sent[0]


def test_plain_pairs_where_the_tree_leaves_most_of_them(spark, monkeypatch):
    rng = np.random.default_rng(14)
    lon, lat = places("even", 400, rng)
    a = rng.uniform(0, 2, (400, 2))
    long, at = frames(spark, lon, lat, a)
    at = at.unionByName(spark.createDataFrame([(400, None, 1.0)], at.schema))  # a row without a place
    long = long.unionByName(spark.createDataFrame([(400, 0, 5.0)], long.schema))
    called, plain = [], sae.monosemanticity_geo
    monkeypatch.setattr(sae, "monosemanticity_geo", lambda *args, **more: called.append(1) or plain(*args, **more))
    got = {r.neuron: r.score for r in geotree.monosemanticity_geo_tree(long, at, 2, 1e-11).collect()}
    want = exact(lon, lat, a)
    assert called and all(abs(got[j] - want[j]) < 1e-9 for j in range(2))
    assert geotree.sums_over_pairs(long, at, 2, 1e-11, most_pairs=1e4) is None and geotree.sums_over_pairs(long, at, 2, 1e-11) is not None
    got = {r.neuron: r.score for r in geotree.monosemanticity_geo_tree(long, at, 2, 1e-3, most_pairs=float("inf"), leaf_sites=4, block_sites=50).collect()}
    assert len(called) == 1 and all(abs(got[j] - want[j]) <= 1e-3 for j in range(2))

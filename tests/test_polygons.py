"""The grid index of edges against the plain ray test over all edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravec.operators import points as P
from terravec.operators import polygons


def inside(x, y, rings):
    """Even-odd over all edges; points on an edge are outside."""
    odd, edge = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y0 != y1:
                odd ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
            on = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) == 0
            edge |= on & (x >= min(x0, x1)) & (x <= max(x0, x1)) & (y >= min(y0, y1)) & (y <= max(y0, y1))
    return odd & ~edge


def coast(rng, n, centre, size, rough=0.3):
    """A ring around a centre, rougher at some places."""
    at = np.sort(np.concatenate([rng.uniform(0, 2 * np.pi, n // 2), 1 + 0.05 * rng.uniform(size=n - n // 2)]))
    r = size * (1 + rough * rng.uniform(-1, 1, n))
    return [(float(centre[0] + a * np.cos(t)), float(centre[1] + a * np.sin(t))) for a, t in zip(r, at, strict=True)]


def compared(spark, shapes, x, y):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, lon double, lat double").withColumns({c: F.lit("mine") for c in ("x", "level", "edges", "region", "pid")})
    got = {(r.id, r.region) for r in P.assign_regions(df, P.polygons_from(spark, shapes)).select("id", "region").collect()}
    want = {(i, name) for name, rings in shapes.items() for i in np.flatnonzero(inside(x, y, rings)).tolist()}
    assert got == want, (sorted(got - want)[:5], sorted(want - got)[:5])
    return got


@pytest.mark.parametrize("broadcast", [True, False])
def test_coasts_holes_and_overlaps(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(polygons, "BROADCAST_CELLS", 0)
    rng = np.random.default_rng(21)
    big = coast(rng, 3000, (10, 20), 30)
    shapes = {
        "coast": [big, coast(rng, 400, (10, 20), 8), [(12.0, 22.0), (13.0, 22.0), (13.0, 23.0)]],
        "other": [coast(rng, 700, (30, 10), 25), coast(rng, 200, (100, -40), 3)],
        "box": [[(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)]],
        "thin": [[(-179.0, 1.0), (179.0, 1.0), (179.0, 1.0000001), (-179.0, 1.0000001)]],
    }
    x, y = rng.uniform(-60, 110, 6000), rng.uniform(-50, 70, 6000)
    v = np.array(big)
    middle = (v[:-1] + v[1:]) / 2
    near = v[:500] * (1 + 1e-13) + 1e-12
    lattice = np.array([(a, b) for a in range(-6, 7) for b in range(-6, 7)], float)
    hot = np.repeat(v[:1], 800, axis=0)
    x = np.concatenate([x, v[:, 0], middle[:, 0], near[:, 0], lattice[:, 0], hot[:, 0], v[:300, 0] + 1e-6])
    y = np.concatenate([y, v[:, 1], middle[:, 1], near[:, 1], lattice[:, 1], hot[:, 1], v[:300, 1]])
    got = compared(spark, shapes, x, y)
    assert {name for _, name in got} >= {"coast", "other", "box"}


def test_dense_cells_are_divided(spark):
    rng = np.random.default_rng(22)
    bay = [(float(1 + 0.02 * (k % 2) + 1e-3 * rng.uniform()), float(1 + 1e-4 * k)) for k in range(600)]
    ring = [(0.0, 0.0), (50.0, 0.0), (50.0, 40.0), (0.0, 40.0), *reversed(bay), (0.0, 0.5)]
    index = polygons.edge_index(P.polygons_from(spark, {"bay": [ring]}))
    assert len(index.levels) > 2
    most = index.cells.select(F.max(F.size(F.element_at("held", 1)["edges"]))).first()[0]
    assert most <= polygons.CELL_EDGES
    x = np.concatenate([rng.uniform(0.99, 1.03, 3000), rng.uniform(-5, 55, 500)])
    y = np.concatenate([rng.uniform(0.99, 1.07, 3000), rng.uniform(-5, 45, 500)])
    compared(spark, {"bay": [ring]}, x, y)


def test_no_polygons_and_odd_points(spark):
    none = spark.createDataFrame([], P.POLYGONS)
    pts = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, 0.5, 0.5), (4, float("inf"), 0.5)], "id long, lon double, lat double")
    assert P.assign_regions(pts, none).count() == 0 and P.points_within(pts, none).count() == 0
    box = P.polygons_from(spark, {"a": [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]], "b": [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(2.0, 2.0)]]})
    assert sorted((r.id, r.region) for r in P.assign_regions(pts, box.union(box)).collect()) == [(3, "a")]
    index = polygons.edge_index(box.filter("region = 'a'"))
    assert [P.assign_regions(p, index).count() for p in (pts, pts.limit(0))] == [1, 0]

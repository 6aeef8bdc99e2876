"""Nearest rows, hard negatives and vector codes: brute force on small tables with ties, copies, odd rows and small blocks."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravec.llm import codes, nearest, negatives

SCHEMA = "vec_id long, embedding array<double>, label int"
ODD = [
    (9001, None, 1),
    (9002, [], 1),
    (9003, [float("nan")] * 6, 1),
    (9004, [None] + [1.0] * 5, 1),
    (9005, [float("inf")] + [0.0] * 5, 1),
    (9006, [1.0, 2.0], 1),
    (None, [1.0] * 6, 1),
]


def frame(spark, rows):
    """With columns whose names the operators use, or return."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("mine") for c in ("node", "rep", "ids", "rank", "score", "query_id", "raw", "slot", "first", "code", "error", "x", "id", "vector")})


def mixed(seed, n=160, whole=False):
    """Clusters, whole groups of copies, vectors on a grid (so that distances tie), a zero vector and a repeated row."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n // 2, 6)), rng.integers(-2, 3, (n // 2, 6)) / 2.0])
    x[10:40] = x[10]
    x[n - 5 :] = x[n - 6] + 1e-9 * rng.normal(size=(5, 6))
    x[50] = 0
    ids = rng.permutation(np.arange(0, 7 * n, 7))
    rows = [(int(i), [float(v) for v in r], int(rng.integers(0, 3)) if k % 29 else None) for k, (i, r) in enumerate(zip(ids, x, strict=True))]
    return rows + [rows[3]]


def usable(rows):
    return {(i, tuple(v), label) for i, v, label in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}


@pytest.mark.parametrize("most", [65_536, 7])
def test_nearest(spark, monkeypatch, most):
    monkeypatch.setattr(nearest, "BLOCK_MOST", most)
    monkeypatch.setattr(nearest, "SLICE_COLUMNS", 16)
    rows = mixed(1)
    got = {}
    for r in nearest.nearest(frame(spark, rows + ODD), k=10, every=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    points = {i: np.array(v) for i, v, _ in usable(rows) if any(v)}
    assert set(got) == {i for i in points if i % 5 == 0}
    for q, found in got.items():
        want = sorted((float(np.sqrt(((points[q] - v) ** 2).sum())), i) for i, v in points.items() if i != q)[:10]
        assert [(k, i) for k, i, _ in sorted(found)] == [(k + 1, i) for k, (_, i) in enumerate(want)]
        assert np.allclose([d for _, _, d in sorted(found)], [d for d, _ in want], rtol=1e-12, atol=0)


def test_nearest_of_few_and_none(spark):
    assert nearest.nearest(frame(spark, [])).count() == 0
    assert nearest.nearest(frame(spark, [(1, [1.0], 0), (2, [2.0], 0)])).count() == 0  # no queries
    out = nearest.nearest(frame(spark, [(100, [1.0], 0), (2, [2.0], 0), (2, [2.0], 0), (200, [-0.0, 1.0], 0)])).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [(100, 1, 2, 1.0)]
    # far beyond single precision, and beyond the squares that doubles hold
    big = nearest.nearest(frame(spark, [(100, [1e200], 0), (1, [-1e200], 0), (2, [1e200], 0), (3, [1e-200], 0)])).collect()
    assert [(r.vec_id, r.score) for r in sorted(big, key=lambda r: r["rank"])] == [(2, 0.0), (1, float("inf")), (3, float("inf"))]


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for scale in (1e-12, 1.0, 1e9):
        a, b = rng.normal(size=(40, 1500)) * scale, rng.normal(size=(60, 1500)) * scale * 3
        b[:20] = a[:20] * (1 + 1e-7)
        lower, upper = nearest.bounds(nearest.rounded(a), nearest.rounded(b))
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
        assert (lower <= d).all() and (d <= upper).all() and (upper - lower <= 0.05 * (np.linalg.norm(a, axis=1)[:, None] + np.linalg.norm(b, axis=1))).all()


def brute_negatives(rows, every):
    items = {(i, label, tuple(int(np.floor(256 * x)) for x in v)) for i, v, label in usable(rows) if label is not None}
    out = []
    for a, la, va in items:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, label == la) for i, label, v in items if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            hard = [(t, i) for t, i, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"leaf_rows": 8, "tile_rows": 5}, {"leaf_rows": 8, "sample_rows": 40}])
def test_negatives(spark, sizes):
    rows = mixed(2)
    got = negatives.mined(frame(spark, rows + ODD), every=10, **sizes)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10) != []


def test_negatives_of_few_and_none(spark):
    assert negatives.mined(frame(spark, [])).count() == 0
    assert negatives.mined(frame(spark, [(1, [1.0], 0)])).count() == 0  # no anchors
    assert negatives.mined(frame(spark, [(50, [1.0], 0), (51, [0.5], 1)])).count() == 0  # no positives
    out = negatives.mined(frame(spark, [(50, [1.0], 0), (51, [1.0], 0), (52, [0.75], 1), (53, [0.75], 1), (54, [1.0], 1), (55, [1e300], 1)])).collect()
    assert sorted(map(tuple, out)) == [(50, 51, 1, 52, 65536, 49152), (50, 51, 2, 53, 65536, 49152)]


def test_tree_holds_all_and_skips_nothing_that_counts():
    rng = np.random.default_rng(4)
    centres = rng.integers(-300, 300, (12, 8))
    x = (centres[rng.integers(0, 12, 3000)] + rng.integers(-20, 21, (3000, 8))).astype(np.int64)
    label = rng.integers(0, 4, 3000)
    tree = negatives.Tree(x[:600], 20)
    ranges: dict = {}
    leaf = tree.route(x, label, ranges)
    for n, seen in ranges.items():
        tree.nodes[n].widen({c: getattr(seen, c) for c in (*negatives.Node.LOWER, *negatives.Node.UPPER)})
    assert tree.leaves > 30
    a, la = x[::100], label[::100]
    scores = a @ x.T
    least, most = np.sort(scores, axis=1)[:, -40].astype(float), np.sort(scores, axis=1)[:, -10].astype(float)
    for same in (True, False):
        visits = tree.visits(a, la, least, most, same)
        inside = (scores >= least[:, None]) & (scores <= most[:, None]) & ((la[:, None] == label[None]) == same)
        assert all(visits[i, leaf[j]] for i, j in zip(*np.nonzero(inside), strict=True))
        assert visits.mean() < 0.5  # and it does skip


def plain_codes(rows, dims=6, parts=3, entries=4, rounds=6):
    items = sorted(((i is None, i or 0), tuple(int(np.floor(4096 * x)) for x in v), label) for i, v, label in rows if v and len(v) == dims and all(x is not None and np.isfinite(x) for x in v))
    x = np.array([v for _, v, _ in items])
    cuts = codes.slices(dims, parts)
    books = [x[:entries, s].copy() for s in cuts]
    for r in range(rounds + 1):
        d = [((x[:, None, s] - b[None]) ** 2).sum(axis=2) for s, b in zip(cuts, books, strict=True)]
        code = [v.argmin(axis=1) for v in d]
        if r < rounds:
            for s, b, c in zip(cuts, books, code, strict=True):
                for e in range(len(b)):
                    if (c == e).any():
                        b[e] = x[c == e, s].sum(axis=0) // int((c == e).sum())
    error = sum(v.min(axis=1) for v in d)
    by = {}
    for (_, _, label), e in zip(items, error, strict=True):
        by[label] = by.get(label, 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    return sorted((None if null else i, "".join(f"{c[k]:02x}" for c in code), int(error[k]), by[label], digest) for k, ((null, i), _, label) in enumerate(items))


@pytest.mark.parametrize("block", [4096, 9])
def test_codes(spark, monkeypatch, block):
    monkeypatch.setattr(codes, "BLOCK_ROWS", block)
    monkeypatch.setattr(codes, "HOT", 0.3)
    rows = mixed(5) + [r for r in ODD if r[0] is not None]
    got = codes.compressed(frame(spark, rows), parts=3, entries=4)
    assert sorted(map(tuple, got.collect())) == plain_codes(rows)


def test_codes_of_few_and_none(spark):
    assert codes.compressed(frame(spark, [])).count() == 0
    assert codes.compressed(frame(spark, ODD[:5])).count() == 0
    few = [(1, [1.0, 2.0, 3.0], None), (2, [1.0, 2.0, 3.0], None), (None, [0.0, -2.5, 3.0], 1), (4, [1e300, 0.0, 0.0], 1), (5, [float("nan")] * 3, 1)]
    got = {r.vec_id: r for r in codes.compressed(frame(spark, few)).collect()}
    assert set(got) == {1, 2, None} and got[1].code == got[2].code == "00" * 8 and all(r.error == 0 for r in got.values())
    assert got[None].code == "0202" + "00" * 6 and got[None].codebooks_sha256  # the third part is equal in all three, the rest is empty


def test_only_moved_entries_are_compared():
    rng = np.random.default_rng(6)
    x, entries = rng.integers(-30, 31, (4000, 2)), rng.integers(-30, 31, (16, 2))
    code, stored = codes.assign(x, entries, np.ones(16, bool), None, None)
    for _ in range(30):
        moved = rng.random(16) < 0.2
        entries = np.where(moved[:, None], rng.integers(-30, 31, (16, 2)), entries)
        code, stored = codes.assign(x, entries, moved, code, stored)
        d = codes.squares(x, entries)
        assert (code == d.argmin(axis=1)).all() and (stored == d.min(axis=1)).all()

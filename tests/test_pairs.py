"""Pairs of a broadcast side, rounding as the SQL has it, and maps that take no shuffle of pairs."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terravec.operators import joins, pairs, saliency
from terravec.plans import base, q_joins, q_saliency, q_splice

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounding_is_that_of_duckdb_at_ties(spark):
    values = [k * 5e-7 for k in range(-999, 1000, 2)] + [0.49999999999999994e-6, -1e-9, 4.6e9 + 1 / 3, 1e305, math.inf]
    want = [r[0] for r in duckdb.execute("SELECT round(unnest(?), 6) + 0.0", [values]).fetchall()]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").orderBy("i")
    assert [r[0] for r in df.select(base.r6(F.col("v"))).collect()] == want
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS v").select(base.r6(F.col("v"))).first()[0] is None


def test_large_crosses_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TASK_PAIRS", 50)
    for query in (q_joins.j5, q_joins.j5b, q_joins.j12):
        got = query(spark, SMALL)
        assert got.rdd.getNumPartitions() > 4, _plan(got)  # the tables are one file of one row group


@pytest.mark.parametrize("most", [10, 1])
def test_pairs_have_the_values_of_plain_loops(spark, monkeypatch, most):
    v = [[1.0, 2.0], [1.0, 2.0 + 1e-5], [0.0, 0.0], None, [3.0, None], [3.0], [math.inf, 0.0], [-3e5, 4e5]]
    df = spark.createDataFrame(list(enumerate(v)), "id long, embedding array<double>")
    got = {(r.id, r.other): r.dist for r in joins.pairwise_euclidean(df, df, "id", "embedding", 10 if most > 1 else 1).collect()}
    ok = lambda x: x is not None and None not in x
    assert len(got) == 64
    for i, x in enumerate(v):
        for j, y in enumerate(v):
            if not (ok(x) and ok(y) and len(x) == len(y)):
                assert got[i, j] is None, (i, j)
            elif i == j == 6:
                assert math.isnan(got[i, j])
            else:
                assert got[i, j] == pytest.approx(math.dist(x, y), rel=1e-12, abs=1e-15), (i, j)
    places = df.withColumnRenamed("id", "place")
    logits = {(r.id, r.place): r.logit for r in joins.similarity_logits(df.filter("id <> 6"), places.filter("place <> 6"), 0.5, "id", "place", most).collect()}
    assert logits[0, 7] == pytest.approx(math.exp(0.5) * 5e5 / (5**0.5 * 5e5)) and logits[0, 3] is None and logits[0, 5] is None and logits[0, 2] == 0
    p = spark.createDataFrame([(1, 10.0, 50.0), (2, -170.0, -50.0), (3, None, 1.0), (4, 10.0, 50.0)], "id long, lon double, lat double")
    km = {(r.id, r.other): r.km for r in joins.pairwise_haversine(p, p, "id", max_rows=most).collect()}
    assert len(km) == 16 and km[1, 4] == 0 and km[1, 2] == pytest.approx(math.pi * 6372.8) and km[1, 3] == km[3, 3] == pytest.approx(math.pi * 6372.8)  # least() passes nulls over, in the SQL too


def test_a_stream_is_cut_between_groups():
    import pyarrow as pa

    t = pa.table({"k": [1, 1, 2, 2, 2, 2, 3, 4, 4], "x": range(9)})
    for size in (1, 2, 3, 9):
        got = list(pairs.groups(iter(t.to_batches(size)), "k"))
        seen = [set(g.column("k").to_pylist()) for g in got]
        assert pa.concat_tables(got).combine_chunks() == t and sum(map(len, seen)) == 4


def test_weights_below_half_the_last_digit_stay(spark, monkeypatch):
    """A weight of 3e-7 is over the bound, though its six decimals are 0."""
    h = np.array([[(1 - 2 * (bin(k & j).count("1") % 2)) / 8 for j in range(64)] for k in range(64)])
    w = np.array([0.0875 + 3e-7, 0.0])
    w[1] = math.sqrt(1 - w[0] ** 2)
    row = spark.createDataFrame([(1, 0, (w @ h[:2]).tolist())], "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(q_splice, "_vectors", lambda *_: row)
    got = {r.concept_id: r.weight for r in q_splice.u3_split(spark, SMALL).collect()}
    assert got == {0: 0.0, 1: pytest.approx(w[1] - 0.0875, abs=1e-6)}


def test_similarity_maps_take_no_shuffle_of_pairs(spark, monkeypatch):
    for query in (q_saliency.u12, q_saliency.u12b):
        plan = _plan(query(spark, SMALL))
        assert "Pandas" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1, plan
    g = np.random.default_rng(5)
    rows = [(t, k, g.normal(size=3).tolist()) for t, n in ((0, 9), (1, 4), (2, 5), (3, 4)) for k in range(n + 1)]
    rows += [(3, 5, None), (4, 1, [1.0, 0.0, 0.0]), *((5, k, [1.0, 2.0, 3.0]) for k in range(1, 5))]  # a row without a vector, one patch, a flat tile
    patches = spark.createDataFrame(rows, "tile long, pos int, vec array<double>")
    places = spark.createDataFrame([(k, g.normal(size=3).tolist()) for k in range(5)], "location_id long, vec array<double>")
    red = F.array(*map(F.lit, [0.1, 0.2, 0.3]))
    for of, keys in ((saliency.surgery_similarity, ["tile", "location_id", "pos"]), (lambda *a: saliency.resized_similarity(*a[:3], 3, 2, *a[3:]), ["tile", "location_id", "y", "x"])):
        got, want = ({tuple(r[k] for k in keys): r.value for r in of(patches, places, red, most).collect()} for most in (10, 1))
        assert got.keys() == want.keys() and len(got) > 100
        for k in got:
            assert got[k] == pytest.approx(want[k], abs=1e-12, nan_ok=True), k


def test_small_maps_are_dealt_and_made_once(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TASK_PAIRS", 1152)
    assert q_saliency.heat(spark, SMALL).rdd.getNumPartitions() == 10  # ten suppliers of 8 x 12 x 12 values in one row group
    for query in (q_saliency.u13, q_saliency.u14, q_saliency.u14_whole):
        plan = _plan(query(spark, SMALL))
        assert "Generate" not in plan and "Pandas" not in plan, plan  # the sums of layers were kept
    one = q_saliency.heat(spark, SMALL)
    assert "ENSURE_REQUIREMENTS" not in _plan(q_saliency.a20(spark, SMALL)) and one.count() == 11520


def test_tiles_of_a_stream_keep_to_themselves(spark):
    rows = [(t, y, x, int(0 < y < 4 and 0 < x < 4 + (t or 0) % 3)) for t in (None, *range(40)) for y in range(5) for x in range(5 + (t or 0) % 3)]
    masks = spark.createDataFrame(rows, "tile long, y int, x int, mask int")
    got = saliency.open_mask(masks, 3).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in masks.collect())  # a full rectangle is open
    boxes = {r.tile: (r.x, r.y, r.w, r.h, r.area) for r in saliency.saliency_boxes(masks, 1 << 20).collect()}
    assert boxes == {t: (1, 1, 3 + (t or 0) % 3, 3, 9 + 3 * ((t or 0) % 3)) for t in (None, *range(40))}
    assert saliency.saliency_boxes(masks.withColumn("mask", F.lit(0)), 4).count() == 0

"""What SQL can't say: agreement of solvers, exact samples, invariance under partitioning, edge rows, streams."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravec.functions import arrays, encodings, geo, text
from terravec.operators import align, cluster, filters, joins, nets, saliency, sampling, splice, vectors
from terravec.operators import points as P
from terravec.operators import sae
from terravec.operators.graph import components
from terravec.sources import io
from terravec.streaming import stream


def dictionary(n=12, d=8, seed=0):
    rng = np.random.default_rng(seed)
    return splice.unit(rng.normal(size=(n, d)))


def test_admm_equals_lasso_and_is_optimal():
    c = dictionary()
    v = splice.unit(np.random.default_rng(1).normal(size=(30, 8)))
    a, b = splice.admm(c, v), splice.lasso(c, v)
    obj = lambda w: ((w @ c - v) ** 2).sum(axis=1) + splice.L1 * w.sum(axis=1)
    assert np.abs(obj(a) - obj(b)).max() < 1e-5 and (a >= 0).all()
    grad = 2 * (b @ c - v) @ c.T + splice.L1
    assert grad[b == 0].min() > -1e-4 and np.abs(grad[b > 1e-6]).max() < 1e-4


def test_admm_rows_do_not_depend_on_their_batch():
    c, v = dictionary(), splice.unit(np.random.default_rng(2).normal(size=(9, 8)))
    whole = splice.admm(c, v)
    assert np.allclose(whole, np.concatenate([splice.admm(c, v[i : i + 1]) for i in range(9)]), atol=1e-9)


def test_harmonics_are_orthonormal():
    n = 400
    x, w = np.polynomial.legendre.leggauss(40)
    lon = np.repeat(np.linspace(-180, 180, n, endpoint=False), 40)
    lat = np.tile(np.degrees(np.arccos(x)) - 90, n)
    y = encodings.harmonics(lon, lat, 5) * np.sqrt(np.tile(w, n) * 2 * math.pi / n)[:, None]
    assert np.abs(y.T @ y - np.eye(25)).max() < 1e-9


@given(st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=3, max_size=3))
@settings(max_examples=30, deadline=None)
def test_unit_rows_have_norm_one(v):
    n = np.linalg.norm(splice.unit(np.array([v])))
    assert abs(n - 1) < 1e-9 or np.linalg.norm(v) < 1e-9


def test_splits_are_exact_and_the_same_under_any_partitioning(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    a = P.split_train_val_test(df, 0.1, 0.1, "k")
    counts = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert counts == {"test": 101, "val": 91, "train": 811}
    b = P.split_train_val_test(df.repartition(7), 0.1, 0.1, "k")
    assert a.join(b.withColumnRenamed("split", "other"), "k").filter("split != other").count() == 0 and b.count() == 1003
    assert {r.k for r in P.sample_n(df, 50, "k").collect()} == {r.k for r in P.sample_n(df.repartition(5), 50, "k").collect()}
    assert P.split_train_val(df.limit(0), 0.1, "k").count() == 0


def test_sphere_draws(spark):
    d = P.sphere_points(spark, 4000, lat_range=(-60.0, 90.0)).toPandas()
    assert d.lat.min() >= -60 and d.lon.between(-180, 180).all() and abs((d.lat > 30).mean() - 0.5 / (1 + math.sin(math.pi / 3))) < 0.03


def test_polygon_edges_are_outside(spark):
    shape = P.polygons_from(spark, {"box": [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]})
    pts = spark.createDataFrame([(1, 3.0, 3.0), (2, 4.0, 2.0), (3, 1.5, 1.5), (4, 9.0, 9.0), (5, 0.0, 0.0)], "point_id int, lon double, lat double")
    assert [r.point_id for r in P.points_within(pts, shape).collect()] == [1]
    assert P.points_within(pts.limit(0), shape).count() == 0


def test_tiny_polygon_gets_its_centroid(spark):
    g = P.grid_in_polygon(P.polygons_from(spark, {"tiny": [[(0.1, 0.1), (0.3, 0.1), (0.3, 0.3), (0.1, 0.3)]]}), 0.5).collect()
    assert len(g) == 1 and abs(g[0].lon - 0.2) < 1e-9


def test_bad_coordinates(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, float("nan"), 1.0)], "k int, lon double, lat double")
    assert [r.k for r in P.drop_bad_coords(df).collect()] == [1]
    km = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("km")).first().km
    assert abs(km - math.pi * geo.EARTH_KM) < 1e-6


def activations(spark, n=60, neurons=5, seed=3):
    rng = np.random.default_rng(seed)
    a = np.maximum(rng.normal(size=(n, neurons)), 0)
    a[:, 3] = 0
    a[0, 3] = 1.0
    rows = [(i, j, float(a[i, j])) for i in range(n) for j in range(neurons) if a[i, j] > 0]
    return a, spark.createDataFrame(rows, "point_id long, neuron int, act double")


def test_pair_scores_equal_the_loop(spark):
    a, long = activations(spark)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6))
    lon, lat = rng.uniform(-180, 180, 60), rng.uniform(-90, 90, 60)
    e = spark.createDataFrame([(i, [float(v) for v in x[i]], float(lon[i]), float(lat[i])) for i in range(60)], "point_id long, embedding array<double>, lon double, lat double")
    u = splice.unit(x)
    pairs = [(i, j) for i in range(60) for j in range(i + 1, 60)]

    def km(i, j):
        p, q = np.radians([lat[i], lon[i]]), np.radians([lat[j], lon[j]])
        h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
        return 2 * 6371 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))

    visual = {r.neuron: r.score for r in sae.monosemanticity_visual(long, e).collect()}
    for blocks in (1, 4):
        geo_scores = {r.neuron: r.score for r in sae.monosemanticity_geo(long, e, 5, blocks=blocks).collect()}
        for n in range(5):
            weight = sum(a[i, n] * a[j, n] for i, j in pairs)
            if n == 3:
                assert visual[n] is None and geo_scores[n] is None
                continue
            assert abs(visual[n] - sum(a[i, n] * a[j, n] * (u[i] @ u[j]) for i, j in pairs) / weight) < 1e-9
            assert abs(geo_scores[n] - sum(a[i, n] * a[j, n] * math.exp(-km(i, j) / 500) for i, j in pairs) / weight) < 1e-9


def test_scaling_counts_implicit_zeros(spark):
    long = spark.createDataFrame([(0, 0, 2.0), (1, 0, 4.0), (0, 1, 3.0), (1, 1, 3.0), (0, 2, 5.0)], "point_id long, neuron int, act double")
    got = {(r.point_id, r.neuron): r.act for r in sae.minmax_scale_columns(long, 2).collect()}
    assert got == {(0, 0): 0.0, (1, 0): 1.0, (0, 2): 1.0}


def test_batch_topk_keeps_as_many_as_there_are(spark):
    _, long = activations(spark)
    b = long.withColumn("batch_id", F.floor(F.col("point_id") / 20))
    sizes = spark.createDataFrame([(0, 20), (1, 20), (2, 20)], "batch_id long, n int")
    n = b.groupBy("batch_id").count().toPandas().set_index("batch_id")["count"]
    for k in (1, 50):
        kept = sae.batch_topk(b, sizes, k, "point_id").groupBy("batch_id").count().toPandas().set_index("batch_id")["count"]
        assert all(kept[i] == min(20 * k, n[i]) for i in range(3))


def test_top_rows_do_not_depend_on_salts(spark):
    _, long = activations(spark)
    key = lambda s: sorted(map(tuple, sae.top_rows_per_feature(long, 4, salts=s).select("neuron", "rank", "point_id").collect()))
    assert key(1) == key(5)


def test_class_ranks_and_precision(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 500), np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([(i, 0, int(y[i]), float(s[i])) for i in range(500)], "row_id int, class int, y_true int, score double")
    order = sorted(range(500), key=lambda i: (-s[i], i))
    tp = np.cumsum(y[order])
    want = (tp / np.arange(1, 501) * y[order]).sum() / y.sum()
    assert abs(sampling.average_precision(df).first().ap - want) < 1e-9
    one = sampling.average_precision(df.filter("row_id < 1").withColumn("y_true", F.lit(1))).first()
    assert one.ap == 1.0


def test_clip_loss_of_one_row_is_zero(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0], 0)], "vec_id long, text_vec array<double>, loc_vec array<double>, batch_id long")
    assert align.clip_loss(df, "vec_id", 10.0).first().loss == 0.0
    assert abs(align.clip_loss_columns(df, "vec_id", 10.0).first().loss) < 1e-12


def test_candidates_and_bounds(spark):
    places = spark.createDataFrame([("a",), ("z",)], "id string")
    c = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0)], "id string, row int, lon double")
    assert [tuple(r) for r in joins.match_candidates(places, c).collect()] == [("a", 20.0)]
    with pytest.raises(ValueError):
        joins._bounded(spark.range(10), 5)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (5, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dbscan_border_and_noise(spark):
    pts = [(i, 0.1 * i, 0.0) for i in range(6)] + [(10 + i, 5 + 0.1 * i, 0.0) for i in range(6)] + [(20, 0.7, 0.0), (30, 50.0, 50.0)]
    out = {r.row_id: r.cluster for r in cluster.dbscan(spark.createDataFrame(pts, "row_id long, x double, y double"), 0.25, 4).collect()}
    assert out[0] == 0 and out[12] == 1 and out[20] == 0 and out[30] == -1


def test_masks_and_boxes():
    m = np.zeros((12, 12), dtype=np.int64)
    m[1:6, 1:6] = 1
    m[8, 8] = m[9, 9] = 1
    n, labels = saliency.blobs(m)
    assert n == 2 and labels[9, 9] == labels[8, 8] != labels[1, 1]
    assert (saliency.dilate(saliency.erode(m)) == np.pad(np.ones((5, 5), int), ((1, 6), (1, 6)))).all()
    split = saliency.split_by_erosion(m, 10)
    assert split[3, 3] == 1 and split[1, 1] == 0 and split[8, 8] == 1 and split.sum() == 9 + 2


def test_open_mask_edge_sizes(spark):
    df = spark.createDataFrame([(1, y, x, 1) for y in range(3) for x in range(3)], "tile int, y int, x int, mask int")
    assert saliency.open_mask(df, 1).agg(F.sum("mask")).first()[0] == 9
    assert saliency.open_mask(df, 2).agg(F.sum("mask")).first()[0] == 9
    assert saliency.saliency_boxes(df, 100).first().area == 9


def test_geometric_median(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 0.0],), ([0.0, 1.0],), ([0.2, 0.2],)], "v array<double>")
    m = vectors.geometric_median(df, "v")
    x = np.array([[0, 0], [1, 0], [0, 1], [0.2, 0.2]])
    cost = lambda p: np.linalg.norm(x - p, axis=1).sum()
    assert all(cost(m) <= cost(m + d) + 1e-4 for d in np.array([[0.01, 0], [-0.01, 0], [0, 0.01], [0, -0.01]]))


def test_text_columns(spark):
    with pytest.raises(ValueError):
        filters.check_schema(spark.range(1))
    with pytest.raises(ValueError):
        filters.check_schema(spark.sql("select 1.0 lat, 2.0 lon"))
    both = spark.sql("select 1.0 lat, 2.0 lon, 'c' caption, 't' text")
    assert filters.with_text(both).first().text == "t"
    assert spark.range(1).select(text.stem(F.lit("a/b.c/d.tar.gz")).alias("s")).first().s == "d.tar"
    assert spark.range(1).select(text.neuron_label(F.lit("act12")).alias("s")).first().s == "Neuron 11"


def test_reports(spark, tmp_path):
    r = spark.createDataFrame([("a", "d", 0.1), ("a", "e", 0.2)], "model string, dataset string, l1_penalty double")
    with pytest.raises(ValueError):
        splice.check_single_lambda(r)
    io.write_report(r.limit(1).select("l1_penalty"), f"{tmp_path}/a__d.json")
    assert io.read_reports(spark, str(tmp_path), ["a"], ["d"]).count() == 1
    with pytest.raises(FileNotFoundError):
        io.read_reports(spark, str(tmp_path), ["a"], ["d", "e"])
    with pytest.raises(FileNotFoundError):
        io.read_geotext(spark, str(tmp_path), "train")


def test_geotext_falls_back_to_a_split(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("double").alias("lat"), F.lit(1.0).alias("lon"), F.lit("t").alias("text")).write.parquet(f"{tmp_path}/data.parquet")
    assert [io.read_geotext(spark, str(tmp_path), s).count() for s in ("train", "val", "test")] == [81, 9, 10]


def test_networks_and_null_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "k int, v array<double>")
    net = nets.linear(np.eye(2), np.zeros(2), unit=False)
    out = {r.k: r.embedding for r in nets.apply_net(df, net, "v").collect()}
    assert out == {1: [1.0, 2.0], 2: None}
    g = spark.range(1).select(nets.activation(F.lit(1.0), "gelu").alias("g")).first().g
    assert abs(g - 0.841345) < 1e-5


def test_zero_vector(spark):
    v = spark.sql("select array(0D, 0D) v")
    assert v.select(arrays.l2_normalize(F.col("v")).alias("u")).first().u == [0.0, 0.0]
    assert v.select(arrays.cosine(F.col("v"), F.col("v")).alias("c")).first().c == 0.0


def test_streams_in_micro_batches_equal_the_batch(spark, tmp_path):
    rows = [(s, n, 10, (s * 7 + n) % 5 == 0) for s in range(30) for n in range(3)]
    log = spark.createDataFrame(rows, "step long, neuron int, batch_size int, fired boolean")
    for k in range(3):
        log.filter(F.floor(F.col("step") / 10) == k).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    read = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    got = stream.run_to_table(stream.stream_rows_since_fired(read, 20), "since_fired", "append", f"{tmp_path}/ck")
    want = sae.rows_since_fired(log, 20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("neuron", "step", "since", "dead").collect()))


def test_cluster_summary_lists_all_members(spark):
    rows = [(k % 2 - 1 if k < 5000 else 7, f"t{k % 7}", str(k)) for k in range(5003)]
    labelled = spark.createDataFrame(rows, "cluster int, tile string, file string").repartition(5)
    want = {c: sorted(f"{t}__{f}" for x, t, f in rows if x == c) for c in (-1, 0, 7)}
    got = {r.cluster: r for r in cluster.cluster_summary(labelled).collect()}
    assert {c: (r.name, r.n, r.members) for c, r in got.items()} == {c: ({-1: "noise"}.get(c, f"cluster_{c:02d}"), len(m), ",".join(m)) for c, m in want.items()}
    members = sorted(map(tuple, cluster.cluster_members(labelled).collect()))
    assert members == [(c, k, m) for c in (-1, 0, 7) for k, m in enumerate(want[c])]


def test_whole_tables_of_distances_and_logits(spark):
    rng = np.random.default_rng(3)
    e, lon, lat = rng.normal(size=(40, 4)), rng.uniform(-180, 180, 40), rng.uniform(-90, 90, 40)
    rows = [(k, e[k].tolist(), float(lon[k]), float(lat[k])) for k in range(40)]
    t = spark.createDataFrame(rows, "id long, embedding array<double>, lon double, lat double").repartition(3)
    far = joins.pairwise_euclidean(t, t, "id", "embedding", max_rows=10)
    assert "CartesianProduct" in far._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.other): r.dist for r in far.collect()}
    assert len(got) == 1600 and all(abs(d - np.linalg.norm(e[i] - e[j])) < 1e-9 for (i, j), d in got.items())
    few, many = (sorted(map(tuple, joins.pairwise_haversine(t, t, "id", max_rows=n).collect())) for n in (100, 10))
    assert few == many and len(many) == 1600
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    logits = joins.similarity_logits(t.withColumnRenamed("id", "image_id"), t.withColumnRenamed("id", "place_id"), 1.0, max_places=10).collect()
    assert len(logits) == 1600 and all(abs(r.logit - math.e * (u[r.image_id] @ u[r.place_id])) < 1e-9 for r in logits)


def test_appended_streams_do_not_go_to_the_driver(spark, tmp_path):
    rows = [(s, s % 2, 3, s % 7 == 0, float((s * 37) % 11)) for s in range(400)]
    log = spark.createDataFrame(rows, "step long, neuron int, batch_size int, fired boolean, value double")
    log.repartition(4, "value").write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)  # several frames a key
    old, stream.OUT_ROWS = stream.OUT_ROWS, 30
    try:
        read = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
        got = stream.run_to_table(stream.stream_rows_since_fired(read, 20), "since_parts", "append", f"{tmp_path}/ck")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sae.rows_since_fired(log, 20).select("neuron", "step", "since", "dead").collect()))
        runs = read.select(F.col("neuron").alias("run"), F.floor(F.col("step") / 4).alias("step"), "value")
        ema = stream.run_to_table(stream.stream_threshold_ema(runs, after=5), "ema_parts", "append", f"{tmp_path}/ck2")
        least = {(r, k): min(x[4] for x in rows if x[1] == r and x[0] // 4 == k) for r in (0, 1) for k in range(6, 100)}
        for r in (0, 1):
            want = sae.ema(np.array([least[r, k] for k in range(6, 100)]), sae.EMA_BETA, None)
            assert np.allclose([x.threshold for x in ema.filter(F.col("run") == r).orderBy("step").collect()], want)
        for name, table in (("since_parts", got), ("ema_parts", ema)):
            assert not spark.catalog.tableExists(name) and table.inputFiles()
        none = stream.run_to_table(stream.stream_threshold_ema(runs, after=1000), "ema_none", "append", f"{tmp_path}/ck3")
        assert none.count() == 0
    finally:
        stream.OUT_ROWS = old
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("eps, least", [(0.3, 4), (0.5, 5), (0.1, 3)])
def test_dbscan_against_brute_force(spark, eps, least):
    rng = np.random.default_rng(int(eps * 10))
    at = np.concatenate([rng.normal(0, 1, (150, 2)) * 0.3, rng.uniform(-5, 5, (150, 2)), np.round(rng.uniform(-3, 3, (60, 2)), 1)])
    got = {r[0]: r[1] for r in cluster.dbscan(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(at)], "row_id long, x double, y double"), eps, least).collect()}
    near = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2)) <= eps
    core, label, k = near.sum(axis=1) >= least, np.full(len(at), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], k
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = k
                    todo.append(j)
            k += 1
    want = {i: int(label[i] if core[i] else min(label[near[i] & core], default=-1)) for i in range(len(at))}
    assert got == want


def test_eps_neighbors_of_split_cells(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 0.3, (120, 2)))]
    df = spark.createDataFrame(rows, "row_id long, x double, y double")
    found = [sorted(map(tuple, joins.eps_neighbors(df, 0.25, per_cell=n).collect())) for n in (4096, 7)]
    assert found[0] == found[1] == sorted((i, j) for i, a, b in rows for j, c, d in rows if ((a - c) ** 2 + (b - d) ** 2) ** 0.5 <= 0.25)


def test_rows_since_fired_in_ranges(spark):
    rng = np.random.default_rng(9)
    rows = [(k, s, int(rng.integers(1, 9)), bool(rng.random() < 0.1)) for k in range(3) for s in range(50)]
    log = spark.createDataFrame(rows, "neuron int, step long, batch_size int, fired boolean")
    found = [sorted(map(tuple, sae.rows_since_fired(log, 20, steps=n).collect())) for n in (10_000, 7, 1)]
    want = []
    for k in range(3):
        seen = last = 0
        for _, s, n, fired in [r for r in rows if r[0] == k]:
            seen += n
            last = seen if fired else last
            want.append((k, s, seen - last, seen - last >= 20))
    assert found[0] == found[1] == found[2] == sorted(want)

"""Queries of sparse features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from terravec.operators import geotree, sae
from terravec.plans.base import entries, located, query, r6, sql_points, table
from terravec.plans.q_points import LONG, long_activations

N, D = 24, 64
_W = "(((i * 31 + j * 17 + 5) % 23) / 23.0 - 0.5)"
_BE, _BD = "(((i * 7) % 11) / 110.0 - 0.05)", "(((j * 5) % 13) / 130.0)"
THRESHOLD = 0.3


def params() -> sae.Params:
    i, j = np.arange(N)[:, None], np.arange(D)[None]
    w = ((i * 31 + j * 17 + 5) % 23) / 23.0 - 0.5
    return sae.Params(w, (np.arange(N) * 7 % 11) / 110.0 - 0.05, w.T.copy(), (np.arange(D) * 5 % 13) / 130.0, THRESHOLD, 4)


PARAMS = f"""x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
we AS (SELECT i, j, {_W} AS w FROM range({N}) AS a(i), range({D}) AS b(j)), nd AS (SELECT i, sqrt(sum(w * w)) AS n FROM we GROUP BY i),
pre AS (SELECT vec_id, i, sum(w * (x - {_BD})) + any_value({_BE}) AS a FROM x JOIN we USING (j) GROUP BY vec_id, i),
act AS (SELECT vec_id, CAST(i AS INTEGER) AS neuron, a AS act FROM pre WHERE a > {THRESHOLD}), pos AS (SELECT vec_id, CAST(i AS INTEGER) AS neuron, a AS act, vec_id // 64 AS batch_id FROM pre WHERE a > 0)"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label", F.floor(F.col("vec_id") / 64).alias("batch_id"))


def _acts(spark, d):
    return sae.sae_encode(_vectors(spark, d), params(), "vec_id", "embedding")


@query("U6_sae_encode", f"WITH {PARAMS} SELECT vec_id, neuron, round(act, 6) + 0.0 AS act FROM act")
def u6(spark, d):
    return _acts(spark, d).select("vec_id", "neuron", r6(F.col("act")).alias("act"))


_DECODE = "dec AS (SELECT x.vec_id, x.j, x.x, coalesce(sum(act.act * we.w / nd.n), 0) + any_value(" + _BD.replace("j", "x.j") + ") AS y FROM x LEFT JOIN act ON act.vec_id = x.vec_id LEFT JOIN we ON we.i = act.neuron AND we.j = x.j LEFT JOIN nd ON nd.i = act.neuron GROUP BY ALL)"


@query("U7_sae_decode", f"WITH {PARAMS}, {_DECODE} SELECT vec_id, CAST(j AS INTEGER) AS i, round(y, 6) + 0.0 AS value FROM dec")
def u7(spark, d):
    return entries(sae.sae_decode(_vectors(spark, d), _acts(spark, d), params(), "vec_id"), "decoded", "vec_id")


@query("A25_sae_recon_error", f"WITH {PARAMS}, {_DECODE} SELECT round(avg(e), 6) + 0.0 AS error FROM (SELECT vec_id, sum((x - y) * (x - y)) AS e FROM dec GROUP BY vec_id)")
def a25(spark, d):
    v = _vectors(spark, d)
    return sae.sae_recon_error(v, sae.sae_decode(v, _acts(spark, d), params(), "vec_id"), "vec_id", "embedding").select(r6(F.col("error")).alias("error"))


@query("A14_sae_validation", f"""WITH {PARAMS}, {_DECODE}, b AS (SELECT vec_id // 64 AS b, j, var_samp(x - y) AS ve, var_samp(x) AS vx, avg((x - y) * (x - y)) AS m FROM dec GROUP BY ALL),
p AS (SELECT b, sum(m) AS l2, 1 - sum(ve) / sum(vx) AS frac FROM b GROUP BY b), l AS (SELECT b, avg(n) AS l0 FROM (SELECT x.vec_id // 64 AS b, x.vec_id, count(act.neuron) AS n FROM (SELECT DISTINCT vec_id FROM x) x LEFT JOIN act USING (vec_id) GROUP BY ALL) GROUP BY b)
SELECT 'threshold' AS mode, round(avg(l0), 6) + 0.0 AS l0, round(avg(l2), 6) + 0.0 AS l2, round(avg(frac), 6) + 0.0 AS frac_variance_explained FROM p JOIN l USING (b)""")
def a14(spark, d):
    out = sae.sae_validation(_vectors(spark, d), params(), "embedding").filter("mode = 'threshold'")
    return out.select("mode", *(r6(F.col(c)).alias(c) for c in ("l0", "l2", "frac_variance_explained")))


@query("W9_batch_topk", f"""WITH {PARAMS}, r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY act DESC, vec_id, neuron) AS r FROM pos), s AS (SELECT vec_id // 64 AS batch_id, count(*) AS n FROM embeddings GROUP BY ALL)
SELECT batch_id, vec_id, neuron, round(act, 6) + 0.0 AS act FROM r JOIN s USING (batch_id) WHERE r <= n * 4""")
def w9(spark, d):
    v = _vectors(spark, d)
    long = sae.sae_encode(v, params(), "vec_id", "embedding", False, ["batch_id"])
    sizes = v.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    return sae.batch_topk(long, sizes, 4, "vec_id").select("batch_id", "vec_id", "neuron", r6(F.col("act")).alias("act"))


@query("A2_norm_factor", "WITH " + sql_points("pts", "events", "event_id") + " SELECT round(sqrt(avg(m)), 6) + 0.0 AS factor FROM (SELECT point_id // 512 AS b, avg(lon * lon + lat * lat) AS m FROM pts WHERE point_id // 512 <= 10 GROUP BY b)")
def a2(spark, d):
    from terravec.plans.base import event_points

    p = event_points(spark, d).select(F.floor(F.col("point_id") / 512).alias("batch_id"), F.array("lon", "lat").alias("v"))
    return sae.norm_factor(p, "v", steps=10).select(r6(F.col("factor")).alias("factor"))


@query("A9_nonzero_counts", f"WITH {LONG} SELECT neuron, count(*) AS n FROM ac GROUP BY neuron")
def a9(spark, d):
    return sae.nonzero_counts(long_activations(spark, d))


SCALED = f"""{LONG}, st AS (SELECT neuron, CASE WHEN count(*) < (SELECT count(*) FROM embeddings) THEN 0 ELSE min(act) END AS lo, max(act) AS hi FROM ac GROUP BY neuron),
sc AS (SELECT point_id, ac.neuron, (act - lo) / (hi - lo) AS a FROM ac JOIN st USING (neuron) WHERE hi > lo)"""


def _scaled(spark, d):
    return sae.minmax_scale_columns(long_activations(spark, d).select("point_id", "neuron", "act"), table(spark, d, "embeddings").count())


@query("A10_minmax_scale_columns", f"WITH {SCALED} SELECT point_id, neuron, round(a, 6) + 0.0 AS act FROM sc")
def a10(spark, d):
    return _scaled(spark, d).select("point_id", "neuron", r6(F.col("act")).alias("act"))


VISUAL = f"""{SCALED}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
cs AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.e, b.e) AS c FROM e a JOIN e b ON a.vec_id < b.vec_id),
vs AS (SELECT x.neuron, sum(x.a * y.a * c) / sum(x.a * y.a) AS score FROM cs JOIN sc x ON x.point_id = i JOIN sc y ON y.point_id = j AND y.neuron = x.neuron GROUP BY x.neuron)"""


def _visual(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding")
    return sae.monosemanticity_visual(_scaled(spark, d), e)


@query("A11_monosemanticity_visual", f"WITH {VISUAL} SELECT neuron, round(score, 6) + 0.0 AS score FROM vs")
def a11(spark, d):
    return _visual(spark, d).select("neuron", r6(F.col("score")).alias("score"))


_GEO = (f"WITH {SCALED}, " + sql_points("pts", "embeddings", "vec_id") + """,
h AS (SELECT a.point_id AS i, b.point_id AS j, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM pts a JOIN pts b ON a.point_id < b.point_id),
k AS (SELECT i, j, exp(-2 * 6371.0 * atan2(sqrt(least(h, 1)), sqrt(greatest(1 - h, 0))) / 500.0) AS c FROM h)
SELECT x.neuron, round(sum(x.a * y.a * c) / sum(x.a * y.a), 6) + 0.0 AS score FROM k JOIN sc x ON x.point_id = i JOIN sc y ON y.point_id = j AND y.neuron = x.neuron GROUP BY x.neuron""")


def _located(spark, d):
    return located(table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id")), "point_id")


@query("A12_monosemanticity_geo", _GEO)
def a12(spark, d):
    return sae.monosemanticity_geo(_scaled(spark, d), _located(spark, d), 64).select("neuron", r6(F.col("score")).alias("score"))


@query("A12_monosemanticity_geo_tree", _GEO)
def a12_tree(spark, d):
    """By the tree, with a bound far below the digits compared."""
    return geotree.monosemanticity_geo_tree(_scaled(spark, d), _located(spark, d), 64, tau=1e-11).select("neuron", r6(F.col("score")).alias("score"))


@query("A13_score_summary", f"WITH {VISUAL} SELECT 'visual' AS metric, round(min(score), 6) + 0.0 AS min, round(max(score), 6) + 0.0 AS max, round(avg(score), 6) + 0.0 AS mean, round(stddev_samp(score), 6) + 0.0 AS std, 70 - count(score) AS dead, CAST(70 AS BIGINT) AS total FROM vs")
def a13(spark, d):
    s = sae.score_summary(_visual(spark, d), "visual", 70)
    return s.select("metric", *(r6(F.col(c)).alias(c) for c in ("min", "max", "mean", "std")), "dead", "total")


@query("L2_top_bottom_features", f"WITH {VISUAL}, t AS (SELECT 'top' AS side, neuron, score FROM vs ORDER BY score DESC, neuron LIMIT 5), b AS (SELECT 'bottom' AS side, neuron, score FROM vs ORDER BY score, neuron LIMIT 5) SELECT side, neuron, round(score, 6) + 0.0 AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM b)")
def l2(spark, d):
    return sae.top_bottom_features(_visual(spark, d), 5).withColumn("score", r6(F.col("score")))


@query("L3_top_features", f"WITH {VISUAL} SELECT neuron, round(score, 6) + 0.0 AS score FROM vs ORDER BY vs.score DESC, neuron LIMIT 7")
def l3(spark, d):
    return sae.top_features(_visual(spark, d), 7).withColumn("score", r6(F.col("score")))


@query("W3_top_rows_per_feature", f"WITH {LONG} SELECT neuron, CAST(row_number() OVER (PARTITION BY neuron ORDER BY act DESC, point_id) AS INTEGER) AS rank, point_id FROM ac QUALIFY rank <= 8")
def w3(spark, d):
    return sae.top_rows_per_feature(long_activations(spark, d), 8).select("neuron", "rank", "point_id")


@query("A15_fired_features", f"WITH {PARAMS} SELECT DISTINCT vec_id // 64 AS batch_id, neuron FROM act")
def a15(spark, d):
    return sae.fired_features(sae.sae_encode(_vectors(spark, d), params(), "vec_id", "embedding", True, ["batch_id"]))


@query("A16_min_active", f"WITH {PARAMS} SELECT b.batch_id, round(coalesce(min(act), 0), 6) + 0.0 AS min_active FROM (SELECT DISTINCT vec_id // 64 AS batch_id FROM embeddings) b LEFT JOIN act ON act.vec_id // 64 = b.batch_id GROUP BY b.batch_id")
def a16(spark, d):
    v = _vectors(spark, d)
    return sae.min_active(sae.sae_encode(v, params(), "vec_id", "embedding", True, ["batch_id"]), v).withColumn("min_active", r6(F.col("min_active")))


LOG = "lg AS (SELECT CAST(user_id % 5 AS INTEGER) AS run, event_id // 25 AS step, min(value) AS m FROM events GROUP BY ALL)"


def step_log(spark, d):
    e = table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 5).cast("int").alias("run"), F.floor(F.col("event_id") / 25).alias("step")).agg(F.min("value").alias("min_active"))


@query("W7_threshold_ema", f"""WITH {LOG}, n AS (SELECT run, step, m, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM lg WHERE step > 300)
SELECT run, step, round(pow(0.999, k) * sum((CASE WHEN k = 1 THEN 1 ELSE 0.001 END) * m * pow(0.999, -k)) OVER (PARTITION BY run ORDER BY k), 6) + 0.0 AS threshold FROM n""")
def w7(spark, d):
    return sae.threshold_ema(step_log(spark, d)).withColumn("threshold", r6(F.col("threshold")))


FIRE = "f AS (SELECT s.step, t.neuron, 25 AS batch_size, (s.step * 7 + t.neuron * 13) % 11 = 0 AS fired FROM (SELECT DISTINCT event_id // 25 AS step FROM events) s, range(6) AS t(neuron))"


@query("W8_rows_since_fired", f"""WITH {FIRE}, c AS (SELECT *, sum(batch_size) OVER (PARTITION BY neuron ORDER BY step) AS seen FROM f)
SELECT CAST(neuron AS INTEGER) AS neuron, step, since, since >= 200 AS dead FROM (SELECT neuron, step, CAST(seen - coalesce(max(CASE WHEN fired THEN seen END) OVER (PARTITION BY neuron ORDER BY step), 0) AS BIGINT) AS since FROM c)""")
def w8(spark, d):
    steps = table(spark, d, "events").select(F.floor(F.col("event_id") / 25).alias("step")).distinct()
    log = steps.withColumn("neuron", F.explode(F.array(*map(F.lit, range(6))))).select("neuron", "step", F.lit(25).alias("batch_size"), ((F.col("step") * 7 + F.col("neuron") * 13) % 11 == 0).alias("fired"))
    return sae.rows_since_fired(log, 200)

"""Queries of joins, batches, losses, class samples and precision."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terravec.operators import align, joins, metric, sampling
from terravec.operators.raster import raster_lookup
from terravec.plans.base import entries, event_points, points, query, r6, rounded, sql_entries, sql_points, table
from terravec.plans.q_points import LONG, PLANE, long_activations, plane

PTS = "WITH " + sql_points()
EVENTS = "WITH " + sql_points("pts", "events", "event_id", ", ts, user_id, value, event_type")
_E = "CAST(embedding AS DOUBLE[])"


@query("J1_match_candidates", """SELECT c_custkey, n_name AS name, arg_max(o_orderdate, o_orderkey) AS last_date FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def j1(spark, d):
    places = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("name"))
    found = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("row"), F.col("o_orderdate").alias("last_date"))
    return joins.match_candidates(places, found).select(F.col("id").alias("c_custkey"), "name", "last_date")


@query("J3_align_embeddings", f"WITH {LONG} SELECT ac.point_id, ac.neuron, round(CAST(embedding[1] AS DOUBLE) * act, 6) + 0.0 AS product FROM ac JOIN embeddings ON vec_id = point_id")
def j3(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding")
    return joins.align_embeddings(long_activations(spark, d), e).select("point_id", "neuron", r6(F.get("embedding", F.lit(0)).cast("double") * F.col("act")).alias("product"))


@query("J4_pairs_lt", f"WITH e AS (SELECT vec_id, vec_id // 50 AS cell, {_E} AS e FROM embeddings) SELECT a.vec_id AS i, b.vec_id AS j, round(list_inner_product(a.e, b.e), 6) + 0.0 AS sim FROM e a JOIN e b ON a.cell = b.cell AND a.vec_id < b.vec_id")
def j4(spark, d):
    from terravec.functions.arrays import doubles, dot

    e = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 50).alias("cell"), doubles(F.col("embedding")).alias("x"))
    return joins.pairs_lt(e, "vec_id", "cell").select("i", "j", r6(dot(F.col("left.x"), F.col("right.x"))).alias("sim"))


@query("J5_pairwise_euclidean", f"WITH e AS (SELECT vec_id, {_E} AS e FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0) SELECT e.vec_id, q.vec_id AS other, round(list_distance(e.e, q.e), 6) + 0.0 AS dist FROM e, q")
def j5(spark, d):
    """Every vector whose id is divisible by 100 against all."""
    e = table(spark, d, "embeddings")
    return joins.pairwise_euclidean(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding").withColumn("dist", r6(F.col("dist")))


@query("J5_pairwise_haversine", PTS + """, q AS (SELECT * FROM pts WHERE point_id % 100 = 0) SELECT p.point_id, q.point_id AS other,
 round(2 * 6372.8 * asin(sqrt(least(pow(sin(radians(p.lat - q.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(p.lon - q.lon) / 2), 2), 1))), 6) + 0.0 AS km FROM pts p, q""")
def j5b(spark, d):
    """Every point whose id is divisible by 100 against all."""
    p = points(spark, d)
    return joins.pairwise_haversine(p, p.filter("point_id % 100 = 0"), "point_id").withColumn("km", r6(F.col("km")))


@query("J6_knn", f"""WITH e AS (SELECT vec_id, {_E} AS e FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_distance(a.e, b.e), 6) + 0.0 AS dist FROM e a, e b)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour) AS INTEGER) AS rank, dist FROM p QUALIFY rank <= 4""")
def j6(spark, d):
    return metric.knn(table(spark, d, "embeddings"), "vec_id", "embedding", 4).select("vec_id", "rank", r6(F.col("dist")).alias("dist"))


@query("J7_eps_neighbors", f"WITH {PLANE} SELECT a.row_id, b.row_id AS other FROM pl a JOIN pl b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.25")
def j7(spark, d):
    return joins.eps_neighbors(plane(spark, d), 0.25)


_H, _W = 18, 36
_PIXEL = f"CASE WHEN (row * {_W} + col) % 17 = 0 THEN 0.0 ELSE ((row * 31 + col * 7) % 101) / 10.0 END"


def _corner(r: str, c: str) -> str:
    return _PIXEL.replace("row", r).replace("col", c)


@query("J8_raster_lookup", EVENTS + f""", q AS (SELECT point_id, (lon / 180.0 + 1) / 2 * {_W - 1} AS px, (1 - (lat / 90.0 + 1) / 2) * {_H - 1} AS py FROM pts),
w AS (SELECT *, CAST(floor(px) AS INTEGER) AS c0, CAST(floor(py) AS INTEGER) AS r0, px - floor(px) AS dx, py - floor(py) AS dy, least(CAST(floor(px) AS INTEGER) + 1, {_W - 1}) AS c1, least(CAST(floor(py) AS INTEGER) + 1, {_H - 1}) AS r1 FROM q)
SELECT point_id, round(({_corner("r0", "c0")}) * (1 - dx) * (1 - dy) + ({_corner("r0", "c1")}) * dx * (1 - dy) + ({_corner("r1", "c0")}) * (1 - dx) * dy + ({_corner("r1", "c1")}) * dx * dy, 6) + 0.0 AS value FROM w""")
def j8(spark, d):
    k = F.col("id")
    row, col = F.floor(k / _W).cast("int"), (k % _W).cast("int")
    value = F.when(k % 17 == 0, F.lit(float("nan"))).otherwise((row * 31 + col * 7) % 101 / 10.0)
    raster = spark.range(_H * _W).select(row.alias("row"), col.alias("col"), F.array(value).alias("values"))
    p = event_points(spark, d).select("point_id", (F.col("lon") / 180.0).alias("x"), (F.col("lat") / 90.0).alias("y"))
    return raster_lookup(p, raster, _H, _W).select("point_id", r6(F.get("values", F.lit(0))).alias("value"))


@query("E21_sin_cos_env", PTS + f""", q AS (SELECT point_id, lon, lat, (lon / 180.0 + 1) / 2 * {_W - 1} AS px, (1 - (lat / 90.0 + 1) / 2) * {_H - 1} AS py FROM pts),
w AS (SELECT *, CAST(floor(px) AS INTEGER) AS c0, CAST(floor(py) AS INTEGER) AS r0, px - floor(px) AS dx, py - floor(py) AS dy, least(CAST(floor(px) AS INTEGER) + 1, {_W - 1}) AS c1, least(CAST(floor(py) AS INTEGER) + 1, {_H - 1}) AS r1 FROM q) """
       + sql_entries(f"[sin(lon / 180.0 * pi()), sin(lat / 90.0 * pi()), cos(lon / 180.0 * pi()), cos(lat / 90.0 * pi()), ({_corner('r0', 'c0')}) * (1 - dx) * (1 - dy) + ({_corner('r0', 'c1')}) * dx * (1 - dy) + ({_corner('r1', 'c0')}) * (1 - dx) * dy + ({_corner('r1', 'c1')}) * dx * dy]", "w"))
def e21(spark, d):
    from terravec.functions.encodings import sin_cos

    k = F.col("id")
    row, col = F.floor(k / _W).cast("int"), (k % _W).cast("int")
    value = F.when(k % 17 == 0, F.lit(float("nan"))).otherwise((row * 31 + col * 7) % 101 / 10.0)
    raster = spark.range(_H * _W).select(row.alias("row"), col.alias("col"), F.array(value).alias("values"))
    p = points(spark, d).withColumns({"x": F.col("lon") / 180.0, "y": F.col("lat") / 90.0})
    met = p.join(raster_lookup(p, raster, _H, _W), "point_id")
    return entries(met.select("point_id", F.concat(sin_cos(F.col("lon"), F.col("lat")), "values").alias("v")), "v", "point_id")


@query("J9_rbf_features", PTS + ", a AS (SELECT point_id AS anchor_id, lon AS x, lat AS y FROM pts ORDER BY point_id LIMIT 10) SELECT point_id, anchor_id, round(exp(-(pow(lon - x, 2) + pow(lat - y, 2)) / (2 * 40.0 * 40.0)), 6) + 0.0 AS value FROM pts, a")
def j9(spark, d):
    p = points(spark, d)
    anchors = p.orderBy("point_id").limit(10).withColumnRenamed("point_id", "anchor_id")
    return joins.rbf_features(p, anchors, 40.0).withColumn("value", r6(F.col("value")))


@query("J10_join_scores", f"WITH {LONG}, v AS (SELECT neuron, avg(act) AS s FROM ac WHERE label < 4 AND neuron < 10 GROUP BY neuron), g AS (SELECT neuron, max(act) AS s FROM ac WHERE neuron > 3 GROUP BY neuron) SELECT coalesce(v.neuron, g.neuron) AS neuron, round(v.s, 6) + 0.0 AS visual_ms, round(g.s, 6) + 0.0 AS geo_ms FROM v FULL JOIN g ON v.neuron = g.neuron")
def j10(spark, d):
    a = long_activations(spark, d)
    v = a.filter("label < 4 AND neuron < 10").groupBy("neuron").agg(F.avg("act").alias("score"))
    g = a.filter("neuron > 3").groupBy("neuron").agg(F.max("act").alias("score"))
    return joins.join_scores(v, g).select("neuron", r6(F.col("visual_ms")).alias("visual_ms"), r6(F.col("geo_ms")).alias("geo_ms"))


def paired(spark, d, size: int = 64, drop_last: bool = True):
    """Vector k as text and vector k + 1 as location, in batches."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("text_vec"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("text_vec").alias("loc_vec"))
    return align.assign_batches(e.join(nxt, "vec_id"), size, "vec_id", drop_last=drop_last)


PAIRED = f"""e AS (SELECT vec_id, {_E} AS e FROM embeddings), pr AS (SELECT a.vec_id, a.e AS t, b.e AS l, (row_number() OVER (ORDER BY a.vec_id) - 1) // 64 AS batch_id FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
full_b AS (SELECT batch_id FROM pr GROUP BY batch_id HAVING count(*) = 64), bt AS (SELECT pr.* FROM pr JOIN full_b USING (batch_id))"""


@query("W10_assign_batches", f"WITH {PAIRED} SELECT vec_id, batch_id FROM bt")
def w10(spark, d):
    return paired(spark, d).select("vec_id", "batch_id")


@query("J11_batch_pairs", f"WITH {PAIRED} SELECT batch_id, count(*) AS pairs, count(DISTINCT vec_id) AS texts FROM (SELECT a.batch_id, a.vec_id, b.vec_id AS other FROM bt a JOIN bt b USING (batch_id)) GROUP BY batch_id")
def j11(spark, d):
    return align.batch_pairs(paired(spark, d), "vec_id").groupBy("batch_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("text_id").alias("texts"))


LOSS = f"""WITH {PAIRED}, z AS (SELECT a.batch_id, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.t, b.l) * 14.285714 AS z FROM bt a JOIN bt b USING (batch_id)),
r AS (SELECT batch_id, i, ln(sum(exp(z))) - max(z) FILTER (i = j) AS l FROM z GROUP BY ALL), c AS (SELECT batch_id, j, ln(sum(exp(z))) - max(z) FILTER (i = j) AS l FROM z GROUP BY ALL),
s AS (SELECT batch_id, (x + y) / 2 AS loss FROM (SELECT batch_id, avg(l) AS x FROM r GROUP BY batch_id) JOIN (SELECT batch_id, avg(l) AS y FROM c GROUP BY batch_id) USING (batch_id))"""


@query("A24_clip_loss", LOSS + " SELECT batch_id, round(loss, 6) + 0.0 AS loss FROM s")
def a24(spark, d):
    return align.clip_loss(paired(spark, d), "vec_id", 14.285714).select("batch_id", r6(F.col("loss")).alias("loss"))


@query("A24_clip_loss_columns", LOSS + " SELECT round(avg(loss), 6) + 0.0 AS loss FROM s")
def a24b(spark, d):
    return align.mean_loss(align.clip_loss_columns(paired(spark, d), "vec_id", 14.285714)).select(r6(F.col("loss")).alias("loss"))


@query("J12_similarity_logits", f"WITH e AS (SELECT vec_id, {_E} AS e FROM embeddings), p AS (SELECT vec_id AS place_id, e FROM e WHERE vec_id % 100 = 0) SELECT e.vec_id AS image_id, place_id, round(list_cosine_similarity(e.e, p.e) * {1 / 0.07!r}, 5) + 0.0 AS logit FROM e, p")
def j12(spark, d):
    """Every vector against those whose id is divisible by 100, as places."""
    e = table(spark, d, "embeddings")
    out = joins.similarity_logits(e.withColumnRenamed("vec_id", "image_id"), e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "place_id"), math.log(1 / 0.07))
    return out.select("image_id", "place_id", rounded(F.col("logit"), 5).alias("logit"))


@query("J13_rows_of_top_features", f"WITH {LONG} SELECT point_id, neuron FROM ac WHERE neuron IN (SELECT neuron FROM ac GROUP BY neuron ORDER BY sum(act) DESC, neuron LIMIT 3)")
def j13(spark, d):
    a = long_activations(spark, d)
    top = a.groupBy("neuron").agg(F.sum("act").alias("s")).orderBy(F.desc("s"), "neuron").limit(3)
    return joins.rows_of_top_features(a, top).select("point_id", "neuron")


# classes

_ORDER = "((event_id * 7919 + 13) % 10007)"


def _order():
    return (F.col("event_id") * 7919 + 13) % 10007


@query("A18_class_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def a18(spark, d):
    return sampling.class_counts(table(spark, d, "embeddings"), "label")


@query("W1_stratified_sample", f"SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_ORDER}, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r <= greatest(1, round_even(n * 0.05, 0))")
def w1(spark, d):
    return sampling.stratified_sample(table(spark, d, "events"), 0.05, "event_type", "event_id", order=_order()).select("event_id", "event_type")


@query("W2_balanced_sample", f"SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_ORDER}, event_id) AS r FROM events) WHERE r <= 40")
def w2(spark, d):
    return sampling.balanced_sample(table(spark, d, "events"), 40, "event_type", "event_id", order=_order()).select("event_id", "event_type")


@query("W2_balanced_sample_replace", f"""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_ORDER}, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, CAST(k AS INTEGER) AS draw, event_id FROM r, range(50) AS t(k) WHERE r.r = (k * 7919) % n + 1""")
def w2b(spark, d):
    out = sampling.balanced_sample(table(spark, d, "events").select("event_id", "event_type"), 50, "event_type", "event_id", True, order=_order(), pick=F.col("draw").cast("bigint") * 7919)
    return out.select("event_type", "draw", "event_id")


AP = f"""WITH s AS (SELECT label AS class, vec_id, CASE WHEN (vec_id * 31 + label) % 3 = 0 THEN 1 ELSE 0 END AS y, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings),
c AS (SELECT class, y, row_number() OVER w AS r, sum(y) OVER w AS tp, sum(y) OVER (PARTITION BY class) AS n FROM s WINDOW w AS (PARTITION BY class ORDER BY score DESC, vec_id ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT class, sum(CASE WHEN y = 1 THEN tp / r / n ELSE 0 END) AS ap FROM c GROUP BY class)"""


def _ap(spark, d):
    e = table(spark, d, "embeddings")
    s = e.select(F.col("label").alias("class"), F.col("vec_id").alias("row_id"), F.when((F.col("vec_id") * 31 + F.col("label")) % 3 == 0, 1).otherwise(0).alias("y_true"), F.get("embedding", F.lit(0)).cast("double").alias("score"))
    return sampling.average_precision(s)


@query("W6_average_precision", AP + " SELECT class, round(ap, 6) + 0.0 AS ap FROM ap")
def w6(spark, d):
    return _ap(spark, d).select("class", r6(F.col("ap")).alias("ap"))


@query("W6_mean_average_precision", AP + " SELECT round(avg(ap), 6) + 0.0 AS map FROM ap")
def w6b(spark, d):
    return sampling.mean_average_precision(_ap(spark, d)).select(r6(F.col("map")).alias("map"))


@query("A19_weighted_mean", "SELECT l_returnflag, l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) + 0.0 AS mean FROM lineitem GROUP BY ALL")
def a19(spark, d):
    return sampling.weighted_mean(table(spark, d, "lineitem"), "l_discount", "l_quantity", "l_returnflag", "l_linestatus").withColumn("mean", r6(F.col("mean")))

"""Queries of saliency maps, clusters, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terravec.functions.arrays import doubles
from terravec.operators import cluster, pairs, sae, saliency, splice
from terravec.operators.shared import cut
from terravec.plans.base import query, r6, rounded, table
from terravec.plans.q_points import PLANE, plane
from terravec.plans.q_sae import FIRE, LOG
from terravec.plans.q_splice import SIGNS, concepts, signs
from terravec.streaming import stream

SIDE, LAYERS = 12, 8
_BUMPS = "exp(-(pow(x - k % 12, 2) + pow(y - (k * 7) % 12, 2)) / 8.0) * (1 + layer / 10.0) + exp(-(pow(x - (k * 5) % 12, 2) + pow(y - (k * 3) % 12, 2)) / 6.0)"
HEAT = f"hm AS (SELECT k AS tile, layer, y, x, CASE WHEN k % 17 = 0 THEN 0.5 ELSE {_BUMPS} END AS value FROM (SELECT s_suppkey AS k FROM supplier), range({LAYERS}) AS a(layer), range({SIDE}) AS b(y), range({SIDE}) AS c(x))"


def heat(spark, d):
    """Two bumps on a small map for each supplier and layer; every 17th is flat."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("tile"))
    s = pairs.dealt(s, "tile", LAYERS * SIDE * SIDE)  # one small file, of which each row becomes many
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    h = s.withColumn("layer", axis(LAYERS)).withColumn("y", axis(SIDE)).withColumn("x", axis(SIDE))
    k, x, y = F.col("tile"), F.col("x"), F.col("y")
    bump = lambda a, b, w: F.exp(-(F.pow(x - k * a % 12, 2) + F.pow(y - k * b % 12, 2)) / w)
    return h.withColumn("value", F.when(k % 17 == 0, 0.5).otherwise(bump(1, 7, 8.0) * (1 + F.col("layer") / 10.0) + bump(5, 3, 6.0)))


SUMMED = f"{HEAT}, ls AS (SELECT tile, y, x, sum(value) AS value FROM hm WHERE layer >= 2 GROUP BY ALL)"


@query("A20_layer_sum", f"WITH {SUMMED} SELECT tile, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(value, 6) + 0.0 AS value FROM ls")
def a20(spark, d):
    return saliency.layer_sum(heat(spark, d)).withColumn("value", r6(F.col("value")))


THR = f"{SUMMED}, th AS (SELECT tile, CASE WHEN max(value) - min(value) >= 1e-12 THEN greatest(quantile_cont(value, 0.8), max(value) * 0.4) END AS threshold FROM ls GROUP BY tile)"


@query("A21_saliency_threshold", f"WITH {THR} SELECT tile, round(threshold, 6) + 0.0 AS threshold FROM th")
def a21(spark, d):
    return saliency.saliency_threshold(saliency.layer_sum(heat(spark, d)), 0.8, 0.4).withColumn("threshold", r6(F.col("threshold")))


def masks(spark, d):
    return saliency.saliency_mask(cut(saliency.layer_sum(heat(spark, d)).withColumn("value", rounded(F.col("value"), 9))), 0.8, 0.4)


MASKS = THR.replace("SELECT tile, y, x, sum(value) AS value FROM hm", "SELECT tile, y, x, round(sum(value), 9) AS value FROM hm") + ", mk AS (SELECT tile, y, x, CASE WHEN value >= threshold THEN 1 ELSE 0 END AS mask FROM ls JOIN th USING (tile))"


@query("U13_open_mask", f"""WITH {MASKS}, er AS (SELECT a.tile, a.y, a.x, min(b.mask) AS e FROM mk a JOIN mk b ON a.tile = b.tile AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
SELECT a.tile, CAST(a.y AS INTEGER) AS y, CAST(a.x AS INTEGER) AS x, CAST(max(b.e) AS INTEGER) AS mask FROM er a JOIN er b ON a.tile = b.tile AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.tile, a.y, a.x""")
def u13(spark, d):
    return saliency.open_mask(masks(spark, d), 3)


@query("U14_saliency_boxes_whole", f"""WITH RECURSIVE {MASKS.removeprefix("WITH ")}, px AS (SELECT tile, y, x, y * 10000 + x AS p FROM mk WHERE mask = 1),
nb AS (SELECT a.tile, a.p AS a, b.p AS b FROM px a JOIN px b ON a.tile = b.tile AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
rc AS (SELECT tile, p AS s, p AS t FROM px UNION SELECT rc.tile, rc.s, nb.b FROM rc JOIN nb ON rc.tile = nb.tile AND rc.t = nb.a), rt AS (SELECT tile, s AS p, min(t) AS root FROM rc GROUP BY ALL)
SELECT tile, CAST(min(x) AS INTEGER) AS x, CAST(min(y) AS INTEGER) AS y, CAST(max(x) - min(x) + 1 AS INTEGER) AS w, CAST(max(y) - min(y) + 1 AS INTEGER) AS h, CAST(count(*) AS INTEGER) AS area, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) + 0.0 AS cy FROM rt JOIN px USING (tile, p) GROUP BY tile, root""")
def u14_whole(spark, d):
    """The bounds of each blob, none too large."""
    b = saliency.saliency_boxes(masks(spark, d), 1 << 30)
    return b.select("tile", "x", "y", "w", "h", "area", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"))


@query("U14_saliency_boxes", None)
def u14(spark, d):
    b = saliency.saliency_boxes(masks(spark, d), 20, 6)
    return b.select("tile", "x", "y", "w", "h", "area", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"))


@query("W11_minmax_over_tile", f"""WITH {HEAT} SELECT tile, CAST(layer AS INTEGER) AS layer, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(CASE WHEN max(value) OVER w - min(value) OVER w < 1e-12 THEN 0 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6) + 0.0 AS value FROM hm WINDOW w AS (PARTITION BY tile, layer)""")
def w11(spark, d):
    return saliency.minmax_over_tile(heat(spark, d), "tile", "layer").withColumn("value", r6(F.col("value")))


@query("W5_rank_boxes", """WITH b AS (SELECT l_orderkey AS tile, CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey * 100 + l_suppkey % 100 AS box_id, CAST(l_partkey % 70 AS INTEGER) - 5 AS x, CAST(l_suppkey % 70 AS INTEGER) - 5 AS y, CAST(floor(l_quantity) AS INTEGER) % 9 AS w, 8 AS h, CAST(floor(l_quantity) AS INTEGER) AS area FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY area DESC, box_id) - 1 AS rank FROM b),
c AS (SELECT tile, box_id, rank, greatest(x, 0) AS x, greatest(y, 0) AS y, least(x + w, 64) - greatest(x, 0) AS w, least(y + h, 64) - greatest(y, 0) AS h FROM r)
SELECT tile, box_id, CAST(rank AS INTEGER) AS rank, x, y, w, h FROM c WHERE w > 0 AND h > 0""")
def w5(spark, d):
    li = table(spark, d, "lineitem")
    i = lambda c: F.col(c).cast("int")
    b = li.select(F.col("l_orderkey").alias("tile"), (F.col("l_linenumber").cast("bigint") * 10000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("box_id"), (i("l_partkey") % 70 - 5).alias("x"), (i("l_suppkey") % 70 - 5).alias("y"), (i("l_quantity") % 9).alias("w"), F.lit(8).alias("h"), i("l_quantity").alias("area"))
    return saliency.rank_boxes(b, F.lit(64), F.lit(64)).select("tile", "box_id", "rank", "x", "y", "w", "h")


_E = "CAST(embedding AS DOUBLE[])"
SIMILARITY = f"""WITH e AS (SELECT vec_id, {_E} AS e, sqrt(list_inner_product({_E}, {_E})) AS n FROM embeddings), red AS (SELECT e AS r FROM e WHERE vec_id = 3),
s AS (SELECT p.vec_id // 17 AS tile, q.vec_id AS location_id, CAST(p.vec_id % 17 AS INTEGER) AS pos, (list_inner_product(p.e, q.e) - list_inner_product(p.e, r)) / p.n AS v FROM e p, e q, red WHERE q.vec_id % 100 = 0 AND p.vec_id % 17 > 0)"""


def similarity(spark, d, of=saliency.surgery_similarity, *size):
    """All patches against the vectors whose id is divisible by 100, as locations."""
    e = table(spark, d, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("vec"))
    patches = e.select(F.floor(F.col("vec_id") / 17).alias("tile"), (F.col("vec_id") % 17).cast("int").alias("pos"), "vec")
    redundant = F.array(*map(F.lit, e.filter("vec_id = 3").first()["vec"]))
    return of(patches, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("location_id"), "vec"), redundant, *size)


@query("U12_surgery_similarity", SIMILARITY + " SELECT tile, location_id, pos, round(CASE WHEN max(v) OVER w - min(v) OVER w < 1e-12 THEN 0 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END, 6) + 0.0 AS value FROM s WINDOW w AS (PARTITION BY tile, location_id)")
def u12(spark, d):
    return similarity(spark, d).withColumn("value", r6(F.col("value")))


def _resized_sql(to: int) -> str:
    """Bilinear values at the pixel centres of a to x to map, from maps of side x side patches."""
    axis = f"SELECT side, k, least(greatest((k + 0.5) * side / {to}.0 - 0.5, 0), side - 1) AS f FROM (SELECT DISTINCT side FROM mp), range({to}) AS t(k)"
    blend = "sum(v * (1 - abs(mp.r - ay.f)) * (1 - abs(mp.c - ax.f)))"
    return f"""mp AS (SELECT tile, location_id, value AS v, side, k // side AS r, k % side AS c FROM (SELECT tile, location_id, value, CAST(round(sqrt(count(*) OVER w)) AS BIGINT) AS side, count(*) OVER w AS n, row_number() OVER (PARTITION BY tile, location_id ORDER BY pos) - 1 AS k FROM st WINDOW w AS (PARTITION BY tile, location_id)) WHERE side * side = n),
ax AS ({axis})
SELECT tile, location_id, CAST(ay.k AS INTEGER) AS y, CAST(ax.k AS INTEGER) AS x, round({blend}, 6) + 0.0 AS value FROM mp JOIN ax ON ax.side = mp.side AND abs(mp.c - ax.f) < 1 JOIN ax AS ay ON ay.side = mp.side AND abs(mp.r - ay.f) < 1 GROUP BY tile, location_id, ay.k, ax.k"""


@query("U12_resized_maps", SIMILARITY + ", st AS (SELECT tile, location_id, pos, CASE WHEN max(v) OVER w - min(v) OVER w < 1e-12 THEN 0 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END AS value FROM s WINDOW w AS (PARTITION BY tile, location_id)), " + _resized_sql(8))
def u12b(spark, d):
    return similarity(spark, d, saliency.resized_similarity, 8, 8).withColumn("value", r6(F.col("value")))


@query("A22_percentile_stretch", """WITH v AS (SELECT c_nationkey AS image, c_custkey AS pixel, c_acctbal AS value FROM customer), p AS (SELECT image, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM v GROUP BY image)
SELECT image, pixel, CAST(floor(least(greatest(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE value - lo END, 0), 1) * 255) AS INTEGER) AS byte FROM v JOIN p USING (image)""")
def a22(spark, d):
    v = table(spark, d, "customer").select(F.col("c_nationkey").alias("image"), F.col("c_custkey").alias("pixel"), F.col("c_acctbal").cast("double").alias("value"))
    return saliency.percentile_stretch(v).select("image", "pixel", "byte")


EPS, MIN_SAMPLES = 0.22, 5
DBSCAN = f"""WITH RECURSIVE {PLANE}, nb AS (SELECT a.row_id AS a, b.row_id AS b FROM pl a JOIN pl b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= {EPS}),
co AS (SELECT a FROM nb GROUP BY a HAVING count(*) >= {MIN_SAMPLES}), cc AS (SELECT a, b FROM nb WHERE a IN (SELECT a FROM co) AND b IN (SELECT a FROM co)),
rc AS (SELECT a AS s, a AS t FROM co UNION SELECT rc.s, cc.b FROM rc JOIN cc ON rc.t = cc.a), rt AS (SELECT s AS a, min(t) AS root FROM rc GROUP BY s),
nu AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS c FROM (SELECT DISTINCT root FROM rt)), cl AS (SELECT a, c FROM rt JOIN nu USING (root)),
out AS (SELECT row_id, coalesce(cl.c, (SELECT min(k.c) FROM nb JOIN cl k ON k.a = nb.b WHERE nb.a = row_id), -1) AS cluster FROM pl LEFT JOIN cl ON cl.a = row_id)"""


@query("U15_dbscan", DBSCAN + " SELECT row_id, cluster FROM out")
def u15(spark, d):
    return cluster.dbscan(plane(spark, d), EPS, MIN_SAMPLES)


@query("A23_cluster_summary", DBSCAN + " SELECT cluster, CASE WHEN cluster = -1 THEN 'noise' ELSE printf('cluster_%02d', cluster) END AS name, count(*) AS n, string_agg('t' || row_id % 7 || '__' || row_id, ',' ORDER BY 't' || row_id % 7 || '__' || row_id) AS members FROM out GROUP BY cluster")
def a23(spark, d):
    c = cluster.dbscan(plane(spark, d), EPS, MIN_SAMPLES)
    return cluster.cluster_summary(c.select("cluster", F.concat(F.lit("t"), (F.col("row_id") % 7).cast("string")).alias("tile"), F.col("row_id").cast("string").alias("file")))


@query("A23_cluster_count", DBSCAN + " SELECT count(DISTINCT cluster) AS clusters FROM out")
def a23_count(spark, d):
    return cluster.cluster_count(cluster.dbscan(plane(spark, d), EPS, MIN_SAMPLES))


@query("W12_k_distance_curve", f"""WITH e AS (SELECT vec_id, {_E} AS e FROM embeddings), p AS (SELECT a.vec_id, list_distance(a.e, b.e) AS dist FROM e a, e b QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY dist) = 4)
SELECT row_number() OVER (ORDER BY dist) - 1 AS rank, round(dist, 6) + 0.0 AS dist FROM p""")
def w12(spark, d):
    return cluster.k_distance_curve(table(spark, d, "embeddings"), "vec_id", "embedding", 4).select("rank", r6(F.col("dist")).alias("dist"))


# streams over the tables as files


def _scratch(spark) -> str:
    from terravec.operators.shared import shared_dir

    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, d, name: str):
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def _arrivals(spark, d, parts: int = 3):
    """All events in parts by id, none of which cuts a step."""
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    top = e.agg(F.max("event_id")).first()[0] or 0
    ends = [(top + 1) * i // parts // 25 * 25 for i in range(1, parts)]
    return [e.filter(F.col("event_id").between(a, b - 1)) for a, b in zip([-(1 << 62), *ends], [*ends, 1 << 62], strict=True)]


@query("T1_stream_threshold_ema", f"""WITH {LOG}, n AS (SELECT run, step, m, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM lg WHERE step > 300)
SELECT run, step, round(pow(0.999, k) * sum((CASE WHEN k = 1 THEN 1 ELSE 0.001 END) * m * pow(0.999, -k)) OVER (PARTITION BY run ORDER BY k), 6) + 0.0 AS threshold FROM n""")
def t1(spark, d):
    """The events arrive in three parts, each some micro-batches."""
    rows = lambda s: s.select((F.col("user_id") % 5).cast("int").alias("run"), F.floor(F.col("event_id") / 25).alias("step"), "value")
    out = stream.run_arrivals(_arrivals(spark, d), lambda s: stream.stream_threshold_ema(rows(s)), f"t1_{uuid.uuid4().hex}", _scratch(spark))
    return out.withColumn("threshold", r6(F.col("threshold")))


@query("T1_stream_rows_since_fired", f"""WITH {FIRE.replace("25 AS batch_size", "1 AS batch_size").replace("SELECT DISTINCT event_id // 25 AS step FROM events", "SELECT event_id AS step FROM events")}, c AS (SELECT *, sum(batch_size) OVER (PARTITION BY neuron ORDER BY step) AS seen FROM f)
SELECT CAST(neuron AS INTEGER) AS neuron, step, since, since >= 8 AS dead FROM (SELECT neuron, step, CAST(seen - coalesce(max(CASE WHEN fired THEN seen END) OVER (PARTITION BY neuron ORDER BY step), 0) AS BIGINT) AS since FROM c)""")
def t1b(spark, d):
    fired = (F.col("step") * 7 + F.col("neuron") * 13) % 11 == 0
    rows = lambda s: s.select(F.col("event_id").alias("step"), F.explode(F.array(*map(F.lit, range(6)))).alias("neuron")).select("neuron", "step", F.lit(1).alias("batch_size"), fired.alias("fired"))
    out = stream.run_arrivals(_arrivals(spark, d), lambda s: stream.stream_rows_since_fired(rows(s), 1000), f"t1b_{uuid.uuid4().hex}", _scratch(spark))
    return sae.settled(out, 8)


@query("T2_stream_decompose_signs", f"WITH {SIGNS} SELECT concept_id, round(sum(weight) / (SELECT count(*) FROM v), 6) + 0.0 AS weight FROM w GROUP BY concept_id")
def t2_signs(spark, d):
    """The same over the dictionary of signs."""
    import numpy as np

    s = _stream(spark, d, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("embedding"))
    enc = splice.splice_encode(s, signs(spark), np.zeros(64), "vec_id", tol=1e-12)
    sums = stream.run_to_table(stream.stream_decompose(enc), f"t2s_{uuid.uuid4().hex}", "complete", _scratch(spark))
    n = sums.filter("concept_id = -1").select(F.col("weight_sum").alias("n"))
    return sums.filter("concept_id >= 0").join(F.broadcast(n)).select("concept_id", r6(F.col("weight_sum") / F.col("n")).alias("weight"))


@query("T2_stream_decompose", None)
def t2(spark, d):
    """Mean concept weights over the stream."""
    import numpy as np

    from terravec.functions.arrays import l2_normalize
    from terravec.operators.vectors import vector_mean

    v = table(spark, d, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("embedding"))
    mean = np.array(vector_mean(v.select(l2_normalize(F.col("embedding")).alias("u")), "u").first()[0])
    s = _stream(spark, d, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("embedding"))
    enc = splice.splice_encode(s, splice.build_dictionary(concepts(spark, d)), mean, "vec_id")
    sums = stream.run_to_table(stream.stream_decompose(enc), f"t2_{uuid.uuid4().hex}", "complete", _scratch(spark))
    n = sums.filter("concept_id = -1").select(F.col("weight_sum").alias("n"))
    return sums.filter("concept_id >= 0").join(F.broadcast(n)).select("concept_id", F.round(F.col("weight_sum") / F.col("n"), 5).alias("weight"))

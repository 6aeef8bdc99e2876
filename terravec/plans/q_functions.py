"""Queries of the scalar functions: distances, encodings, dates, strings, arrays."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terravec.functions import arrays as A
from terravec.functions import encodings as E
from terravec.functions import geo
from terravec.functions import text as X
from terravec.plans.base import entries, event_points, points, query, r6, sql_entries, sql_points, table

PTS = "WITH " + sql_points()
EVENTS = "WITH " + sql_points("pts", "events", "event_id", ", ts, user_id, value, event_type")
HERE = (48.1, 11.5)  # latitude, longitude of a fixed place


@query("M1_haversine_km", EVENTS + f""", a AS (SELECT point_id, pow(sin(radians({HERE[0]} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({HERE[0]})) * pow(sin(radians({HERE[1]} - lon) / 2), 2) AS a FROM pts)
SELECT point_id, round(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)), 6) + 0.0 AS km FROM a""")
def m1(spark, d):
    p = event_points(spark, d)
    return p.select("point_id", r6(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(HERE[0]), F.lit(HERE[1]))).alias("km"))


@query("M2_haversine_km_asin", EVENTS + f""", a AS (SELECT point_id, pow(sin(radians(lat - {HERE[0]}) / 2), 2) + cos(radians(lat)) * cos(radians({HERE[0]})) * pow(sin(radians(lon - {HERE[1]}) / 2), 2) AS a FROM pts)
SELECT point_id, round(2 * 6371.4 * asin(sqrt(a + 1e-16)), 6) + 0.0 AS km FROM a""")
def m2(spark, d):
    p = event_points(spark, d)
    km = geo.haversine_km_asin(F.col("lon"), F.col("lat"), F.lit(HERE[1]), F.lit(HERE[0]), geo.ONE_TO_MANY_KM, 1e-16)
    return p.select("point_id", r6(km).alias("km"))


@query("M3_euclidean", """SELECT a.vec_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS dist
FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b""")
def m3(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("x"))
    one = e.orderBy("vec_id").limit(1).select(F.col("x").alias("y"))
    return e.join(F.broadcast(one)).select("vec_id", r6(geo.euclidean(F.col("x"), F.col("y"))).alias("dist"))


@query("M4_geo_kernel", EVENTS + " SELECT point_id, round(exp(-abs(lon) / 500.0), 6) + 0.0 AS k FROM pts")
def m4(spark, d):
    return event_points(spark, d).select("point_id", r6(geo.geo_kernel(F.abs("lon"))).alias("k"))


@query("M5_normalize_global", EVENTS + " SELECT point_id, round(lon / 180.0, 6) + 0.0 AS x, round(lat / 90.0, 6) + 0.0 AS y FROM pts")
def m5(spark, d):
    x, y = geo.normalize_global(F.col("lon"), F.col("lat"))
    return event_points(spark, d).select("point_id", r6(x).alias("x"), r6(y).alias("y"))


EXTENT = (-120.0, 60.0, -45.0, 80.0)


@query("M6_normalize_extent", EVENTS + " SELECT point_id, round((lon + 120.0) / 180.0 * 2 - 1, 6) + 0.0 AS x, round((lat + 45.0) / 125.0 * 2 - 1, 6) + 0.0 AS y FROM pts")
def m6(spark, d):
    x, y = geo.normalize_extent(F.col("lon"), F.col("lat"), EXTENT)
    return event_points(spark, d).select("point_id", r6(x).alias("x"), r6(y).alias("y"))


@query("M10_polygon_bounds_centroid", """
WITH b AS (SELECT c_nationkey AS region, min(x) - 1.0 AS x0, max(x) + 1.0 AS x1, min(y) - 1.0 AS y0, max(y) + 1.0 AS y1
  FROM (SELECT c_nationkey, CAST(c_custkey % 91 AS DOUBLE) AS x, CAST(c_custkey % 37 AS DOUBLE) AS y FROM customer) GROUP BY c_nationkey)
SELECT region, x0, x1, y0, y1, round(x0 + (x1 - x0) * 4 / 9, 6) + 0.0 AS lon, round(y0 + (y1 - y0) * 4 / 9, 6) + 0.0 AS lat FROM b""")
def m10(spark, d):
    """A trapezium in the bounds of each nation's keys: full width below, half above."""
    c = table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 91).cast("double").alias("x"), (F.col("c_custkey") % 37).cast("double").alias("y"))
    b = c.groupBy(F.col("c_nationkey").alias("region")).agg((F.min("x") - 1).alias("x0"), (F.max("x") + 1).alias("x1"), (F.min("y") - 1).alias("y0"), (F.max("y") + 1).alias("y1"))
    at = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    x0, x1, y0, y1 = (F.col(k) for k in ("x0", "x1", "y0", "y1"))
    middle = x0 + (x1 - x0) / 2
    ring = F.array(at(x0, y0), at(x1, y0), at(middle, y1), at(x0, y1), at(x0, y0))
    b = b.select("region", geo.ring_bounds(ring).alias("b"), geo.ring_centroid(ring).alias("c"))
    # the centroid of a trapezium with sides a and a/2 is at 7/18 of its width and 4/9 of its height; shown is its share of 4/9
    return b.select("region", "b.x0", "b.x1", "b.y0", "b.y1", r6(F.col("b.x0") + (F.col("c.lon") - F.col("b.x0")) * 8 / 7).alias("lon"), r6(F.col("c.lat")).alias("lat"))


FREQS = E.freq_list(3, 360.0, 20.0)


def _sql_list(*parts: str) -> str:
    return "[" + ", ".join(parts) + "]"


@query("M7_freq_list", f"""SELECT n_nationkey, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS i, round(unnest(v), 6) + 0.0 AS value
FROM (SELECT n_nationkey, list_transform(range(5), lambda k: 1.0 / ((1 + n_nationkey) * exp(k * ln(360.0 / (1 + n_nationkey)) / 4))) AS v FROM nation)""")
def m7(spark, d):
    keys = sorted(r[0] for r in table(spark, d, "nation").select("n_nationkey").collect())  # 25 nations
    choice = [F.when(F.col("n_nationkey") == k, F.array(*map(F.lit, E.freq_list(5, 360.0, 1.0 + k)))) for k in keys]
    return entries(table(spark, d, "nation").select("n_nationkey", F.coalesce(*choice).alias("v")), "v", "n_nationkey")


@query("M8_activations", """SELECT event_id, round(1 / (1 + exp(-x)), 6) + 0.0 AS sigmoid, round(greatest(x, 0), 6) + 0.0 AS relu, round(CASE WHEN x > 0 THEN x ELSE 0.2 * x END, 6) + 0.0 AS leakyrelu,
 round((exp(2 * x) - 1) / (exp(2 * x) + 1), 6) + 0.0 AS tanh, round(sin(30 * x), 6) + 0.0 AS sine FROM (SELECT event_id, value / 100.0 - 0.5 AS x FROM events)""")
def m8(spark, d):
    from terravec.operators.nets import activation

    x = F.col("value") / 100.0 - 0.5
    e = table(spark, d, "events")
    return e.select("event_id", *(r6(activation(x, n)).alias(n) for n in ("sigmoid", "relu", "leakyrelu", "tanh", "sine")))


def _sincos(angle: str) -> list[str]:
    return [f"sin({angle})", f"cos({angle})"]


_X, _Y = "radians(lon)", "radians(lat)"
_pi = repr(math.pi)


def _products(f: str | float, lon: str = "lon", lat: str = "lat") -> dict[str, str]:
    x, y = f"({lon} * {f})", f"({lat} * {f})"
    return {"sy": f"sin({y})", "cy": f"cos({y})", "sx": f"sin({x})", "cx": f"cos({x})", "ycx": f"cos({y}) * cos({x})", "ysx": f"cos({y}) * sin({x})", "ycx0": f"cos({y}) * cos({lon})", "y0cx": f"cos({lat}) * cos({x})", "ysx0": f"cos({y}) * sin({lon})", "y0sx": f"cos({lat}) * sin({x})"}


def _doubled(keys: str) -> str:
    return _sql_list(*(_products(repr(f))[k] for f in FREQS for k in keys.split() for _ in range(2)))


_ANGLES = [f"((lon * {a!r} + lat * {b!r}) * {f!r})" for f in FREQS for a, b in E.DIRECTIONS]
_NANGLES = [f"((radians(lon) * {a!r} + radians(lat) * {b!r}) * {f!r})" for f in FREQS for a, b in E.DIRECTIONS]
_DOUBLE_ANGLES = [a for a in _ANGLES for _ in range(2)]
ANCHORS = [(0.0, 0.0), (30.0, 10.0), (-75.0, 40.0), (120.0, -30.0)]
RFF_DIRECTIONS, RFF_SHIFTS = [(0.3, -1.2), (1.7, 0.4), (-0.8, 0.9)], [0.1, 2.5, 4.0]
_u, _v = "lon / 180.0", "lat / 90.0"

ENCODINGS = {
    "E1_direct": (lambda x, y: E.direct(x, y), _sql_list(f"{_X} - {_pi}", f"{_Y} - {_pi}")),
    "E2_cartesian3d": (lambda x, y: E.cartesian3d(x, y), _sql_list(f"cos({_X}) * cos({_Y})", f"sin({_X}) * cos({_Y})", f"sin({_Y})")),
    "E3_wrap": (lambda x, y: E.wrap(x, y), _sql_list(f"cos({_X})", f"sin({_X})", f"cos({_Y})", f"sin({_Y})")),
    "E4_grid": (lambda x, y: E.grid(x, y, FREQS), _sql_list(*(s for c in ("lon", "lat") for f in FREQS for s in _sincos(f"{c} * {f!r}")))),
    "E5_spherec": (lambda x, y: E.spherec(x, y, FREQS), _doubled("sy ycx ysx")),
    "E6_spherecplus": (lambda x, y: E.spherecplus(x, y, FREQS), _doubled("sy cy sx cx ycx ysx")),
    "E7_spherem": (lambda x, y: E.spherem(x, y, FREQS), _doubled("sy ycx0 y0cx ysx0 y0sx")),
    "E8_spheremplus": (lambda x, y: E.spheremplus(x, y, FREQS), _doubled("sy cy sx cx ycx0 y0cx ysx0 y0sx")),
    "E9_theory": (lambda x, y: E.theory(x, y, FREQS), _sql_list(*(f"{'sin' if (i % (len(_DOUBLE_ANGLES) // 2)) % 2 == 0 else 'cos'}({a})" for i, a in enumerate(_DOUBLE_ANGLES)))),
    "E14_gridcell": (lambda x, y: E.gridcell(x, y, FREQS), _sql_list(*(s for c in ("lon", "lat") for f in FREQS for s in _sincos(f"{c} * {f!r}")))),
    "E15_hexagrid": (lambda x, y: E.hexagrid(x, y, 3, 360.0), _sql_list(*(f"sin({c} / {360.0 ** (i / 2)!r} + {p!r})" for c in ("lon", "lat") for i in range(3) for p in (0.0, math.pi * 2.0 / 3, math.pi * 4.0 / 3)))),
    "E16_csp_theory": (lambda x, y: E.csp_theory(x, y, FREQS), _sql_list(*(s for a in _ANGLES for s in _sincos(a)))),
    "E16_csp_theorynorm": (lambda x, y: E.csp_theorynorm(x, y, FREQS), _sql_list(*(s for a in _NANGLES for s in _sincos(a)))),
    "E16_csp_theorydiag": (lambda x, y: F.flatten(E.csp_theorydiag(x, y, FREQS)), _sql_list(*(s for a in _ANGLES for s in _sincos(a)))),
    "E17_naive": (lambda x, y: E.naive(x, y, EXTENT), _sql_list("(lon + 120.0) / 180.0 * 2 - 1", "(lat + 45.0) / 125.0 * 2 - 1")),
    "E18_rbf": (lambda x, y: E.rbf(x, y, ANCHORS, 40.0, 0.5), _sql_list(*(f"exp(-((lon - ({a})) * (lon - ({a})) + (lat - ({b})) * (lat - ({b}))) / (2.0 * pow({math.hypot(a, b) * 0.5 + 40.0!r}, 2)))" for a, b in ANCHORS))),
    "E19_rff": (lambda x, y: E.rff(x, y, RFF_DIRECTIONS, RFF_SHIFTS), _sql_list(*(f"cos({_u} * ({a}) + {_v} * ({b}) + {s}) * {math.sqrt(2 / 3)!r}" for (a, b), s in zip(RFF_DIRECTIONS, RFF_SHIFTS, strict=True)))),
    "E20_sin_cos": (lambda x, y: E.sin_cos(x, y), _sql_list(f"sin({_u} * {_pi})", f"sin({_v} * {_pi})", f"cos({_u} * {_pi})", f"cos({_v} * {_pi})")),
}


def _encoding(name: str, build, sql: str) -> None:
    @query(name, PTS + " " + sql_entries(sql, "pts"))
    def run(spark, d, build=build):
        return entries(points(spark, d).select("point_id", build(F.col("lon"), F.col("lat")).alias("v")), "v", "point_id")


for _name, (_build, _sql) in ENCODINGS.items():
    _encoding(_name, _build, _sql)


def _harmonics_sql(x: str, y: str, analytic: bool) -> list[str]:
    """Degrees 0 to 2 by hand; x, y: longitude and latitude."""
    p, t = f"radians({x} + 180)", f"radians({y} + 90)"
    k = lambda l, m: math.sqrt((2 * l + 1) * math.factorial(l - m) / (4 * math.pi * math.factorial(l + m)))
    legendre = {(0, 0): "1.0", (1, 0): f"cos({t})", (1, 1): f"(-sin({t}))", (2, 0): f"((3 * cos({t}) * cos({t}) - 1) / 2)", (2, 1): f"(-3 * cos({t}) * sin({t}))", (2, 2): f"(3 * sin({t}) * sin({t}))"}
    out = []
    for l in range(3):
        for m in range(-l, l + 1):
            a = abs(m)
            angle = "1.0" if m == 0 else f"cos({a} * {p})" if m > 0 else f"sin({a} * {p})"
            scale = k(l, a) * (math.sqrt(2) if m else 1.0) * ((math.pi if m == 0 else (-1.0) ** m) if analytic else 1.0)
            out.append(f"{scale!r} * {angle} * {legendre[l, a]}")
    return out


@query("E10_spherical_harmonics", PTS + " " + sql_entries(_sql_list(*_harmonics_sql("lon", "lat", False)), "pts"))
def e10(spark, d):
    return entries(points(spark, d).select("point_id", E.spherical_harmonics(F.col("lon"), F.col("lat"), 3).alias("v")), "v", "point_id")


@query("E11_spherical_harmonics_analytic", PTS + " " + sql_entries(_sql_list(*_harmonics_sql("lon", "lat", True)), "pts"))
def e11(spark, d):
    return entries(points(spark, d).select("point_id", E.spherical_harmonics_analytic(F.col("lon"), F.col("lat"), 3).alias("v")), "v", "point_id")


def _cell(x: str, n: int) -> str:
    return f"least(greatest({x}, 0), {n - 1})"


_FLOOR = _harmonics_sql("(-180 + 360.0 * xf / 359)", "(-90 + 180.0 * yf / 179)", True)
_CEIL = _harmonics_sql("(-180 + 360.0 * xc / 359)", "(-90 + 180.0 * yc / 179)", True)


@query("E12_spherical_harmonics_discretized", PTS + f""", c AS (SELECT point_id, lon + 180 - floor(lon + 180) AS fx, lat + 90 - floor(lat + 90) AS fy,
  {_cell("floor(lon + 180)", 360)} AS xf, {_cell("ceil(lon + 180)", 360)} AS xc, {_cell("floor(lat + 90)", 180)} AS yf, {_cell("ceil(lat + 90)", 180)} AS yc FROM pts) """
       + sql_entries(_sql_list(*(f"({a}) * (1 - fx) * (1 - fy) + ({b}) * fx * (1 - fy)" for a, b in zip(_FLOOR, _CEIL, strict=True))), "c"))
def e12(spark, d):
    from terravec.operators.raster import harmonics_discretized

    return entries(harmonics_discretized(points(spark, d), 3), "v", "point_id")


def _weights(degree: int, width: int):
    import numpy as np

    return ((np.arange(degree * degree * width) * 37 + 11) % 23 / 23.0 - 0.5).reshape(degree, degree, width)


_ROWS = E.harmonic_weight_rows(3)


@query("E13_spherical_harmonics_weighted", PTS + " " + sql_entries(_sql_list(*(" + ".join(f"({h}) * ({float(_weights(3, 2)[l, m, e])!r})" for h, (l, m) in zip(_harmonics_sql("lon", "lat", True), _ROWS, strict=True)) for e in range(2))), "pts"))
def e13(spark, d):
    return entries(points(spark, d).select("point_id", E.spherical_harmonics_weighted(F.col("lon"), F.col("lat"), _weights(3, 2)).alias("v")), "v", "point_id")


_FRACTION = "((dayofyear(ts) - 1) / 365.0)"
_D = f"((2 * {_FRACTION} - 1) * {_pi})"


@query("E22_loc_time", EVENTS + " " + sql_entries(_sql_list(f"cos({_u} * {_pi}) * cos({_v} * {_pi})", f"sin({_u} * {_pi}) * cos({_v} * {_pi})", f"sin({_v} * {_pi})", f"sin({_D})", f"cos({_D})"), "pts"))
def e22(spark, d):
    p = event_points(spark, d)
    return entries(p.select("point_id", E.loc_time(F.col("lon"), F.col("lat"), E.date_fraction(F.col("ts")), "encode_3D").alias("v")), "v", "point_id")


@query("D1_encode_date", EVENTS + " " + sql_entries(_sql_list(f"sin({_D})", f"cos({_D})"), "pts"))
def d1(spark, d):
    return entries(event_points(spark, d).select("point_id", E.encode_date(E.date_fraction(F.col("ts"))).alias("v")), "v", "point_id")


# strings


@query("X1_parse_tsv_coords", f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE round(doc_id % 360 - 180.5, 6) + 0.0 END AS lon, round((doc_id % 170 - 85) / 2.0, 6) + 0.0 AS lat FROM documents""")
def x1(spark, d):
    docs = table(spark, d, "documents")
    k = F.col("doc_id")
    lon = F.when(k % 7 == 0, F.lit("n/a")).otherwise((k % 360 - F.lit(180.5)).cast("string"))
    packed = F.concat_ws("\t", k.cast("string"), F.col("lang"), F.col("source"), *(F.lit("x") for _ in range(8)), lon, ((k % 170 - 85) / F.lit(2.0)).cast("string"), F.lit("end"))
    x, y = X.parse_tsv_coords(F.col("packed"))
    return docs.select("doc_id", packed.alias("packed")).select("doc_id", r6(x).alias("lon"), r6(y).alias("lat"))


@query("X2_format_prompt", "SELECT n_nationkey, 'An image of a ' || n_name AS prompt FROM nation")
def x2(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.format_prompt(F.col("n_name")).alias("prompt"))


@query("X3_neuron_label", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'act' ELSE 'Neuron ' || CAST(c_custkey - 1 AS VARCHAR) END AS label FROM customer""")
def x3(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.lit("act")).otherwise(F.concat(F.lit("act"), k.cast("string"), F.lit("_v2")))
    return table(spark, d, "customer").select("c_custkey", X.neuron_label(name).alias("label"))


@query("X4_path_parts", """SELECT page_id, name, CASE WHEN page_id % 3 = 2 THEN 'img' || page_id ELSE 'img' || page_id END AS stem, page_id % 3 <> 2 AS tiff
FROM (SELECT page_id, 'img' || page_id || CASE page_id % 3 WHEN 0 THEN '.TIF' WHEN 1 THEN '.tiff' ELSE '.png' END AS name FROM pages)""")
def x4(spark, d):
    k = F.col("page_id")
    path = F.concat(F.lit("s3/images/"), F.lit("img"), k.cast("string"), F.when(k % 3 == 0, ".TIF").when(k % 3 == 1, ".tiff").otherwise(".png"))
    p = table(spark, d, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", X.basename(F.col("path")).alias("name"), X.stem(F.col("path")).alias("stem"), X.is_tiff(F.col("path")).alias("tiff"))


@query("X5_crop_name", "SELECT l_orderkey, l_linenumber, printf('bbox_%03d_area%d_x%d_y%d_w%d_h%d.png', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), 16, 16) AS crop FROM lineitem")
def x5(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", X.crop_name(F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.lit(16), F.lit(16)).alias("crop"))


@query("X6_format_metric", "SELECT l_returnflag, l_linestatus, printf('%.3f ± %.3f', avg(l_quantity), stddev_samp(l_quantity)) AS metric, printf('%.1f', avg(l_quantity)) AS short FROM lineitem GROUP BY ALL")
def x6(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s"))
    return g.select("l_returnflag", "l_linestatus", X.format_metric(F.col("m"), F.col("s")).alias("metric"), X.format_metric(F.col("m"), decimals=1).alias("short"))


# arrays

_E = "CAST(embedding AS DOUBLE[])"
_N = f"sqrt(list_inner_product({_E}, {_E}))"
_UNIT = "list_transform(e, lambda x: x / greatest(n, 1e-12))"


@query("V1_l2_normalize", sql_entries(_UNIT, f"(SELECT vec_id, {_E} AS e, {_N} AS n FROM embeddings)", "vec_id"))
def v1(spark, d):
    return entries(table(spark, d, "embeddings").select("vec_id", A.l2_normalize(A.doubles(F.col("embedding"))).alias("v")), "v", "vec_id")


@query("V2_center_normalize", f"""WITH u AS (SELECT vec_id, {_UNIT} AS e FROM (SELECT vec_id, {_E} AS e, {_N} AS n FROM embeddings)),
m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(x) AS a FROM (SELECT generate_subscripts(e, 1) AS i, unnest(e) AS x FROM u) GROUP BY i)),
c AS (SELECT vec_id, list_transform(list_zip(e, m), lambda p: p[1] - p[2]) AS e FROM u, m) """
       + sql_entries("list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-12))", "c", "vec_id"))
def v2(spark, d):
    from terravec.operators.vectors import vector_mean

    e = table(spark, d, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("x"))
    mean = vector_mean(e.select(A.l2_normalize(F.col("x")).alias("u")), "u")
    return entries(e.join(F.broadcast(mean)).select("vec_id", A.center_normalize(F.col("x"), F.col("mean")).alias("v")), "v", "vec_id")


@query("V3_dot_cosine", f"""WITH e AS (SELECT vec_id, {_E} AS e FROM embeddings)
SELECT a.vec_id, round(list_inner_product(a.e, b.e), 6) + 0.0 AS dot, round(list_cosine_similarity(a.e, b.e), 6) + 0.0 AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def v3(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("x"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(nxt, "vec_id").select("vec_id", r6(A.dot(F.col("x"), F.col("y"))).alias("dot"), r6(A.cosine(F.col("x"), F.col("y"))).alias("cosine"))


@query("V4_l0", "SELECT vec_id, len(list_filter(v, lambda x: x <> 0)) AS l0, len(list_filter(v, lambda x: x > 0)) AS positive FROM (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN abs(x) < 0.1 THEN 0 ELSE x END) AS v FROM embeddings)")
def v4(spark, d):
    v = F.transform("embedding", lambda x: F.when(F.abs(x) < F.lit(0.1), F.lit(0.0)).otherwise(x))
    e = table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    return e.select("vec_id", A.l0(F.col("v")).cast("bigint").alias("l0"), A.count_positive(F.col("v")).cast("bigint").alias("positive"))


def _band_value(band: str, pixel: str) -> str:
    return f"CAST((vec_id * 31 + {band} * 977 + {pixel} * 131) % 9000 AS DOUBLE)"


@query("V5_scale_bands", f"""WITH b AS (SELECT vec_id, b, p, CASE WHEN b = 10 THEN 0.0 ELSE {_band_value("(CASE WHEN b > 10 THEN b - 1 ELSE b END)", "p")} / 10000.0 END AS v
  FROM embeddings, range(13) AS x(b), range(4) AS y(p))
SELECT vec_id, CAST(b AS INTEGER) AS b, CAST(p AS INTEGER) AS p, round(v, 6) + 0.0 AS v, CAST(CASE WHEN b IN (1, 2, 3) THEN floor(least(greatest(v, 0), 1) * 255) END AS INTEGER) AS byte FROM b""")
def v5(spark, d):
    value = lambda b, p: ((F.col("vec_id") * 31 + b * 977 + p * 131) % 9000).cast("double")
    bands = F.array(*(F.array(*(value(b, p) for p in range(4))) for b in range(12)))
    s = table(spark, d, "embeddings").select("vec_id", A.scale_bands(bands, F.lit(True)).alias("s"))
    s = s.select("vec_id", "s", A.rgb_bytes(F.col("s")).alias("rgb"))
    flat = s.select("vec_id", "rgb", F.posexplode("s").alias("b", "plane")).select("vec_id", "rgb", "b", F.posexplode("plane").alias("p", "v"))
    return flat.select("vec_id", "b", "p", r6(F.col("v")).alias("v"), F.when(F.col("b").between(1, 3), F.get(F.get("rgb", 3 - F.col("b")), F.col("p"))).alias("byte"))


@query("V6_strip_cls", """SELECT vec_id, len(v) AS n, round(v[1], 6) + 0.0 AS first FROM
(SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN CAST(embedding[2:17] AS DOUBLE[]) ELSE CAST(embedding[1:16] AS DOUBLE[]) END AS v FROM embeddings)""")
def v6(spark, d):
    tokens = F.when(F.col("vec_id") % 2 == 0, F.slice("embedding", 1, 17)).otherwise(F.slice("embedding", 1, 16))
    v = table(spark, d, "embeddings").select("vec_id", A.strip_cls(A.doubles(tokens)).alias("v"))
    return v.select("vec_id", F.size("v").cast("bigint").alias("n"), r6(F.element_at("v", 1)).alias("first"))


@query("V7_clip_box", """SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(round_even(cx, 0) - 8, 64 - 16)) AS INTEGER) AS x, CAST(greatest(0, least(round_even(cy, 0) - 8, 48 - 16)) AS INTEGER) AS y, CAST(16 AS INTEGER) AS w, CAST(16 AS INTEGER) AS h
FROM (SELECT l_orderkey, l_linenumber, l_quantity * 1.5 AS cx, l_suppkey % 50 + 0.5 AS cy FROM lineitem)""")
def v7(spark, d):
    li = table(spark, d, "lineitem")
    box = A.clip_box(F.col("l_quantity") * 1.5, F.col("l_suppkey") % 50 + F.lit(0.5), F.lit(16), F.lit(64), F.lit(48))
    return li.select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.x", "b.y", "b.w", "b.h")

"""Queries of point sets, samples, splits, filters and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravec.operators import filters as L
from terravec.operators import points as P
from terravec.plans.base import event_points, points, query, r6, sql_points, table

EVENTS = "WITH " + sql_points("pts", "events", "event_id", ", ts, user_id, value, event_type")
PTS = "WITH " + sql_points()
SHAPES = {
    "box": [[(-20.0, -10.0), (40.0, -10.0), (40.0, 35.0), (-20.0, 35.0)]],
    "concave": [[(60.0, 0.0), (120.0, 0.0), (120.0, 60.0), (90.0, 20.0), (60.0, 60.0)]],
    "holed": [[(-150.0, -60.0), (-60.0, -60.0), (-60.0, 20.0), (-150.0, 20.0)], [(-120.0, -40.0), (-90.0, -40.0), (-90.0, 0.0), (-120.0, 0.0)]],
    "two_parts": [[(130.0, -50.0), (150.0, -50.0), (150.0, -30.0), (130.0, -30.0)], [(155.0, -50.0), (175.0, -50.0), (165.0, -20.0)]],
}
EDGES = ", ".join(f"('{name}', {r[i][0]}, {r[i][1]}, {r[(i + 1) % len(r)][0]}, {r[(i + 1) % len(r)][1]})" for name, rings in SHAPES.items() for r in rings for i in range(len(r)))
INSIDE = f"""e(region, x0, y0, x1, y1) AS (VALUES {EDGES}),
ins AS (SELECT point_id, region FROM pts, e GROUP BY ALL HAVING sum(CASE WHEN (y0 > lat) <> (y1 > lat) AND lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0 THEN 1 ELSE 0 END) % 2 = 1)"""


@query("F1_drop_bad_coords", EVENTS + " SELECT point_id FROM pts WHERE point_id % 10 NOT IN (0, 1)")
def f1(spark, d):
    k = F.col("point_id") % 10
    p = event_points(spark, d).withColumns({"lon": F.when(k != 0, F.col("lon")), "lat": F.when(k == 1, F.lit(float("nan"))).otherwise(F.col("lat"))})
    return P.drop_bad_coords(p).select("point_id")


def _listing(spark, d):
    p = table(spark, d, "pages")
    return p.filter(F.col("page_id") % 4 != 0).select(F.col("url").alias("path"), F.octet_length("html").cast("bigint").alias("length"))


def _index(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("url").alias("path"))


LISTING = "l AS (SELECT url AS path, octet_length(CAST(encode(html) AS BLOB)) AS length FROM pages WHERE page_id % 4 <> 0)"


@query("F2_keep_existing_files", f"WITH {LISTING} SELECT page_id, url AS path FROM pages WHERE url IN (SELECT path FROM l)")
def f2(spark, d):
    return L.keep_existing_files(_index(spark, d), _listing(spark, d))


@query("F2_loaded_report", f"WITH {LISTING} SELECT count(*) FILTER (url IN (SELECT path FROM l)) AS loaded, count(*) AS total FROM pages")
def f2b(spark, d):
    i = _index(spark, d)
    return L.loaded_report(i, L.keep_existing_files(i, _listing(spark, d)))


@query("F3_keep_large_files", f"WITH {LISTING} SELECT page_id, url AS path FROM pages JOIN l ON l.path = url WHERE length >= 3000")
def f3(spark, d):
    return L.keep_large_files(_index(spark, d), _listing(spark, d), min_bytes=3000)


@query("F3_size_report", f"WITH {LISTING} SELECT count(*) FILTER (length < 3000) AS skipped, count(*) AS total FROM pages JOIN l ON l.path = url")
def f3b(spark, d):
    return L.size_report(_index(spark, d), _listing(spark, d), min_bytes=3000)


@query("F4_check_integrity", f"WITH {LISTING} SELECT DISTINCT url AS path FROM pages WHERE url NOT IN (SELECT path FROM l)")
def f4(spark, d):
    return L.check_integrity(_index(spark, d), _listing(spark, d))


@query("F5_text_column", "WITH " + sql_points("pts", "documents", "doc_id", ", text") + " SELECT round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, text FROM pts")
def f5(spark, d):
    from terravec.plans.base import located

    docs = located(table(spark, d, "documents").select("doc_id", F.col("text").alias("caption")), "doc_id")
    return L.with_text(docs).select(r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), "text")


@query("F6_filter_label", "SELECT vec_id, label FROM embeddings WHERE label = 3")
def f6(spark, d):
    return L.filter_label(table(spark, d, "embeddings"), 3).select("vec_id", "label")


@query("F7_select_regions", EVENTS + f", {INSIDE} SELECT DISTINCT point_id FROM ins WHERE region IN ('box', 'holed')")
def f7(spark, d):
    some = P.select_regions(P.polygons_from(spark, SHAPES), ["box", "holed"], "merged")
    return P.points_within(event_points(spark, d), some).select("point_id")


@query("F8_points_within", EVENTS + f", {INSIDE} SELECT point_id FROM ins")
def f8(spark, d):
    return P.points_within(event_points(spark, d), P.polygons_from(spark, SHAPES)).select("point_id")


@query("F9_swap_axes", EVENTS + " SELECT point_id, round(lat, 6) + 0.0 AS first, round(lon, 6) + 0.0 AS second FROM pts")
def f9(spark, d):
    p = event_points(spark, d).select("point_id", P.swap_axes(F.col("lon"), F.col("lat"), False).alias("v"))
    return p.select("point_id", r6(F.get("v", F.lit(0))).alias("first"), r6(F.get("v", F.lit(1))).alias("second"))


def long_activations(spark, d, neurons: int = 64):
    """relu of one embedding entry for each neuron (all 64 at first), zeros left out."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), "label", F.posexplode(F.slice("embedding", 1, neurons)).alias("neuron", "x"))
    return e.filter("x > 0").select("point_id", "label", "neuron", F.col("x").cast("double").alias("act"))


LONG = "la AS (SELECT vec_id AS point_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS neuron, CAST(unnest(embedding) AS DOUBLE) AS act FROM embeddings), ac AS (SELECT * FROM la WHERE act > 0)"


@query("F10_positive_activations", f"""WITH {LONG} SELECT point_id, neuron, round(act, 6) + 0.0 AS act FROM ac WHERE act > 0.2 AND neuron IN
 (SELECT neuron FROM ac WHERE act > 0.2 GROUP BY neuron HAVING count(*) >= 5 ORDER BY neuron LIMIT 6)""")
def f10(spark, d):
    a = long_activations(spark, d).filter("act > 0.2")
    return L.positive_activations(a, 5, 6).select("point_id", "neuron", r6(F.col("act")).alias("act"))


@query("F11_mask_rare_neurons", f"WITH {LONG}, s AS (SELECT * FROM ac WHERE act > 0.2) SELECT neuron, count(*) AS n FROM s WHERE neuron IN (SELECT neuron FROM s GROUP BY neuron HAVING count(*) >= 20) GROUP BY neuron")
def f11(spark, d):
    return L.mask_rare_neurons(long_activations(spark, d).filter("act > 0.2"), 20).groupBy("neuron").agg(F.count(F.lit(1)).alias("n"))


@query("F12_intervene", f"WITH {LONG} SELECT point_id, neuron AS concept_id, round(act, 6) + 0.0 AS weight FROM ac WHERE neuron NOT IN (1, 4, 7)")
def f12(spark, d):
    w = long_activations(spark, d).select("point_id", F.col("neuron").alias("concept_id"), r6(F.col("act")).alias("weight"))
    return L.intervene(w, [1, 4, 7])


PLANE = "pl AS (SELECT vec_id AS row_id, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y FROM embeddings)"


def plane(spark, d):
    x = lambda k: F.get("embedding", F.lit(k)).cast("double") * 10
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), x(0).alias("x"), x(1).alias("y"))


CELLS = f"""WITH {PLANE}, b AS (SELECT min(x) - 0.05 * (max(x) - min(x) + 1e-6) AS xa, max(x) + 0.05 * (max(x) - min(x) + 1e-6) AS xb, min(y) - 0.05 * (max(y) - min(y) + 1e-6) AS ya, max(y) + 0.05 * (max(y) - min(y) + 1e-6) AS yb FROM pl),
c AS (SELECT r AS row, k AS col, xa + (xb - xa) * k / 3 AS x0, xa + (xb - xa) * (k + 1) / 3 AS x1, ya + (yb - ya) * r / 3 AS y0, ya + (yb - ya) * (r + 1) / 3 AS y1 FROM b, range(3) AS s(r), range(3) AS t(k)),
m AS (SELECT row_id, x, y, row, col FROM pl JOIN c ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)"""


@query("F13_in_cell", CELLS + " SELECT row_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM m")
def f13(spark, d):
    return L.assign_grid_cells(plane(spark, d)).select("row_id", "row", "col")


@query("R1_assign_grid_cells", CELLS + """, v AS (SELECT row, col, count(*) AS n, min(x) AS a, max(x) AS b, min(y) AS e, max(y) AS f FROM m GROUP BY ALL)
SELECT CAST(c.row AS INTEGER) AS row, CAST(c.col AS INTEGER) AS col, coalesce(n, 0) AS n, round(coalesce(a - 0.1 * (b - a + 1e-6), x0), 6) + 0.0 AS view_x0, round(coalesce(b + 0.1 * (b - a + 1e-6), x1), 6) + 0.0 AS view_x1,
 round(coalesce(e - 0.1 * (f - e + 1e-6), y0), 6) + 0.0 AS view_y0, round(coalesce(f + 0.1 * (f - e + 1e-6), y1), 6) + 0.0 AS view_y1 FROM c LEFT JOIN v ON c.row = v.row AND c.col = v.col""")
def r1(spark, d):
    v = L.cell_views(plane(spark, d))
    return v.select("row", "col", "n", *(r6(F.col(c)).alias(c) for c in ("view_x0", "view_x1", "view_y0", "view_y1")))


@query("F14_first_existing_path", f"""WITH {LISTING}, c AS (SELECT page_id, url AS path, 0 AS priority FROM pages UNION ALL SELECT page_id - 1, url, 1 FROM pages)
SELECT page_id, arg_min(path, priority) FILTER (path IN (SELECT path FROM l)) AS path FROM c GROUP BY page_id""")
def f14(spark, d):
    i = _index(spark, d)
    c = i.select("page_id", "path", F.lit(0).alias("priority")).unionByName(i.select((F.col("page_id") - 1).alias("page_id"), "path", F.lit(1).alias("priority")))
    return L.first_existing_path(c, _listing(spark, d), "page_id")


@query("R2_to_long_and_wide", f"WITH {LONG} SELECT point_id, " + ", ".join(f"round(coalesce(sum(act) FILTER (neuron = {i}), 0), 6) + 0.0 AS act{i + 1}" for i in range(4)) + " FROM ac WHERE neuron < 4 GROUP BY point_id")
def r2(spark, d):
    a = long_activations(spark, d, 4)
    wide = L.activations_to_wide(a, 4, "point_id")
    again = L.activations_to_wide(L.activations_to_long(wide, "point_id"), 4, "point_id")
    return again.select("point_id", *(r6(F.col(f"act{i + 1}")).alias(f"act{i + 1}") for i in range(4)))


@query("U0a_union_draws", None)
def u0a(spark, d):
    """As many land points as there are suppliers."""
    n = table(spark, d, "supplier").count()
    return P.union_draws(spark, P.polygons_from(spark, SHAPES), n).select("draw_id", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"))


def _draw(key, salt):
    """A draw of a draw's number that SQL has too: the points rule's, for the first and the second one."""
    return ((key * 7919 + 13) % 10007) / 10007.0 if salt == 0 else ((key * 104729 + 7) % 10009) / 10009.0


def _sql_draws(n: str, name: str = "dr") -> str:
    return f"{name} AS (SELECT i AS draw_id, ((i * 7919 + 13) % 10007) / 10007.0 AS u, ((i * 104729 + 7) % 10009) / 10009.0 AS v FROM range({n}) AS t(i))"


_ON_SPHERE = "360 * u - 180 AS lon, degrees(asin(2.0 * v - 1.0)) AS lat"


@query("U0a_union_rule_draws", f"""WITH {_sql_draws("(SELECT 200 * count(*) FROM supplier)")}, pts AS (SELECT draw_id AS point_id, {_ON_SPHERE} FROM dr), {INSIDE}
SELECT point_id AS draw_id, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat FROM pts WHERE point_id IN (SELECT point_id FROM ins) ORDER BY point_id LIMIT (SELECT count(*) FROM supplier)""")
def u0a_rule(spark, d):
    """The same by draws that follow a rule; rounds are appended until there are enough."""
    n = table(spark, d, "supplier").count()
    found = P.union_draws(spark, P.polygons_from(spark, SHAPES), n, oversample=3, draw=_draw)
    return found.select("draw_id", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"))


@query("U0b_distinct_features", f"""WITH {LONG}, f AS (SELECT DISTINCT CASE WHEN label < 5 THEN 0 ELSE 1 END AS part, neuron FROM ac),
o AS (SELECT neuron, row_number() OVER (ORDER BY part, neuron DESC) AS k FROM f), m AS (SELECT neuron, min(k) AS k FROM o GROUP BY neuron)
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS rank, neuron FROM m""")
def u0b_distinct(spark, d):
    """The features of two data sets, each from the highest down, in the order in which they are first met."""
    met = long_activations(spark, d).select((F.col("label") >= 5).cast("int").alias("part"), "neuron").distinct().collect()  # features, not rows
    lists = {f"{part}": sorted((r[1] for r in met if r[0] == part), reverse=True) for part in (0, 1)}
    return spark.createDataFrame(list(enumerate(L.distinct_features(lists))), "rank int, neuron int")


@query("U0b_union_datasets", f"WITH {LONG} SELECT point_id, neuron, 'first' AS dataset FROM ac WHERE label < 5 AND neuron IN (0, 1, 2) UNION ALL SELECT point_id, neuron, 'second' FROM ac WHERE label >= 5 AND neuron IN (2, 3)")
def u0b(spark, d):
    a = long_activations(spark, d)
    return L.union_datasets({"first": a.filter("label < 5"), "second": a.filter("label >= 5")}, {"first": [0, 1, 2], "second": [2, 3, 99]}).select("point_id", "neuron", "dataset")


@query("U0c_missing_inputs", f"WITH {LISTING} SELECT DISTINCT url AS path FROM pages WHERE url NOT IN (SELECT path FROM l)")
def u0c(spark, d):
    return L.missing_inputs(_index(spark, d), _listing(spark, d))


@query("W13_marker_strength", f"""WITH {LONG}, s AS (SELECT *, min(act) OVER w AS lo, max(act) OVER w AS hi, count(*) OVER w AS n FROM ac WINDOW w AS (PARTITION BY neuron))
SELECT point_id, neuron, round(CASE WHEN n = 1 THEN 1.0 ELSE 8 * (1 + 6 * CASE WHEN hi > lo THEN (act - lo) / (hi - lo) ELSE 0 END) END, 6) + 0.0 AS strength FROM s""")
def w13(spark, d):
    return L.marker_strength(long_activations(spark, d), "act").select("point_id", "neuron", r6(F.col("strength")).alias("strength"))


# draws


@query("G1_sphere_points", """SELECT event_id, round(360 * u - 180, 6) + 0.0 AS lon, round(degrees(asin(sin(radians(-30.0)) + v * (sin(radians(75.0)) - sin(radians(-30.0))))), 6) + 0.0 AS lat
FROM (SELECT event_id, ((event_id * 7919 + 13) % 10007) / 10007.0 AS u, ((event_id * 104729 + 7) % 10009) / 10009.0 AS v FROM events)""")
def g1(spark, d):
    """The rule of the sphere over keys' draws, between two latitudes."""
    k = F.col("event_id")
    lon, lat = P.on_sphere(((k * 7919 + 13) % 10007) / 10007.0, ((k * 104729 + 7) % 10009) / 10009.0, (-30.0, 75.0))
    return table(spark, d, "events").select("event_id", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query("G1_sphere_draws", f"""WITH {_sql_draws("(SELECT count(*) FROM customer)")}
SELECT draw_id, round(360 * u - 180, 6) + 0.0 AS lon, round(degrees(asin(sin(radians(-30.0)) + v * (sin(radians(75.0)) - sin(radians(-30.0))))), 6) + 0.0 AS lat FROM dr""")
def g1_draws(spark, d):
    """As many draws as there are customers."""
    p = P.sphere_points(spark, table(spark, d, "customer").count(), lat_range=(-30.0, 75.0), draw=_draw)
    return p.select("draw_id", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"))


ORDER = "((event_id * 7919 + 13) % 10007)"


def _order():
    return (F.col("event_id") * 7919 + 13) % 10007


@query("G2_sample_n", f"SELECT event_id FROM events ORDER BY {ORDER}, event_id LIMIT 700")
def g2(spark, d):
    return P.sample_n(table(spark, d, "events"), 700, "event_id", order=_order()).select("event_id")


@query("G3_sample_fraction", f"SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {ORDER}, event_id) AS r, count(*) OVER () AS n FROM events) WHERE r <= round_even(n * 0.1, 0)")
def g3(spark, d):
    return P.sample_fraction(table(spark, d, "events"), 0.1, "event_id", order=_order()).select("event_id")


@query("G4_split_train_val", f"SELECT event_id, CASE WHEN r <= floor(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM (SELECT event_id, row_number() OVER (ORDER BY {ORDER}, event_id) AS r, count(*) OVER () AS n FROM events)")
def g4(spark, d):
    return P.split_train_val(table(spark, d, "events").select("event_id"), 0.1, "event_id", order=_order())


@query("G5_split_train_val_test", f"""SELECT event_id, CASE WHEN r <= ceil(n * 0.1) THEN 'test' WHEN r <= ceil(n * 0.1) + ceil((n - ceil(n * 0.1)) * 0.1) THEN 'val' ELSE 'train' END AS split
FROM (SELECT event_id, row_number() OVER (ORDER BY {ORDER}, event_id) AS r, count(*) OVER () AS n FROM events)""")
def g5(spark, d):
    return P.split_train_val_test(table(spark, d, "events").select("event_id"), 0.1, 0.1, "event_id", order=_order())


@query("G6_grid_in_polygon", """
WITH b AS (SELECT CAST(c_nationkey AS VARCHAR) AS region, min(c_custkey % 91)::DOUBLE AS x0, min(c_custkey % 91) + CASE WHEN c_nationkey = 0 THEN 0.1 ELSE 7.3 END::DOUBLE AS x1,
  min(c_custkey % 37)::DOUBLE AS y0, min(c_custkey % 37) + CASE WHEN c_nationkey = 0 THEN 0.1 ELSE 5.2 END::DOUBLE AS y1 FROM customer GROUP BY c_nationkey),
g AS (SELECT region, x0 + 0.5 * i AS lon, y0 + 0.5 * j AS lat FROM b, range(20) AS s(i), range(20) AS t(j) WHERE i > 0 AND j > 0 AND x0 + 0.5 * i < x1 AND y0 + 0.5 * j < y1)
SELECT region, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat FROM g UNION ALL SELECT region, round((x0 + x1) / 2, 6) + 0.0, round((y0 + y1) / 2, 6) + 0.0 FROM b WHERE region NOT IN (SELECT region FROM g)""")
def g6(spark, d):
    """Boxes of a nation's customer keys as regions; one is too small for any grid point."""
    c = table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 91).cast("double").alias("x"), (F.col("c_custkey") % 37).cast("double").alias("y"))
    b = c.groupBy("c_nationkey").agg(F.min("x").alias("x0"), (F.min("x") + F.when(F.col("c_nationkey") == 0, 0.1).otherwise(7.3)).alias("x1"), F.min("y").alias("y0"), (F.min("y") + F.when(F.col("c_nationkey") == 0, 0.1).otherwise(5.2)).alias("y1"))
    at = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    polygons = b.select(F.col("c_nationkey").cast("string").alias("region"), F.array(F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"), at("x0", "y0"))).alias("rings"))
    return P.grid_in_polygon(polygons, 0.5).select("region", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"))


@query("G7_coord_grid", """WITH g AS (SELECT c_custkey, c_custkey // 40 % 30 AS row, c_custkey % 40 AS col FROM customer)
SELECT c_custkey, round(-180 + col * 360.0 / 39, 6) + 0.0 AS lon, round(90 - row * 180.0 / 29, 6) + 0.0 AS lat FROM g""")
def g7(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.floor(F.col("c_custkey") / 40) % 30).cast("int").alias("row"), (F.col("c_custkey") % 40).cast("int").alias("col"))
    return c.join(P.coord_grid(spark, 30, 40), ["row", "col"]).select("c_custkey", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"))


@query("G7_coord_grid_of_split", """WITH g AS (SELECT c_custkey // 40 % 30 AS row, c_custkey % 40 AS col, max(c_nationkey % 3) AS split FROM customer GROUP BY ALL)
SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(-180 + col * 360.0 / 39, 6) + 0.0 AS lon, round(90 - row * 180.0 / 29, 6) + 0.0 AS lat FROM g WHERE split = 1""")
def g7_split(spark, d):
    c = table(spark, d, "customer").select((F.floor(F.col("c_custkey") / 40) % 30).cast("int").alias("row"), (F.col("c_custkey") % 40).cast("int").alias("col"), (F.col("c_nationkey") % 3).alias("split"))
    cells = P.coord_grid_of_split(P.coord_grid(spark, 30, 40), c.groupBy("row", "col").agg(F.max("split").alias("split")), 1)
    return cells.select("row", "col", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"))


MASK = "m AS (SELECT p_partkey, p_partkey // 50 AS row, p_partkey % 50 AS col, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1 END AS valid FROM part)"


@query("G8_checkerboard_split", f"""WITH {MASK}, s AS (SELECT row, col, CASE WHEN valid = 0 THEN 0 WHEN (row // 5 + col // 5) % 2 = 0 THEN 2 ELSE 1 END AS split FROM m),
t AS (SELECT row, col, row_number() OVER (ORDER BY (row * 37 + col * 101) % 997, row, col) AS r, count(*) OVER () AS n FROM s WHERE split = 1)
SELECT CAST(s.row AS BIGINT) AS row, CAST(s.col AS BIGINT) AS col, CAST(CASE WHEN r <= floor(n * (1.0::DOUBLE - 0.7)) THEN 0 ELSE split END AS INTEGER) AS split FROM s LEFT JOIN t ON s.row = t.row AND s.col = t.col""")
def g8(spark, d):
    k = F.col("p_partkey")
    m = table(spark, d, "part").select(F.floor(k / 50).alias("row"), (k % 50).alias("col"), F.when(k % 11 == 0, 0).otherwise(1).alias("valid"))
    return P.checkerboard_split(m, 5, 0.7, order=(F.col("row") * 37 + F.col("col") * 101) % 997)


@query("G9_random_locations", """SELECT event_id, round(u * 2 - 1, 6) + 0.0 AS x, round(1 - 2 * acos(2 * v - 1) / pi(), 6) + 0.0 AS y
FROM (SELECT event_id, ((event_id * 7919 + 13) % 10007) / 10007.0 AS u, ((event_id * 104729 + 7) % 10009) / 10009.0 AS v FROM events)""")
def g9(spark, d):
    k = F.col("event_id")
    x, y = P.located_draw(((k * 7919 + 13) % 10007) / 10007.0, ((k * 104729 + 7) % 10009) / 10009.0, "spherical")
    return table(spark, d, "events").select("event_id", r6(x).alias("x"), r6(y).alias("y"))


@query("G9_random_draws", f"""WITH {_sql_draws("(SELECT count(*) FROM customer)")}
SELECT draw_id AS id, round(u * 2 - 1, 6) + 0.0 AS x, round(1 - 2 * acos(2 * v - 1) / pi(), 6) + 0.0 AS y FROM dr""")
def g9_draws(spark, d):
    p = P.random_locations(spark, table(spark, d, "customer").count(), "spherical", draw=_draw)
    return p.select("id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("G10_jitter_points", EVENTS + " SELECT point_id, round(lon + (point_id % 97) / 97.0 * 0.01, 6) + 0.0 AS lon, round(lat + (point_id % 89) / 89.0 * 0.01, 6) + 0.0 AS lat FROM pts")
def g10(spark, d):
    k = F.col("point_id")
    p = P.jitter_points(event_points(spark, d), draws=(k % 97 / 97.0, k % 89 / 89.0))
    return p.select("point_id", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"))


@query("G11_rbf_anchors", PTS + " SELECT point_id, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat FROM pts ORDER BY (point_id * 31) % 1009, point_id LIMIT 32")
def g11(spark, d):
    p = P.rbf_anchors(points(spark, d), 32, order=(F.col("point_id") * 31) % 1009)
    return p.select("point_id", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"))


@query("G12_rff_params", None)
def g12(spark, d):
    """Features of points by seeded directions and shifts."""
    from terravec.functions.encodings import rff

    directions, shifts = P.rff_params(8, 2.0)
    p = points(spark, d).select("point_id", rff(F.col("lon"), F.col("lat"), directions, shifts).alias("v"))
    return p.select("point_id", F.posexplode("v").alias("i", "value")).withColumn("value", r6(F.col("value")))


def _lowest(spark, d, n: int):
    """Three draws of each of the n lowest customer keys."""
    import numpy as np

    keys = [r[0] for r in table(spark, d, "customer").select("c_custkey").orderBy("c_custkey").limit(n).collect()]
    return np.array([[((k * 7919 + 13) % 10007) / 10007.0, ((k * 104729 + 7) % 10009) / 10009.0, ((k * 31 + 5) % 1009) / 1009.0] for k in keys])


_LOWEST = "lk AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i, ((k * 7919 + 13) % 10007) / 10007.0 AS u, ((k * 104729 + 7) % 10009) / 10009.0 AS v, ((k * 31 + 5) % 1009) / 1009.0 AS s FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer ORDER BY c_custkey LIMIT 8))"


@query("G11_relative_anchors", f"""{PTS}, {_LOWEST}, an AS (SELECT 0 AS i, 0.0 AS x, 0.0 AS y UNION ALL SELECT i + 1, (2 * u - 1) * 50.0, (2 * v - 1) * 50.0 FROM lk)
SELECT point_id, CAST(i AS INTEGER) AS i, round(exp(-((lon - x) * (lon - x) + (lat - y) * (lat - y)) / (2.0 * 30.0 * 30.0)), 6) + 0.0 AS value FROM pts, an""")
def g11_relative(spark, d):
    """Kernels of points at anchors around the origin, drawn by the keys of eight customers."""
    from terravec.functions.encodings import rbf

    anchors = P.relative_anchors(9, 50.0, draws=_lowest(spark, d, 8)[:, :2])
    p = points(spark, d).select("point_id", F.posexplode(rbf(F.col("lon"), F.col("lat"), anchors, 30.0)).alias("i", "value"))
    return p.withColumn("value", r6(F.col("value")))


@query("G12_rff_rule_params", f"""{PTS}, {_LOWEST}, dr AS (SELECT i, sqrt(-4.0 * ln(1 - u)) * cos(2 * pi() * v) AS a, sqrt(-4.0 * ln(1 - u)) * sin(2 * pi() * v) AS b, 2 * pi() * s AS s FROM lk)
SELECT point_id, CAST(i AS INTEGER) AS i, round(cos(lon / 180.0 * a + lat / 90.0 * b + s) * sqrt(2.0 / 8), 6) + 0.0 AS value FROM pts, dr""")
def g12_rule(spark, d):
    """The same with draws that follow the keys of eight customers."""
    from terravec.functions.encodings import rff

    directions, shifts = P.rff_params(8, 2.0, draws=_lowest(spark, d, 8))
    p = points(spark, d).select("point_id", F.posexplode(rff(F.col("lon"), F.col("lat"), directions, shifts)).alias("i", "value"))
    return p.withColumn("value", r6(F.col("value")))


@query("L1_take_first", "SELECT event_id FROM events WHERE value > 50 ORDER BY event_id LIMIT 100")
def l1(spark, d):
    return P.take_first(table(spark, d, "events").filter("value > 50"), 100, "event_id").select("event_id")


@query("J2_assign_regions", EVENTS + f", {INSIDE} SELECT point_id, region FROM ins")
def j2(spark, d):
    return P.assign_regions(event_points(spark, d), P.polygons_from(spark, SHAPES)).select("point_id", "region")

"""Points in polygons through a grid index of the polygons' edges.

Each region is laid over a dyadic grid whose cells are as many as it has edges. A cell that no edge touches is wholly inside or
wholly outside, by the parity of one point in it, its anchor. A cell with edges holds them, and a point in it is inside if the way
to the anchor, which stays in the cell, crosses an odd number of them where the anchor is outside, or an even one where it is
inside. Cells of many edges are divided. Points meet cells by an equality join. Where rounding leaves a crossing open, which
includes points on an edge, the plain ray test over the region's edges at that height decides. All of it is DataFrame work.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravec.operators.shared import cut, lookup

#: Side of a cell of level 0, in degrees. A level more halves it; grids step by STEP levels, at most DEEPER below a region's first.
SIDE, STEP, DEEPER = 360.0, 2, 16
#: Edges of a cell, above which it is divided; where a cell's anchor is, as shares of its side.
CELL_EDGES = 24
ANCHOR_X, ANCHOR_Y = 0.4142135623730951, 0.6180339887498949
#: Cells, and edges in them, that are broadcast at most.
BROADCAST_CELLS, BROADCAST_EDGES = 50_000, 500_000
#: Share of a cell by which edges count as touching it, and of the coordinates by which a point is so near a line that it is left
#: open on which side it is (the plain test rounds by as much).
NEAR, OPEN = 1e-9, 1e-14
_OPEN = 1 << 20

_EDGE = ("x0", "y0", "x1", "y1")


def side_of(level: Column) -> Column:
    return F.lit(SIDE) * F.pow(F.lit(2.0), -level)


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """The side of the line from a to b that c is on: 1 or -1, or 0 where rounding leaves it open."""
    p, q = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    x, y = F.greatest(F.abs(ax), F.abs(bx), F.abs(cx)), F.greatest(F.abs(ay), F.abs(by), F.abs(cy))
    return F.when(F.abs(p - q) <= OPEN * (x * F.abs(by - ay) + y * F.abs(bx - ax)), 0).when(p > q, 1).otherwise(-1)


def _crossing(x: Column, y: Column, ax: Column, ay: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """1 if the way from (x, y) to (ax, ay) crosses the edge, 0 if not, _OPEN if that is open."""
    ways = _turn(x0, y0, x1, y1, x, y) * _turn(x0, y0, x1, y1, ax, ay)
    ends = _turn(x, y, ax, ay, x0, y0) * _turn(x, y, ax, ay, x1, y1)
    return F.when((ways > 0) | (ends > 0), 0).when((ways < 0) & (ends < 0), 1).otherwise(_OPEN)


def edges_of(polygons: DataFrame, whole: bool = False) -> DataFrame:
    """(region, pid, x0, y0, x1, y1) of polygons (region, rings): pid is one for each distinct polygon, or for all of them together."""
    rows = polygons.select(F.lit("all").alias("region") if whole else "region", F.lit(0).cast("long").alias("pid") if whole else F.xxhash64("region", "rings").alias("pid"), "rings")
    rows = rows if whole else rows.dropDuplicates(["pid"])
    ring = rows.select("region", "pid", F.explode("rings").alias("ring")).filter(F.size("ring") > 1)
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda k: F.struct(F.element_at("ring", k).alias("a"), F.element_at("ring", k + 1).alias("b")))).alias("e")
    flat = ring.select("region", "pid", pair).select("region", "pid", *(F.col(f"e.{end}.{axis}").cast("double").alias(name) for end, axis, name in (("a", "lon", "x0"), ("a", "lat", "y0"), ("b", "lon", "x1"), ("b", "lat", "y1"))))
    return flat.filter("x0 <> x1 OR y0 <> y1")


def _cells_touched(edges: DataFrame) -> DataFrame:
    """edges (with level) once for each cell that they touch: adds i, j."""
    side, near = side_of(F.col("level")), side_of(F.col("level")) * NEAR
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    strip = F.sequence(F.floor((low - near) / side), F.floor((high + near) / side))
    rows = edges.withColumn("j", F.explode(strip))
    at = lambda y: F.greatest(F.least("x0", "x1"), F.least(F.greatest("x0", "x1"), F.col("x0") + (F.col("x1") - F.col("x0")) * (y - F.col("y0")) / (F.col("y1") - F.col("y0"))))
    bottom, top = F.greatest(low, F.col("j") * side - near), F.least(high, (F.col("j") + 1) * side + near)
    a = F.when(F.col("y0") == F.col("y1"), F.col("x0")).otherwise(at(bottom))
    b = F.when(F.col("y0") == F.col("y1"), F.col("x1")).otherwise(at(top))
    return rows.withColumn("i", F.explode(F.sequence(F.floor((F.least(a, b) - near) / side), F.floor((F.greatest(a, b) + near) / side))))


def _anchor(level: Column, i: Column, j: Column) -> tuple[Column, Column]:
    return (i + ANCHOR_X) * side_of(level), (j + ANCHOR_Y) * side_of(level)


def _first_parities(regions: DataFrame, edges: DataFrame) -> DataFrame:
    """(pid, level, i, j, odd) of all cells of the regions' boxes: whether the anchor is inside, from the crossings of its row."""
    side, low, high = side_of(F.col("level")), F.least("y0", "y1"), F.greatest("y0", "y1")
    shift = F.lit(ANCHOR_Y)
    rows = edges.filter("y0 <> y1").withColumn("j", F.explode(F.sequence(F.ceil(low / side - shift) - 1, F.floor(high / side - shift) + 1)))
    y = (F.col("j") + ANCHOR_Y) * side
    crossed = rows.filter((F.col("y0") > y) != (F.col("y1") > y)).select("pid", "level", "j", ((F.col("x1") - F.col("x0")) * (y - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")).alias("x"), F.lit(None).cast("long").alias("i"))
    cells = regions.withColumn("j", F.explode(F.sequence(F.floor(F.col("low") / side), F.floor(F.col("high") / side)))).withColumn("i", F.explode(F.sequence(F.floor(F.col("left") / side), F.floor(F.col("right") / side))))
    anchors = cells.select("pid", "level", "j", _anchor(F.col("level"), F.col("i"), F.col("j"))[0].alias("x"), "i")
    w = Window.partitionBy("pid", "level", "j").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    counted = crossed.unionByName(anchors).withColumn("n", F.count_if(F.col("i").isNull()).over(w))
    return counted.filter("i IS NOT NULL").select("pid", "level", "i", "j", (F.col("n") % 2 == 1).alias("odd"))


@dataclass
class EdgeIndex:
    """cells: level, i, j, held (for each polygon with something there: region, pid, odd, edges; no edges: wholly inside, or with odd
    null, where a crossing to its anchor was left open, as the plain test says); edges: with each polygon's first level; levels: those that occur."""

    cells: DataFrame
    edges: DataFrame
    levels: list[int]
    small: bool


def edge_index(polygons: DataFrame, whole: bool = False) -> EdgeIndex:
    """The index of polygons (region, rings); ``whole``: of all of them as one."""
    flat = edges_of(polygons, whole)
    box = flat.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), *(f(g(a, b)).alias(name) for f, g, a, b, name in ((F.min, F.least, "x0", "x1", "left"), (F.max, F.greatest, "x0", "x1", "right"), (F.min, F.least, "y0", "y1", "low"), (F.max, F.greatest, "y0", "y1", "high"))))
    wide, tall = F.col("right") - F.col("left"), F.col("high") - F.col("low")
    side = F.greatest(F.sqrt(wide * tall / (2 * F.col("n"))), F.greatest(wide, tall) / (2 * F.col("n")), F.lit(1e-7))
    regions = cut(box.withColumn("level", (F.floor(F.log2(SIDE / side) / STEP) * STEP).cast("int")))
    edges = cut(flat.join(regions.select("pid", "level"), "pid"))
    todo, parities, done, levels = edges.withColumn("first", F.col("level")), _first_parities(regions, edges), [], set()
    keys = ["pid", "level", "i", "j"]
    struct = F.struct(*_EDGE)
    touched = cut(_cells_touched(todo))
    while True:
        counts = touched.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("first"))
        split = (F.col("n") > CELL_EDGES) & (F.col("level") < F.col("first") + DEEPER)
        state = cut(parities.join(counts, keys, "left").select(*keys, "odd", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(split, F.lit(False)).alias("split")))
        full = touched.join(state.filter("n > 0 AND NOT split").select(*keys), keys, "left_semi").groupBy(*keys).agg(F.collect_list(struct).alias("edges"))
        done.append(state.filter("n > 0 AND NOT split").select(*keys, "odd").join(full, keys))
        done.append(state.filter("n = 0 AND coalesce(odd, true)").select(*keys, "odd", F.array().cast(full.schema["edges"].dataType).alias("edges")))
        stats = state.agg(F.collect_set("level").alias("levels"), F.count_if("split").alias("split")).first()
        levels |= set(stats.levels)
        if not stats.split:
            break
        # children of the divided cells: their anchors' parities, by the way from the parent's anchor, and the edges they touch
        parents = state.filter("split").select(*keys, "odd")
        step = 1 << STEP
        down = F.explode(F.sequence(F.lit(0), F.lit(step * step - 1))).alias("c")
        child = {"i2": F.col("i") * step + F.col("c") % step, "j2": F.col("j") * step + F.floor(F.col("c") / step)}
        some = touched.join(parents, keys)
        a, b = _anchor(F.col("level"), F.col("i"), F.col("j")), _anchor(F.col("level") + STEP, F.col("i2"), F.col("j2"))
        crossed = some.select(*keys, "odd", *_EDGE, down).withColumns(child).withColumn("cross", _crossing(b[0], b[1], a[0], a[1], *(F.col(c) for c in _EDGE)))
        crossed = crossed.groupBy("pid", (F.col("level") + STEP).alias("level"), F.col("i2").alias("i"), F.col("j2").alias("j")).agg(F.sum("cross").alias("n"), F.first("odd").alias("odd"))
        parities = cut(crossed.select(*keys, F.when(F.col("n") < _OPEN, (F.col("n") % 2 == 1) != F.col("odd")).alias("odd")))
        finer = some.select("region", "pid", *_EDGE, "first", F.col("i").alias("pi"), F.col("j").alias("pj"), (F.col("level") + STEP).alias("level"))
        touched = cut(_cells_touched(finer).filter((F.floor(F.col("i") / step) == F.col("pi")) & (F.floor(F.col("j") / step) == F.col("pj"))).drop("pi", "pj"))
    names = edges.select("pid", "region").distinct()
    rows = reduce(DataFrame.unionByName, done).join(names, "pid")
    cells = cut(rows.groupBy("level", "i", "j").agg(F.collect_list(F.struct("region", "pid", "odd", "edges")).alias("held")))
    size = cells.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.aggregate("held", F.lit(0), lambda s, h: s + 1 + F.size(h["edges"]))), F.lit(0)).alias("e")).first()
    return EdgeIndex(cells, edges, sorted(levels), size.n <= BROADCAST_CELLS and size.e <= BROADCAST_EDGES)


def _by_rays(places: DataFrame, edges: DataFrame) -> DataFrame:
    """(x, y, pid) of the places that are inside their polygon by the plain test: an odd number of edges to the right, none through."""
    side, near = side_of(F.col("level")), side_of(F.col("level")) * NEAR
    rows = edges.withColumn("strip", F.explode(F.sequence(F.floor((F.least("y0", "y1") - near) / side), F.floor((F.greatest("y0", "y1") + near) / side))))
    asks = places.join(edges.select("pid", "level").distinct(), "pid").withColumn("strip", F.floor(F.col("y") / side)).drop("level")
    x, y, x0, y0, x1, y1 = (F.col(c) for c in ("x", "y", *_EDGE))
    right = ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / F.when(y0 != y1, y1 - y0) + x0)
    on = ((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) == 0) & (x >= F.least(x0, x1)) & (x <= F.greatest(x0, x1)) & (y >= F.least(y0, y1)) & (y <= F.greatest(y0, y1))
    met = asks.join(rows, ["pid", "strip"]).groupBy("x", "y", "pid").agg(F.count_if(right).alias("n"), F.max(on).alias("on"))
    return met.filter((F.col("n") % 2 == 1) & ~F.col("on")).select("x", "y", "pid")


def regions_of(points: DataFrame, index: EdgeIndex, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points with region, one row for each polygon that strictly holds the point. Points without both coordinates are in none."""
    own = points.drop("region")
    x, y = F.col(f"_p.{lon}").cast("double"), F.col(f"_p.{lat}").cast("double")
    asks = own.select(F.struct(*own.columns).alias("_p")).filter(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    at = F.array(*(F.struct(F.lit(n).alias("level"), F.floor(x / side_of(F.lit(n))).alias("i"), F.floor(y / side_of(F.lit(n))).alias("j")) for n in index.levels))
    keyed = asks.select("_p", F.inline(at)) if index.levels else asks.select("_p", *(F.lit(None).cast(k).alias(c) for c, k in (("level", "int"), ("i", "long"), ("j", "long"))))
    keys = ["level", "i", "j"]
    met = keyed.join(F.broadcast(index.cells), keys) if index.small else lookup(keyed, index.cells, keys)
    ax, ay = _anchor(F.col("level"), F.col("i"), F.col("j"))
    met = met.select("_p", x.alias("x"), y.alias("y"), ax.alias("ax"), ay.alias("ay"), F.inline("held"))
    n = F.aggregate("edges", F.lit(0), lambda s, e: s + _crossing(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), *(e[c] for c in _EDGE)))
    odd = F.when(F.size("edges") == 0, F.col("odd")).when(n < _OPEN, (n % 2 == 1) != F.col("odd"))
    told = met.select("_p", "x", "y", "region", "pid", odd.alias("inside"))
    sure = told.filter("inside")
    open_ = told.filter("inside IS NULL")
    held = _by_rays(open_.select("x", "y", "pid").distinct(), index.edges)
    return sure.select("_p.*", "region").unionByName(open_.join(held, ["x", "y", "pid"], "left_semi").select("_p.*", "region"))

"""Hard-negative mining through a multiway tree of split points with distance ranges.

A row goes to the nearest of a node's split points, down to a leaf. For each split point the node holds the least and the greatest
distance to the rows under each of its siblings, over all rows. A window of inner products is, for the lengths of the rows under a
child, an annulus of distances around the anchor; by the triangle inequality the child is left out if that annulus, seen from any
split point, misses the range stored for it. What isn't left out is compared exactly, leaf by leaf. The split points are drawn from
a bounded sample, all rows are in the tree, and the results are those of comparing all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravec.llm.arrow import groups
from terravec.llm.common import cut, partitions, table
from terravec.llm.nearest import as_binary, bytes_of, distinct_by, finite, rows_of

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: A negative's score, in percent of the positive's.
FROM, TO = 50, 95
#: Rows that the split points are drawn from, at most, and their bytes; split points of a node; rows and sampled rows a leaf aims at.
SAMPLE_ROWS, SAMPLE_BYTES, FAN, LEAF_ROWS, LEAF_SAMPLE = 4096, 16 << 20, 8, 1024, 8
#: Rows and anchors that a task compares, at most, and anchors at once. A larger leaf is several tiles.
TILE_ROWS, TILE_BYTES, ANCHORS, AT_ONCE = 8192, 16 << 20, 16_384, 256
#: Anchor ids of one row, as ranges of ids.
IDS = 4096
SEED = 42


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integers: by doubles where these hold them."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows and rows."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * products(a, b)


@dataclass
class Node:
    """points (m, dims); child: a node's number, or -1 minus that of a leaf. Of point i and child j, over the child's rows: squared
    distances near[i, j] to far[i, j]; squared lengths short[j] to long[j]; labels low[j] to high[j]."""

    points: np.ndarray
    child: list[int]
    near: np.ndarray = field(init=False)
    far: np.ndarray = field(init=False)
    short: np.ndarray = field(init=False)
    long: np.ndarray = field(init=False)
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)

    def __post_init__(self):
        m, most = len(self.points), np.iinfo(np.int64).max
        self.near, self.far = np.full((m, m), most), np.full((m, m), -1)
        self.short, self.long = np.full(m, most), np.full(m, -1)
        self.low, self.high = np.full(m, most), np.full(m, -most)

    #: The names of the ranges' lower and upper ends.
    LOWER, UPPER = ("near", "short", "low"), ("far", "long", "high")

    def widen(self, other: dict[str, np.ndarray]) -> None:
        for name, x in other.items():
            own = getattr(self, name)
            setattr(self, name, (np.minimum if name in self.LOWER else np.maximum)(own, x.reshape(own.shape)))


class Tree:
    def __init__(self, sample: np.ndarray, leaf: int, fan: int = FAN, seed: int = SEED):
        """sample: the rows that split points are drawn from; a node with up to ``leaf`` of them is a leaf."""
        self.nodes: list[Node] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)

        def grow(x: np.ndarray) -> int:
            points = self._apart(x, fan, rng) if len(x) > leaf else x[:0]
            if len(points) < 2:
                self.leaves += 1
                return -self.leaves
            self.nodes.append(node := Node(points, []))
            at, to = len(self.nodes) - 1, squares(x, points).argmin(axis=1)
            node.child = [grow(x[to == j]) for j in range(len(points))]
            return at

        self.root = grow(sample)

    @staticmethod
    def _apart(x: np.ndarray, fan: int, rng: np.random.Generator) -> np.ndarray:
        """Distinct points, each the farthest from those before it, of three times as many drawn ones."""
        some = x[rng.permutation(len(x))[: 3 * fan]]
        chosen, d = [0], squares(some, some[:1])[:, 0]
        while len(chosen) < fan and d.max() > 0:
            chosen.append(int(d.argmax()))
            d = np.minimum(d, squares(some, some[chosen[-1:]])[:, 0])
        return some[chosen]

    def route(self, x: np.ndarray, label: np.ndarray | None = None, ranges: dict[int, Node] | None = None) -> np.ndarray:
        """The leaf of each row; ranges: nodes that are widened by these rows."""
        out, size = np.zeros(len(x), np.int64), (x * x).sum(axis=1)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            n, rows = todo.pop()
            if n < 0:
                out[rows] = -1 - n
                continue
            node = self.nodes[n]
            d = squares(x[rows], node.points)
            to = d.argmin(axis=1)
            seen = ranges.setdefault(n, Node(node.points, node.child)) if ranges is not None and label is not None else None
            for j in np.unique(to):
                some = to == j
                if seen is not None:
                    part, of = d[some], rows[some]
                    seen.near[:, j], seen.far[:, j] = np.minimum(seen.near[:, j], part.min(axis=0)), np.maximum(seen.far[:, j], part.max(axis=0))
                    seen.short[j], seen.long[j] = min(seen.short[j], size[of].min()), max(seen.long[j], size[of].max())
                    seen.low[j], seen.high[j] = min(seen.low[j], label[of].min()), max(seen.high[j], label[of].max())
                todo.append((node.child[j], rows[some]))
        return out

    def visits(self, a: np.ndarray, label: np.ndarray, least: np.ndarray, most: np.ndarray, same: bool) -> np.ndarray:
        """(anchors, leaves): whether a leaf may hold a row of the same (or of another) label whose inner product with the anchor is
        from least to most (floats, infinite ones too)."""
        out = np.zeros((len(a), self.leaves), bool)
        size = (a * a).sum(axis=1).astype(np.float64)
        todo = [(self.root, np.arange(len(a)))]
        while todo:
            n, rows = todo.pop()
            if n < 0:
                out[rows, -1 - n] = True
                continue
            node = self.nodes[n]
            d = np.sqrt(squares(a[rows], node.points).astype(np.float64))
            for j, child in enumerate(node.child):
                if node.long[j] < 0:
                    continue  # no row is under it
                outer = size[rows] + float(node.long[j]) - 2 * least[rows]
                radius = np.sqrt(np.maximum(outer, 0))[:, None]
                inner = np.sqrt(np.maximum(size[rows] + float(node.short[j]) - 2 * most[rows], 0))[:, None]
                near, far = np.sqrt(node.near[:, j].astype(np.float64)), np.sqrt(node.far[:, j].astype(np.float64))
                slack = 1e-6 + 1e-9 * (d + far)
                met = (d + radius >= near - slack) & (d - radius <= far + slack) & (inner - d <= far + slack)
                ok = met.all(axis=1) & (outer >= 0)
                ok &= (label[rows] >= node.low[j]) & (label[rows] <= node.high[j]) if same else (node.low[j] < node.high[j]) | (label[rows] != node.low[j])
                if ok.any():
                    todo.append((child, rows[ok]))
        return out


def best(scores: np.ndarray, fits: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k times (rows, column): the rows that have another fitting column, and the one of the largest score, ties to the first."""
    none = np.iinfo(np.int64).min
    left, rows = np.where(fits, scores, none), np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        at = left.argmax(axis=1)
        found = np.flatnonzero(left[rows, at] != none)
        if not len(found):
            return
        yield found, at[found]
        left[found, at[found]] = none


def largest(dims: int) -> int:
    """The magnitude below which 100 times an inner product of so many components fits a long."""
    return int((2.0**56 / max(dims, 1)) ** 0.5)


@dataclass
class Index:
    """rows: node, twin, label, ids, raw, slot; the tree; the sample's vectors and labels; leaves' first tiles and numbers of tiles."""

    rows: DataFrame
    tree: Tree
    sample: np.ndarray
    labels: np.ndarray
    base: np.ndarray
    tiles: np.ndarray
    dims: int


_NODE = [T.StructField("node", T.LongType()), T.StructField("twin", T.LongType())]
_INTS = T.ArrayType(T.LongType())


def index(rows: DataFrame, dims: int, leaf_rows: int = LEAF_ROWS, tile_rows: int = TILE_ROWS, sample_rows: int = SAMPLE_ROWS) -> Index | None:
    """The tree over rows (node, twin, label, ids, raw, first): all of them routed, with ranges over all; None without rows."""
    spark = rows.sparkSession
    count = rows.count()
    if not count:
        return None
    most = max(1, min(sample_rows, SAMPLE_BYTES // (8 * dims)))
    share = min(1.0, 1.2 * most / count)
    drawn = rows.filter(F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.select("label", "raw", F.xxhash64("node", F.lit(SEED)).alias("order"), "twin").orderBy("order", "twin").limit(most).collect()
    sample = np.stack([np.frombuffer(r.raw, np.int32) for r in drawn]).astype(np.int64) if drawn else np.zeros((0, dims), np.int64)
    labels = np.array([r.label for r in drawn], np.int64)
    tree = Tree(sample, max(LEAF_SAMPLE, -(-len(sample) * leaf_rows // count)))
    shared = spark.sparkContext.broadcast(tree)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("leaf", pa.array(shared.value.route(bytes_of(b.column("raw"), np.int32).astype(np.int64)).astype(np.int32)))

    placed = cut(rows.mapInArrow(routed, T.StructType([*rows.schema.fields, T.StructField("leaf", T.IntegerType())])))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, Node] = {}
        for b in batches:
            if b.num_rows:
                shared.value.route(bytes_of(b.column("raw"), np.int32).astype(np.int64), b.column("label").to_numpy(), ranges)
        out = [(n, name, getattr(x, name).reshape(-1).tolist()) for n, x in ranges.items() for name in (*Node.LOWER, *Node.UPPER)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["n", "name", "ends"])

    ends = placed.select("raw", "label").mapInArrow(measured, "n int, name string, ends array<long>").select("n", "name", F.posexplode("ends").alias("k", "end"))
    ends = ends.groupBy("n", "name", "k").agg(F.when(F.col("name").isin(*Node.LOWER), F.min("end")).otherwise(F.max("end")).alias("end"))
    for r in ends.groupBy("n", "name").agg(F.sort_array(F.collect_list(F.struct("k", "end"))).alias("ends")).collect():  # as many as the tree has nodes
        tree.nodes[r.n].widen({r.name: np.array([x.end for x in r.ends], np.int64)})
    sizes = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # as many as the tree has leaves
        sizes[r.leaf] = r.n
    tiles = np.maximum(1, -(-sizes // max(1, min(tile_rows, TILE_BYTES // (8 * dims)))))
    base = np.cumsum(tiles) - tiles
    parts = spark.createDataFrame([(i, int(b), int(n)) for i, (b, n) in enumerate(zip(base, tiles, strict=True))], "leaf int, base long, tiles long")
    slot = F.col("base") + F.pmod(F.xxhash64("node", F.lit(3)), F.col("tiles"))
    return Index(placed.join(F.broadcast(parts), "leaf").withColumn("slot", slot).drop("leaf", "base", "tiles"), tree, sample, labels, base, tiles, dims)


def search(anchors: DataFrame, anchors_count: int, found: Index, k: int, same: bool, tasks: int) -> DataFrame:
    """(node, twin, window, score, ids): of each window of each anchor, the k rows of the largest inner products in it in every tile
    visited, so that the k best of all are among them. anchors: node, twin, label, raw, least, most (arrays, a window each)."""
    spark, dims = anchors.sparkSession, found.dims
    shared = spark.sparkContext.broadcast((found.tree, found.sample, found.labels, found.base, found.tiles))
    blocks = max(1, -(-anchors_count // ANCHORS))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sample, labels, base, tiles = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(s, AT_ONCE)
                a, label = bytes_of(b.column("raw"), np.int32).astype(np.int64), b.column("label").to_numpy()
                n = np.array([len(x) for x in b.column("least")])
                at = np.repeat(np.arange(len(a)), n)
                least, most = (b.column(c).flatten().to_numpy() for c in ("least", "most"))
                # the k-th best of the sample's rows raises the lower end
                scores = products(a, sample)
                fits = (label[:, None] == labels[None]) == same
                raised = least.astype(np.float64)
                for w in range(int(n.max(initial=0))):
                    own = np.flatnonzero(np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) == w)
                    i = at[own]
                    for step, (rows, column) in enumerate(best(scores[i], fits[i] & (scores[i] >= least[own, None]) & (scores[i] <= most[own, None]), k)):
                        if step == k - 1:
                            raised[own[rows]] = scores[i[rows], column]
                reach = tree.visits(a[at], label[at], raised, most.astype(np.float64), same)
                slots = [np.concatenate([[*range(base[x], base[x] + tiles[x])] for x in leaves]) if len(leaves) else np.zeros(0, np.int64) for leaves in (np.flatnonzero(reach[at == i].any(axis=0)) for i in range(len(a)))]
                yield b.append_column("slots", pa.array([x.astype(np.int64).tolist() for x in slots], pa.list_(pa.int64())))

    columns = ["node", "twin", "label", "raw"]
    visiting = anchors.mapInArrow(sent, T.StructType([*anchors.schema.fields, T.StructField("slots", _INTS)]))
    block = lambda c: F.pmod(F.xxhash64("node", F.lit(5)), F.lit(blocks)).cast("int").alias(c)
    nothing = F.lit(None).cast("array<long>")
    left = visiting.select(*columns, "least", "most", nothing.alias("ids"), F.lit(None).cast("long").alias("first"), F.explode("slots").alias("slot"), block("block"))
    right = found.rows.select(*columns, nothing.alias("least"), nothing.alias("most"), "ids", "first", "slot", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = left.unionByName(right).repartition(tasks, "slot", "block").sortWithinPartitions("slot", "block", "first")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["slot", "block"]):
            row = g.column("ids").is_valid()
            asks, rows = g.filter(pa.compute.invert(row)), g.filter(row)
            if not asks.num_rows or not rows.num_rows:
                continue
            x, label = bytes_of(rows.column("raw"), np.int32).astype(np.int64), rows.column("label").to_numpy()
            for s in range(0, asks.num_rows, AT_ONCE):
                b = asks.slice(s, AT_ONCE)
                scores = products(bytes_of(b.column("raw"), np.int32).astype(np.int64), x)
                fits = (b.column("label").to_numpy()[:, None] == label[None]) == same
                least, most = b.column("least").to_pylist(), b.column("most").to_pylist()
                for w in range(max(map(len, least))):
                    own = np.array([i for i, v in enumerate(least) if len(v) > w])
                    low, high = np.array([least[i][w] for i in own]), np.array([most[i][w] for i in own])
                    for i, j in best(scores[own], fits[own] & (scores[own] >= low[:, None]) & (scores[own] <= high[:, None]), k):
                        of = pa.array(own[i])
                        yield pa.RecordBatch.from_arrays([b.column("node").take(of), b.column("twin").take(of), pa.array(np.full(len(i), w, np.int32)), pa.array(scores[own[i], j]), rows.column("ids").take(pa.array(j))], names=["node", "twin", "window", "score", "ids"])

    return met.mapInArrow(compared, T.StructType([*_NODE, T.StructField("window", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("ids", _INTS)]))


def first(found: DataFrame, k: int) -> DataFrame:
    """(node, twin, window, best): the k first (score, id) of each window, highest scores first, ties by id."""
    each = found.select("node", "twin", "window", "score", F.explode("ids").alias("id"))
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy("node", "twin", "window").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k)
    lists = ranked.groupBy("node", "twin", "window").agg(F.sort_array(F.collect_list(F.struct("r", "score", "id"))).alias("best"))
    return lists.withColumn("best", F.transform("best", lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))))


def mined(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, tasks: int | None = None, **sizes: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): of each row whose id is divisible by ``every``, its
    first ``positives`` other rows of the same label, and of each of these the first ``negatives`` rows of other labels whose inner
    product with the anchor is from 50 to 95 percent of the positive's. Higher scores come first, ties by id.

    Rows with a null id, label or vector or a null or non-finite entry take no part, nor do empty vectors, those of another length
    than the smallest id's, or with a component so large that scores wouldn't fit a long (``largest``: 131,072 for 64 dimensions).
    Zero vectors take part. A positive whose score is negative has no negatives. Rows that share id, label and vector count once;
    an id with several vectors or labels is an anchor with each, and none of its rows is its positive or negative (so that it may
    find fewer). Other columns aren't looked at. A table without rows or anchors gives no row.
    """
    spark, tasks = vectors.sparkSession, tasks or partitions(vectors.sparkSession)
    label = F.col(label) if isinstance(label, str) else label
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.floor(v * F.lit(float(scale))))
    small = F.forall(F.col(vector_col), lambda v: F.abs(v.cast("double") * scale) < float(1 << 40))
    own = vectors.withColumn("_label", label.cast("long")).filter(F.col(id_col).isNotNull() & F.col("_label").isNotNull() & finite(F.col(vector_col)) & (F.size(vector_col) > 0) & small)
    own = own.select(F.col(id_col).cast("long").alias("id"), F.col("_label").alias("label"), whole.alias("vector"))
    head = own.orderBy("id", "vector").limit(1).collect()
    dims = len(head[0].vector) if head else 1
    own = own.filter((F.size("vector") == dims) & F.forall("vector", lambda v: F.abs(v) < largest(dims)))
    named = [F.xxhash64("label", "vector").alias("node"), F.xxhash64(F.lit(1), "label", "vector").alias("twin")]
    asking = own.filter(F.col("id") % every == 0).groupBy("label", "vector", F.floor(F.col("id") / (every * IDS)).alias("range")).agg(F.collect_set("id").alias("own"))
    asked = asking.groupBy("label", "vector").agg(F.lit(True).alias("asks"))
    reps = distinct_by(own, ["label", "vector"], max(positives + 1, negatives)).join(asked, ["label", "vector"], "left")
    reps = reps.select(*named, "label", "ids", F.col("ids")[0].alias("first"), F.coalesce("asks", F.lit(False)).alias("asks"), F.col("vector").alias("raw"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.set_column(b.schema.get_field_index("raw"), "raw", as_binary(rows_of(b.column("raw"), np.int64).astype(np.int32)))

    reps = cut(reps.mapInArrow(packed, T.StructType([*reps.schema.fields[:-1], T.StructField("raw", T.BinaryType())])))
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n, found = reps.filter("asks").count(), index(reps, dims, **sizes)
    if found is None or not n:
        return spark.createDataFrame([], out)
    anchors = reps.filter("asks").select("node", "twin", "label", "raw")
    far = (1 << 62) - 1
    any_score = anchors.withColumns({"least": F.array(F.lit(-far)), "most": F.array(F.lit(far))})
    same = cut(first(search(any_score, n, found, positives + 1, True, tasks), positives + 1).drop("window"))
    # windows of the distinct scores that a positive may have, ends rounded inwards
    scores = F.array_sort(F.array_distinct(F.transform(F.filter("best", lambda x: x["score"] >= 0), lambda x: x["score"])))
    windows = same.select("node", "twin", scores.alias("scores")).filter(F.size("scores") > 0)
    ends = {"least": F.expr(f"transform(scores, s -> (s * {FROM} + 99) div 100)"), "most": F.expr(f"transform(scores, s -> (s * {TO}) div 100)")}
    windowed = anchors.join(windows, ["node", "twin"]).withColumns(ends).drop("scores")
    other = first(search(windowed, n, found, negatives, False, tasks), negatives)
    each = windows.select("node", "twin", F.posexplode("scores").alias("window", "positive_score"))
    hard = other.join(each, ["node", "twin", "window"]).groupBy("node", "twin").agg(F.collect_list(F.struct("positive_score", "best")).alias("hard"))
    lists = same.join(hard, ["node", "twin"])
    met = asking.select(*named, "own").join(lists, ["node", "twin"]).select(F.explode("own").alias("anchor_id"), "best", "hard")
    of = met.select("anchor_id", "hard", F.explode(F.slice(F.filter("best", lambda x: x["id"] != F.col("anchor_id")), 1, positives)).alias("p"))
    of = of.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.get(F.filter("hard", lambda x: x["positive_score"] == F.col("p.score")), F.lit(0))["best"].alias("best"))
    of = of.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.filter("best", lambda x: x["id"] != F.col("anchor_id"))).alias("r", "x"))
    return of.select("anchor_id", "positive_id", (F.col("r") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return mined(rows, label=F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {FROM} * positive_score <= 100 * s.score AND 100 * s.score <= {TO} * positive_score
QUALIFY rank <= {NEGATIVES}
"""

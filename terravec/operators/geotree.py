"""Distance scores of features by a tree of cells on the sphere, with far-field sums and a bound on the error.

The score of a feature is the mean of exp(-km / scale) over all pairs of rows, weighted by the product of their activations. If no
pair's kernel is off by more than tau, neither is the score. Rows of one place are summed to a site. Sites lie in an octree over
the unit ball; cells with more than a few sites hold the sums of activation, activation times place and activation times squared
place. A task has a block of sites. From all others it gets what it needs and no more:

- nothing from a cell beyond scale * ln(1 / tau), whose pairs add less than tau each;
- the sums of a cell whose expansion around its centre (to second order, or none for tiny ones) is within tau for all of the block;
- the sites of a leaf otherwise, which are compared exactly.

So the pairs of a block with everything are a few hundred cells and the sites nearby, however many rows there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravec.operators import sae
from terravec.operators.shared import cut

#: Levels of the octree (a cell of the last is 12 m wide); sites of a leaf, and of a block, at most; blocks at most.
LEVELS, LEAF_SITES, BLOCK_SITES, BLOCKS = 20, 16, 1024, 1 << 17
#: Features that a task has dense at once, and numbers of a matrix that it holds.
FEATURE_TILE, NUMBERS = 256, 1 << 22
#: Pairs of axes of a cell's second-order sums.
AXES = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
#: Numbers of a feature that a cell's sums have; share of all ordered pairs that the tree may leave. A pair of the tree costs more than one
#: of plain blocks, as its sites travel to many small blocks.
MOMENTS, SHARE = 10, 1 / 16


@dataclass
class Kernel:
    """exp(-kappa * angle) of two points at a chord's length, kappa = radius / scale."""

    kappa: float
    tau: float

    def value(self, chord: np.ndarray) -> np.ndarray:
        return np.exp(-2 * self.kappa * np.arcsin(np.minimum(chord / 2, 1)))

    def slopes(self, chord: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The value and its first two derivatives by the chord."""
        g, w = self.value(chord), 1 / np.sqrt(np.maximum(1 - chord * chord / 4, 1e-12))
        return g, -self.kappa * w * g, (self.kappa**2 * w * w - self.kappa * chord * w**3 / 4) * g

    def order(self, least: np.ndarray, most: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For points of a cell (of a radius around its centre) at chords from least to most: -1 if they add less than tau each, 0
        or 2 for the order of an expansion that is within tau, 9 if there is none.

        Along a line the third derivative of a radial function g is at most |g'''| + 1.155 (|g''| + |g'| / r) / r, and a second-order
        expansion is off by at most a sixth of it times the cube of the radius.
        """
        k, far = self.kappa, np.minimum(most, 1.999)
        g, w = self.value(least), 1 / np.sqrt(1 - far * far / 4)
        one = k * w * g
        two = (k * k * w * w + k * far * w**3 / 4) * g
        three = (k**3 * w**3 + 0.75 * k * k * far * w**4 + k * (w**3 / 4 + 3 * far * far * w**5 / 16)) * g
        with np.errstate(divide="ignore", invalid="ignore"):
            second = (three + 1.155 * (two + one / least) / least) * radius**3 / 6
        fits = most < 1.999
        out = np.where(fits & (least > 0) & (second <= self.tau), 2, 9)
        out = np.where(fits & (one * radius <= self.tau), 0, out)
        return np.where(g <= self.tau, -1, out)


def corners(level: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower corner (n, 3), side) of cells."""
    at = np.zeros((len(code), 3))
    for axis in range(3):
        for bit in range(LEVELS):
            at[:, axis] += ((code >> (3 * bit + axis)) & 1) * float(1 << bit)
    side = 2.0 ** (1 - level)
    return at * side[:, None] - 1, side


def codes(x: np.ndarray, level: int) -> np.ndarray:
    """Which cell of a level each point is in: the bits of the three places, one after another."""
    at = np.clip(((x + 1) * 2.0 ** (level - 1)).astype(np.int64), 0, (1 << level) - 1)
    out = np.zeros(len(x), np.int64)
    for bit in range(level):
        for axis in range(3):
            out |= ((at[:, axis] >> bit) & 1) << (3 * bit + axis)
    return out


def chords(low: np.ndarray, side: np.ndarray, other: np.ndarray, other_side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distances of points of two cubes."""
    gap = np.maximum(np.maximum(low - other - other_side[:, None], other - low - side[:, None]), 0)
    span = np.maximum(other + other_side[:, None] - low, low + side[:, None] - other)
    return np.sqrt((gap * gap).sum(axis=1)), np.sqrt((span * span).sum(axis=1))


class Blocks:
    """The blocks and the cells above them, as broadcast: level, code, and the rows of each one's children."""

    def __init__(self, blocks: list[tuple[int, int]]):
        above = {(n, c >> 3 * (level - n)) for level, c in blocks for n in range(level)} - set(blocks)
        self.cells = sorted(above | set(blocks) | {(0, 0)})
        place = {cell: i for i, cell in enumerate(self.cells)}
        self.children: list[list[int]] = [[] for _ in self.cells]
        for (level, code), i in place.items():
            if level:
                self.children[place[level - 1, code >> 3]].append(i)
        self.low, self.side = corners(*(np.array(x) for x in zip(*self.cells, strict=True)))
        self.ends = np.isin(np.arange(len(self.cells)), [place[b] for b in blocks])

    def needs(self, level: np.ndarray, code: np.ndarray, leaf: np.ndarray, kernel: Kernel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, block, order) of the cells that blocks need: sums of the order, or the sites of a leaf (9)."""
        low, side = corners(level, code)
        up_low, up_side = corners(np.maximum(level - 1, 0), code >> 3)
        reach, out = np.sqrt(0.75), []
        i, b = np.arange(len(code)), np.full(len(code), self.cells.index((0, 0)))
        while len(i):
            parent = kernel.order(*chords(up_low[i], up_side[i], self.low[b], self.side[b]), reach * up_side[i])
            own = kernel.order(*chords(low[i], side[i], self.low[b], self.side[b]), reach * side[i])
            go = ((parent == 9) | (level[i] == 0)) & (own != -1)
            i, b, own = i[go], b[go], own[go]
            end = self.ends[b]
            kind = np.where(leaf[i], 9, own)
            said = end & (leaf[i] | (own != 9))
            out.append((i[said], b[said], kind[said]))
            n = np.array([len(self.children[x]) for x in b[~end]], dtype=np.int64)
            i, b = np.repeat(i[~end], n), np.concatenate([np.zeros(0, np.int64), *(self.children[x] for x in b[~end])]).astype(np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _dense(at: np.ndarray, neuron: np.ndarray, value: np.ndarray, rows: int, start: int, width: int) -> np.ndarray:
    a, b = np.searchsorted(neuron, [start, start + width])
    out = np.zeros((rows, width))
    np.add.at(out, (at[a:b], neuron[a:b] - start), value[a:b])
    return out


def _sparse(t: pa.Table, column: str, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neuron, values (entries, per)) by neuron."""
    lists = t.column("neurons").combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    neuron, value = lists.flatten().to_numpy(), t.column(column).combine_chunks().flatten().to_numpy().reshape(-1, per)
    order = np.argsort(neuron, kind="stable")
    return np.repeat(np.arange(len(n)), n)[order], neuron[order], value[order]


def _energy(t: pa.Table, kernel: Kernel, neurons: int) -> np.ndarray:
    """Per feature the sum of activation times activation times kernel, over the sites of a block and all that it was sent."""
    kind = t.column("kind").to_numpy()
    place = np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1)
    parts = {k: t.filter(pa.array(kind == k)) for k in (-1, 0, 2, 9)}
    entries = {k: _sparse(p, "values", 1 if k in (-1, 9) else 10) for k, p in parts.items()}
    asks, total = place[kind == -1], np.zeros(neurons)
    step = max(1, NUMBERS // max(1, len(kind) * 10))
    for s in range(0, len(asks), step):
        x = asks[s : s + step]
        columns = {}
        for k in (0, 2, 9):
            d = x[:, None] - place[kind == k][None]
            chord = np.sqrt((d * d).sum(axis=2))
            if k != 2:
                columns[k] = kernel.value(chord)[:, None]
                continue
            g, g1, g2 = kernel.slopes(chord)
            r = np.maximum(chord, 1e-300)
            u = d / r[:, :, None]
            across = g1 / r
            terms = [g, *(-g1 * u[:, :, a] for a in range(3))]
            terms += [(1 if a != b else 0.5) * ((g2 - across) * u[:, :, a] * u[:, :, b] + (across if a == b else 0)) for a, b in AXES]
            columns[2] = np.stack(terms, axis=1)
        for n in range(0, neurons, FEATURE_TILE):
            width, met = min(FEATURE_TILE, neurons - n), np.zeros((len(x), min(FEATURE_TILE, neurons - n)))
            for k, c in columns.items():
                at, neuron, value = entries[k]
                for m in range(c.shape[1]):
                    met += c[:, m] @ _dense(at, neuron, value[:, m], c.shape[2], n, width)
            at, neuron, value = entries[-1]
            total[n : n + width] += (_dense(at, neuron, value[:, 0], len(asks), n, width)[s : s + step] * met).sum(axis=0)
    return total


def sums_over_pairs(long: DataFrame, located: DataFrame, neurons: int, tau: float, key: str = "point_id", scale_km: float = 500.0, radius: float = 6371.0, leaf_sites: int = LEAF_SITES, block_sites: int = BLOCK_SITES, most_pairs: float = float("inf")) -> DataFrame | None:
    """(neuron, top): twice the sum over pairs of rows of their activations' product times the kernel, each kernel within tau. None if
    the tree leaves more than most_pairs pairs of a site with a site or a sum."""
    spark, kernel = long.sparkSession, Kernel(radius / scale_km, tau)
    at = located.select(key, F.radians("lon").alias("lon"), F.radians("lat").alias("lat")).filter("lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)")
    at = at.select(key, (F.cos("lat") * F.cos("lon")).alias("x"), (F.cos("lat") * F.sin("lon")).alias("y"), F.sin("lat").alias("z"))
    acts = long.filter("act > 0").join(at, key)
    per_site = acts.groupBy("x", "y", "z", "neuron").agg(F.sum("act").alias("a"))
    sites = per_site.groupBy("x", "y", "z").agg(F.collect_list("neuron").alias("neurons"), F.collect_list("a").alias("values"))

    def placed(batches):
        for b in batches:
            x = np.stack([b.column(c).to_numpy() for c in "xyz"], axis=1)
            yield b.append_column("code", pa.array(codes(x, LEVELS)))

    sites = cut(sites.mapInArrow(placed, "x double, y double, z double, neurons array<int>, values array<double>, code long"))
    cell = lambda level: F.shiftright(F.col("code"), 3 * (LEVELS - level))
    levels = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), cell(n).alias("cell")) for n in range(LEVELS + 1)))).alias("at")
    counts = sites.select(levels).groupBy("at.level", "at.cell").agg(F.count(F.lit(1)).alias("n"))
    large = cut(counts.filter(F.col("n") > leaf_sites))  # the cells that have children; all others are leaves, or below them
    count = sites.count()
    most = max(block_sites, -(-count // BLOCKS))
    # a site's leaf and block: the first of its cells that isn't too large, or the last of all
    first = lambda n: F.least(F.coalesce(F.max(F.when(F.col("n") > n, F.col("level"))), F.lit(-1)) + 1, F.lit(LEVELS))
    ways = sites.select("code", levels).select("code", "at.level", "at.cell").distinct().join(large, ["level", "cell"], "left")
    depth = cut(ways.groupBy("code").agg(first(leaf_sites).alias("leaf"), first(most).alias("block")))
    known = cut(sites.join(depth, "code"))
    of = lambda c: F.expr(f"shiftright(code, 3 * ({LEVELS} - {c}))")
    blocks = Blocks([(r.level, r.cell) for r in known.select(F.col("block").alias("level"), of("block").alias("cell")).distinct().collect()])  # BLOCKS of their kind at most, and those above
    shared = spark.sparkContext.broadcast(blocks)

    def sent(batches):
        for b in batches:
            level, code, leaf = (b.column(c).to_numpy(zero_copy_only=False) for c in ("level", "cell", "leaf"))
            for s in range(0, b.num_rows, 512):
                i, to, kind = shared.value.needs(level[s : s + 512], code[s : s + 512], leaf[s : s + 512], kernel)
                yield pa.RecordBatch.from_arrays([pa.array(level[s + i]), pa.array(code[s + i]), pa.array(to.astype(np.int32)), pa.array(kind.astype(np.int32))], names=["level", "cell", "to", "kind"])

    leaves = known.select(F.col("leaf").alias("level"), of("leaf").alias("cell")).distinct().withColumn("leaf", F.lit(True))
    inner = large.filter(F.col("level") < LEVELS).select("level", "cell", F.lit(False).alias("leaf"))
    needs = cut(inner.unionByName(leaves).mapInArrow(sent, "level int, cell long, to int, kind int"))
    number = spark.createDataFrame([(level, int(c), i) for i, (level, c) in enumerate(blocks.cells) if blocks.ends[i]], "level int, cell long, to int")
    if most_pairs < float("inf"):
        of_block = known.groupBy(F.col("block").alias("level"), of("block").alias("cell")).agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(number), ["level", "cell"]).select("to", "m")
        of_leaf = known.groupBy(F.col("leaf").alias("level"), of("leaf").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        met = needs.filter("kind = 9").join(of_leaf, ["level", "cell"]).select("to", "n").unionByName(needs.filter("kind <> 9").select("to", F.lit(MOMENTS).alias("n")))
        if (met.groupBy("to").agg(F.sum("n").alias("n")).join(of_block, "to").agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0) > most_pairs:
            return None
    place, value = [F.col(c) for c in "xyz"], F.col("value")
    each = known.select(*"xyz", "code", "leaf", F.explode(F.arrays_zip("neurons", "values")).alias("e")).select(*"xyz", "code", "leaf", F.col("e.neurons").alias("neuron"), F.col("e.values").alias("value"))
    # sums around the origin add up; they are moved to a cell's centre where they are used
    rows = each.filter("leaf > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("leaf") - 1))).withColumn("cell", of("level"))
    wanted = needs.filter("kind <> 9").select("level", "cell").distinct()
    moments = [value, *(value * p for p in place), *(value * place[a] * place[b] for a, b in AXES)]
    sums = rows.join(wanted, ["level", "cell"], "left_semi").groupBy("level", "cell", "neuron").agg(*(F.sum(m).alias(f"m{i}") for i, m in enumerate(moments)))
    sums = sums.groupBy("level", "cell").agg(F.collect_list("neuron").alias("neurons"), F.flatten(F.collect_list(F.array(*(f"m{i}" for i in range(10))))).alias("values"))

    def centred(batches):
        for b in batches:
            if not b.num_rows:
                continue
            low, side = corners(b.column("level").to_numpy(), b.column("cell").to_numpy())
            c = low + side[:, None] / 2
            lists = b.column("values")
            m = lists.flatten().to_numpy().reshape(-1, 10).copy()
            p = np.repeat(c, np.diff(lists.offsets.to_numpy()) // 10, axis=0)
            s, first = m[:, 0].copy(), m[:, 1:4].copy()
            for k, (x, y) in enumerate(AXES):
                m[:, 4 + k] += p[:, x] * p[:, y] * s - p[:, x] * first[:, y] - p[:, y] * first[:, x]
            m[:, 1:4] -= p * s[:, None]
            yield pa.RecordBatch.from_arrays([b.column("level"), b.column("cell"), *(pa.array(c[:, k]) for k in range(3)), b.column("neurons"), pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py()), pa.array(m.reshape(-1)))], names=["level", "cell", *"xyz", "neurons", "values"])

    sums = sums.mapInArrow(centred, "level int, cell long, x double, y double, z double, neurons array<int>, values array<double>")
    columns = ["to", "kind", *"xyz", "neurons", "values"]
    far = needs.filter("kind <> 9").join(sums, ["level", "cell"]).select(columns)
    own = known.withColumns({"level": F.col("leaf"), "cell": of("leaf")})
    near = needs.filter("kind = 9").join(own, ["level", "cell"]).select(columns)
    asks = known.withColumns({"level": F.col("block"), "cell": of("block")}).join(F.broadcast(number), ["level", "cell"]).withColumn("kind", F.lit(-1)).select(columns)

    def energy(t: pa.Table) -> pa.Table:
        return pa.table({"neuron": pa.array(np.arange(neurons, dtype=np.int32)), "top": pa.array(_energy(t, kernel, neurons))})

    met = asks.unionByName(far).unionByName(near).groupBy("to").applyInArrow(energy, "neuron int, top double")
    squares = acts.groupBy("neuron").agg(F.sum(F.col("act") * F.col("act")).alias("own"))  # each row with itself
    return met.groupBy("neuron").agg(F.sum("top").alias("top")).join(squares, "neuron").select("neuron", (F.col("top") - F.col("own")).alias("top"))


def monosemanticity_geo_tree(long: DataFrame, located: DataFrame, neurons: int, tau: float = 1e-3, key: str = "point_id", scale_km: float = 500.0, radius: float = 6371.0, **sizes: int) -> DataFrame:
    """(neuron, score): scores within tau of ``sae.monosemanticity_geo``, which computes all pairs. Rows without a place are left out;
    features with one active row have a null score, and those with none no row. Where tau is so small, or the rows so few, that the tree
    would leave a large share of all pairs, these are computed plainly."""
    placed = located.filter("lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)")
    top = sums_over_pairs(long, located, neurons, tau, key, scale_km, radius, **({"most_pairs": SHARE * placed.count() ** 2} | sizes))
    if top is None:
        return sae.monosemanticity_geo(long.filter("act > 0").join(placed, key, "left_semi"), placed, neurons, key, scale_km=scale_km, radius=radius)
    w = long.filter("act > 0").join(placed.select(key), key, "left_semi").groupBy("neuron").agg(F.sum("act").alias("s1"), F.sum(F.col("act") * F.col("act")).alias("s2"), F.count(F.lit(1)).alias("n"))
    return w.join(top, "neuron").select("neuron", F.when(F.col("n") > 1, F.col("top") / (F.col("s1") * F.col("s1") - F.col("s2"))).alias("score"))

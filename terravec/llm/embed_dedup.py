"""Embedding near-dedup: random projections decoded to E8 lattice points, in several tables, with neighbouring cells probed.

Each table projects a unit vector to eight dimensions and finds the nearest point of the E8 lattice; that is its home cell.
It also visits the cells of the lattice neighbours that its projection is next nearest to. What travels to a cell is the row's id
and 64 sign bits; only rows whose bits are near enough to those of a resident or visitor there are sent their vectors. Numpy then
compares these tile by tile, and a pair counts in the first table where it could meet. Tiles hand on counts and a spanning
forest, never the pairs. Equal vectors are one row throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravec.llm.arrow import Forest, groups
from terravec.llm.common import components, cut, dealt_to_tiles, partitions, table

COSINE = 0.93
TABLES = 6
PROBES = 8
#: Projected units of one lattice step; a pair at the threshold is about 1.06 apart in a projection.
WIDTH = 1.3
SEED = 42
PER_TILE = 2048
#: One row in so many is looked at to find the cells that need several tiles.
SAMPLED = 16
#: Bits of the sign sketch, and how many standard deviations of a pair at the threshold it allows for (missed: one in 10^9).
SIGNS, DEVIATIONS = 64, 6.5
#: Sizes of cells that are broadcast at most; and sketches compared at once.
BROADCAST_ROWS, BLOCK = 500_000, 1 << 22


def e8_neighbours() -> np.ndarray:
    """The 240 shortest vectors of the lattice."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    f = np.rint(y)
    r = y - f
    rows, worst = np.arange(len(y)), np.abs(r).argmax(axis=1)
    step = np.where(r[rows, worst] >= 0, 1.0, -1.0)
    f[rows, worst] += np.where(f.sum(axis=1) % 2 != 0, step, 0.0)
    return f


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The lattice point nearest to each row: the better of the two cosets of D8."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def _keys(points: np.ndarray, t: int) -> np.ndarray:
    """A 64-bit number for each lattice point (a hash: equal points have equal ones)."""
    h = np.full(points.shape[:-1], np.uint64(0x9E3779B97F4A7C15 * (t + 1) & (1 << 64) - 1))
    for x in np.moveaxis(np.rint(points * 2).astype(np.int64).view(np.uint64), -1, 0):
        h = (h ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


class Lattice:
    def __init__(self, dims: int, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng([seed, dims])
        self.projections = [rng.normal(0, 1 / width, (dims, 8)) for _ in range(tables)]
        self.near, self.probes = e8_neighbours(), probes
        self.directions = rng.normal(size=(dims, SIGNS))

    def signs(self, unit: np.ndarray) -> np.ndarray:
        """A long for each row, a bit for the side of each random plane it is on."""
        return np.packbits(unit @ self.directions > 0, axis=1).view(np.int64)[:, 0]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes) cell numbers, the home cell first."""
        out = np.empty((len(unit), len(self.projections), 1 + self.probes), dtype=np.int64)
        for t, p in enumerate(self.projections):
            y = unit @ p
            home = nearest_e8(y)
            order = np.argsort(-((y - home) @ self.near.T), axis=1, kind="stable")[:, : self.probes]
            out[:, t, 0], out[:, t, 1:] = _keys(home, t), _keys(home[:, None] + self.near[order], t)
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    """A batch of equally long lists as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(rep, label, vector, copies, dims) of the vectors that can have a link: finite, not zero, with label and without nulls."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = vectors.filter(F.col(label_col).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    return ok.groupBy(F.col(label_col).alias("label"), v.alias("vector")).agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dims", F.size("vector"))


def _by_dims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims = b.column("dims").to_numpy()
        for d in np.unique(dims):
            yield b.filter(pa.array(dims == d))


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """A sorted stream in batches that don't cut a run of equal keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(x).to_numpy(zero_copy_only=False) for x in keys])
        if held:
            last = np.array([held[-1].column(x)[-1].as_py() for x in keys])
            begins = np.flatnonzero((k != last[:, None]).any(axis=0))
            cut_at = int(begins[0]) if len(begins) else b.num_rows
            held.append(b.slice(0, cut_at))
            if not len(begins):
                continue
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, b, k = [], b.slice(cut_at), k[:, cut_at:]
        changes = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        at = int(changes[-1]) if len(changes) else 0
        if at:
            yield b.slice(0, at)
        held = [b.slice(at)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _candidates(max_bits: int):
    """Of a stream sorted by cell and tiles, the rows whose sign bits are near those of a row they may be compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["slot", "tile_i", "tile_j"]
        for b in _whole_runs(batches, keys):
            k = np.stack([b.column(x).to_numpy() for x in keys])
            starts = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, [b.num_rows]])
            run_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            home, tile, bits = b.column("home").to_numpy(zero_copy_only=False), b.column("tile").to_numpy(), b.column("signs").to_numpy().view(np.uint64)
            split = k[1] != k[2]
            found = np.zeros(b.num_rows, dtype=bool)
            asks = np.flatnonzero(home & (np.diff(starts)[run_of] > 1))  # a resident with each row of its cell
            sizes = np.diff(starts)[run_of[asks]]
            parts = np.cumsum(sizes) // BLOCK
            for part in np.unique(parts):
                some = asks[parts == part]
                n = np.diff(starts)[run_of[some]]
                i = np.repeat(some, n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[run_of[some]], n)
                near = (np.bitwise_count(bits[i] ^ bits[j]) <= max_bits) & (i != j) & (~split[i] | (tile[i] != tile[j]))
                found[i[near]] = found[j[near]] = True
            if found.any():
                yield b.filter(pa.array(found)).drop_columns(["signs"])

    return run


def links(reps: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, per_tile: int = PER_TILE) -> DataFrame:
    """(a, b, n): the forest's edges (n 0), and (a, a, n): n vectors, copies counted, that are newly linked with a's."""
    n_parts = partitions(reps.sparkSession)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices: dict[int, Lattice] = {}
        for b in _by_dims(batches):
            d = b.column("dims")[0].as_py()
            lattice = lattices.setdefault(d, Lattice(d, tables, probes, width))
            unit = _unit(_vectors(b.column("vector")))
            flat = lattice.cells(unit).reshape(len(unit), -1)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.reshape(-1)))
            yield b.append_column("signs", pa.array(lattice.signs(unit))).append_column("cells", cells)

    with_cells = cut(reps.mapInArrow(celled, T.StructType([*reps.schema.fields, T.StructField("signs", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType()))])))
    at = with_cells.select("rep", "label", "dims", "signs", F.posexplode("cells").alias("k", "cell"))
    at = at.select("rep", "signs", F.xxhash64("label", "dims", (F.col("k") / (1 + probes)).cast("int"), "cell").alias("slot"), (F.col("k") / (1 + probes)).cast("tinyint").alias("t"), (F.col("k") % (1 + probes) == 0).alias("home"))
    # cells of many rows are split into tiles; a sample of the rows tells which
    sampled = at.filter(F.pmod(F.xxhash64("rep"), F.lit(SAMPLED)) == 0).groupBy("slot").agg((F.count(F.lit(1)) * SAMPLED).alias("cell_rows"))
    sizes = cut(sampled.filter(F.col("cell_rows") > per_tile // 2))
    if sizes.count() <= BROADCAST_ROWS:
        sizes = F.broadcast(sizes)
    tiled = dealt_to_tiles(at, sizes, ["slot"], "rep", per_tile)
    keys = ["slot", "tile_i", "tile_j"]
    p = float(np.arccos(cosine) / np.pi)
    max_bits = int(np.ceil(SIGNS * p + DEVIATIONS * np.sqrt(SIGNS * p * (1 - p))))
    columns = [*keys, "tile", "t", "home", "rep", "signs"]
    met = tiled.select(*columns).repartition(n_parts, *keys).sortWithinPartitions(*keys)
    likely = cut(met.mapInArrow(_candidates(max_bits), T.StructType([f for f in met.schema.fields if f.name != "signs"])))
    full = likely.join(with_cells.select("rep", "label", "vector", "copies", "dims", "cells"), "rep").repartition(n_parts, *keys).sortWithinPartitions(*keys)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, keys):
            home, dims = g.column("home").to_numpy(zero_copy_only=False), g.column("dims").to_numpy()
            if g.num_rows < 2 or not home.any() or dims.min() < dims.max():
                continue
            unit, tile, t = _unit(_vectors(g.column("vector"))), g.column("tile").to_numpy(), g.column("t")[0].as_py()
            label = g.column("label").dictionary_encode().indices.to_numpy()
            cells = g.column("cells").flatten().to_numpy().reshape(g.num_rows, tables, 1 + probes)
            copies, every = g.column("copies").to_numpy(), np.arange(g.num_rows)
            forest, new = Forest(g.num_rows), np.zeros(g.num_rows, dtype=np.int64)

            def near(left: np.ndarray, right: np.ndarray, same: bool) -> None:
                for a in range(0, len(left), 256):
                    some = left[a : a + 256]
                    hits = unit[some] @ unit[right].T >= cosine
                    hits &= some[:, None] < right[None] if same else True
                    hits &= (home[some][:, None] | home[right][None]) & (label[some][:, None] == label[right][None])
                    if not hits.any():
                        continue
                    forest.link(hits, some, right)
                    i, j = np.nonzero(hits)
                    i, j = some[i], right[j]
                    ci, cj = cells[i], cells[j]
                    earlier = np.zeros(len(i), dtype=bool)  # met in a table before this one
                    for s in range(t):
                        earlier |= (ci[:, s, :1] == cj[:, s]).any(axis=1) | (cj[:, s, :1] == ci[:, s]).any(axis=1)
                    # two that visit each other's home meet twice in this table, and count in the cell of the smaller number
                    here, there = np.where(home[i], ci[:, t, 0], cj[:, t, 0]), np.where(home[i], cj[:, t, 0], ci[:, t, 0])
                    back = np.where(home[i], (ci[:, t, 1:] == there[:, None]).any(axis=1), (cj[:, t, 1:] == there[:, None]).any(axis=1))
                    earlier |= ~(home[i] & home[j]) & back & (there < here)
                    i, j = i[~earlier], j[~earlier]
                    np.add.at(new, i, copies[j])
                    np.add.at(new, j, copies[i])

            if g.column("tile_i")[0] == g.column("tile_j")[0]:
                near(every, every, True)
            else:
                first = tile == g.column("tile_i")[0].as_py()
                near(every[first], every[~first], False)
            child, root = forest.edges()
            some = np.flatnonzero(new)
            if len(child) or len(some):
                rep = g.column("rep")
                a = pa.array(np.concatenate([child, some]))
                b = pa.array(np.concatenate([root, some]))
                yield pa.RecordBatch.from_arrays([rep.take(a), rep.take(b), pa.array(np.concatenate([np.zeros(len(child), np.int64), new[some]]))], names=["a", "b", "n"])

    kind = reps.schema["rep"].dataType
    return full.mapInArrow(compared, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("n", T.LongType())]))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, per_tile: int = PER_TILE) -> DataFrame:
    """(id_col, n_links, component_id, kept) of each row.

    Vectors that are null, empty, zero, of no label or with null or non-finite entries have no link; vectors of unequal length
    aren't compared. Null ids are never representatives: such rows get 0 links. Equal vectors of a label are linked, and repeated
    rows with them; each row keeps its own result. A pair exactly at the threshold is linked. Other columns aren't looked at. An
    empty table gives an empty result. A pair at the threshold meets in a table with a chance of about 0.6, so in none of six
    with one of 0.4 percent.
    """
    own = vectors.select(F.col(id_col), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    reps = cut(distinct_vectors(own.filter(F.col(id_col).isNotNull()), id_col, "vector", "label"))
    found = cut(links(reps, cosine, tables, probes, width, per_tile))
    counted = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("others"))
    grouped = components(found.filter("n = 0").select("a", "b"))
    named = reps.join(counted, reps["rep"] == counted["a"], "left").join(grouped, reps["rep"] == grouped["node"], "left")
    named = named.select("label", "vector", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = own.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.col(id_col).isNotNull()).join(named, ["label", "vector"], "left")
    rest = own.filter(F.col("label").isNull() | F.col("vector").isNull() | F.col(id_col).isNull()).withColumns({"n_links": F.lit(None).cast("long"), "component_id": F.lit(None).cast(own.schema[id_col].dataType)})
    out = out.select(id_col, "n_links", "component_id").unionByName(rest.select(id_col, "n_links", "component_id"))
    out = out.withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.coalesce("component_id", id_col)})
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP5_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings WHERE label IS NOT NULL),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) l ON l.a = e.vec_id
"""

"""Sparse decomposition by active sets, with safe screening, and over dictionaries that no task can hold.

Least |w C - v|^2 + lam |w|_1 over w >= 0: only concepts whose product with the rest v - w C is above lam / 2 can lower it. So a
row holds a few active concepts, solves for these alone, and takes in the concepts that its rest violates most, until none is
above. That nothing is left out is certain, as the last look is over all concepts. Within a block the duality gap gives a ball that
holds the dual optimum; concepts that are below lam / 2 all over it for every row of the block are never looked at again.

A dictionary over the bounds is dealt to parts and the rows to blocks; a task finds, for a block and a part, each row's worst
violations, and their vectors go to the rows that take them in. Rows that have settled leave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravec.operators.shared import cut, lookup

#: Concepts that a row takes in at once, and rounds at most (each takes in one at least, so that a row has settled long before).
ADDED, ROUNDS = 16, 200
#: Bytes of a block of rows or of a part of the dictionary.
PART_BYTES = 1 << 26


def descend(gram: np.ndarray, b: np.ndarray, w: np.ndarray, tol: float, sweeps: int = 5000) -> np.ndarray:
    """Rows w >= 0 of least w G w / 2 - b w by coordinate descent over their few places, all rows at once."""
    w, live = w.copy(), np.arange(len(w))
    diagonal = np.maximum(np.einsum("nkk->nk", gram), 1e-12)
    for _ in range(sweeps):
        g, x, most = gram[live], w[live], np.zeros(len(live))
        for k in range(w.shape[1]):
            new = np.maximum(x[:, k] + (b[live, k] - np.einsum("nk,nk->n", g[:, k], x)) / diagonal[live, k], 0)
            most = np.maximum(most, np.abs(new - x[:, k]))
            x[:, k] = new
        w[live] = x
        live = live[most > tol]
        if not len(live):
            break
    return w


def taken_in(active: np.ndarray, w: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(active, w) with new places (-1: none) added and places of weight zero given up, as narrow as they can be."""
    at = np.concatenate([np.where(w > 0, active, -1), new], axis=1)
    x = np.concatenate([w, np.zeros(new.shape)], axis=1)
    order = np.argsort(at < 0, axis=1, kind="stable")
    at, x = np.take_along_axis(at, order, 1), np.take_along_axis(x, order, 1)
    width = max(1, int((at >= 0).sum(axis=1).max(initial=0)))
    return at[:, :width], np.where(at[:, :width] >= 0, x[:, :width], 0)


def solved(vectors: np.ndarray, used: np.ndarray, v: np.ndarray, w: np.ndarray, lam: float, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(w, rest): weights of the places (vectors: rows, places, dims) that are used, and what they leave of v."""
    vectors = np.where(used[:, :, None], vectors, 0)
    b = np.where(used, np.einsum("nkd,nd->nk", vectors, v) - lam / 2, 0)
    w = descend(np.einsum("nkd,nld->nkl", vectors, vectors), b, w, tol)
    return w, v - np.einsum("nk,nkd->nd", w, vectors)


def active_set(c: np.ndarray, v: np.ndarray, lam: float, tol: float, rounds: int = ROUNDS) -> np.ndarray:
    """(rows, concepts) weights over a dictionary in memory."""
    out, mu = np.zeros((len(v), len(c))), lam / 2
    if not len(c) or not len(v):
        return out
    size, near = np.linalg.norm(c, axis=1), np.arange(len(c))
    live, active, w, rest = np.arange(len(v)), np.full((len(v), 1), -1), np.zeros((len(v), 1)), v.copy()
    for _ in range(rounds):
        product = rest @ c[near].T
        over = product - mu
        place = np.full(len(c), -1)
        place[near] = np.arange(len(near))
        held = np.where(active >= 0, place[active], -1)
        i, j = np.nonzero((held >= 0) & (w > 0))
        over[i, held[i, j]] = -np.inf
        top = np.argpartition(-over, min(ADDED, over.shape[1]) - 1, axis=1)[:, :ADDED]
        new = np.where(np.take_along_axis(over, top, 1) > tol, near[top], -1)
        done = (new < 0).all(axis=1)
        i, j = np.nonzero((active >= 0) & done[:, None])
        out[live[i], active[i, j]] = w[i, j]
        if done.all():
            return out
        # gap-safe: the scaled rest is dual feasible, and the dual optimum is within the root of twice the gap of it
        scale = np.minimum(1, mu / np.maximum(product.max(axis=1), 1e-300))
        dual = scale[:, None] * rest
        gap = (rest**2).sum(1) / 2 + mu * w.sum(1) - ((v[live] ** 2).sum(1) - ((v[live] - dual) ** 2).sum(1)) / 2
        ball = np.sqrt(2 * np.maximum(gap, 0)) + 1e-9
        keep = ~done
        may = (scale[keep, None] * product[keep] + ball[keep, None] * size[near][None] >= mu * (1 - 1e-9)).any(axis=0)
        live, active, w, rest, new = live[keep], active[keep], w[keep], rest[keep], new[keep]
        active, w = taken_in(active, w, new)
        used = np.unique(active[active >= 0])
        near = np.union1d(near[may], used)
        w, rest = solved(c[np.maximum(active, 0)], active >= 0, v[live], w, lam, tol)
    i, j = np.nonzero(active >= 0)
    out[live[i], active[i, j]] = w[i, j]
    return out


_STATE = "row long, v array<double>, rest array<double>, names array<int>, held array<double>, w array<double>"


def _lists(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def split_weights(rows: DataFrame, dictionary: DataFrame, dims: int, lam: float, tol: float, part_bytes: int = PART_BYTES) -> DataFrame:
    """(row, names, w, sum): of rows (row, v), the active concepts' ids in order, their weights, and the sum of weights times
    vectors, over a dictionary (concept_id, vector) of any size, which is nowhere gathered."""
    spark = rows.sparkSession
    per = max(1, part_bytes // (8 * max(dims, 1)))
    parts = max(1, -(-dictionary.count() // per))
    dealt = cut(dictionary.select("concept_id", F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64("concept_id"), F.lit(parts)).cast("int").alias("part")))
    none = F.array().cast("array<double>")
    state = cut(rows.select("row", "v", F.col("v").alias("rest"), F.array().cast("array<int>").alias("names"), none.alias("held"), none.alias("w")))
    settled, count = [], state.count()

    def worst(t: pa.Table) -> pa.Table:
        row = t.column("concept_id").is_null()
        r, c = t.filter(row), t.filter(pa.compute.invert(row))
        at, of, how = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if r.num_rows and c.num_rows:
            rest, vectors, names, ids = _lists(r.column("x")), _lists(c.column("x")), r.column("names").to_pylist(), c.column("concept_id").to_numpy()
            for s in range(0, len(rest), 256):
                over = rest[s : s + 256] @ vectors.T - lam / 2
                i, j = np.nonzero(over > tol)
                mine = np.array([ids[b] not in names[s + a] for a, b in zip(i, j, strict=True)], bool)
                i, j = i[mine], j[mine]
                x = over[i, j]
                order = np.lexsort((j, -x, i))
                i, j, x = i[order], j[order], x[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < ADDED
                at, of, how = [*at, i[first] + s], [*of, ids[j[first]]], [*how, x[first]]
        return pa.table({"row": r.column("row").take(pa.array(np.concatenate(at).astype(np.int64))), "concept_id": pa.array(np.concatenate(of).astype(np.int32)), "over": pa.array(np.concatenate(how))})

    def solve(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                if not b.num_rows:
                    continue
                v = _lists(b.column("v"))
                names = [list(x) for x in b.column("names").to_pylist()]
                new = [[(x["concept_id"], x["vector"]) for x in found] for found in b.column("found").to_pylist()]
                width = max(len(n) + len(f) for n, f in zip(names, new, strict=True))
                vectors, w, used = np.zeros((len(v), width, v.shape[1])), np.zeros((len(v), width)), np.zeros((len(v), width), bool)
                for i, (held, weights) in enumerate(zip(b.column("held").to_pylist(), b.column("w").to_pylist(), strict=True)):
                    n = len(names[i])
                    if n:
                        vectors[i, :n], w[i, :n] = np.array(held).reshape(n, -1), weights
                    for k, (name, x) in enumerate(new[i]):
                        vectors[i, n + k] = x
                        names[i].append(name)
                    used[i, : len(names[i])] = True
                w, rest = solved(vectors, used, v, w, lam, tol)
                on = [np.flatnonzero(x > 0) for x in w]
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("v"), pa.array(rest.tolist(), pa.list_(pa.float64())), pa.array([[n[k] for k in o] for n, o in zip(names, on, strict=True)], pa.list_(pa.int32())), pa.array([x[o].reshape(-1).tolist() for x, o in zip(vectors, on, strict=True)], pa.list_(pa.float64())), pa.array([x[o].tolist() for x, o in zip(w, on, strict=True)], pa.list_(pa.float64()))], names=["row", "v", "rest", "names", "held", "w"])

    for _ in range(ROUNDS):
        blocks = max(1, -(-count // per))
        block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = state.select("row", F.col("rest").alias("x"), "names", F.lit(None).cast("int").alias("concept_id"), block.alias("block"), each(parts).alias("part"))
        right = dealt.select(F.lit(None).cast("long").alias("row"), F.col("vector").alias("x"), F.lit(None).cast("array<int>").alias("names"), F.col("concept_id").cast("int"), each(blocks).alias("block"), "part")
        found = left.unionByName(right).groupBy("block", "part").applyInArrow(worst, "row long, concept_id int, over double")
        first = Window.partitionBy("row").orderBy(F.desc("over"), "concept_id")
        chosen = cut(found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= ADDED).select("row", "concept_id"))
        wanted = lookup(chosen, dealt.select("concept_id", "vector"), ["concept_id"]).groupBy("row").agg(F.collect_list(F.struct("concept_id", "vector")).alias("found"))
        settled.append(state.join(chosen.select("row").distinct(), "row", "left_anti").select("row", "names", "w", F.zip_with("v", "rest", lambda a, b: a - b).alias("sum")))
        state = cut(state.join(wanted, "row").mapInArrow(solve, _STATE))
        count = state.count()
        if not count:
            break
    else:
        settled.append(state.select("row", "names", "w", F.zip_with("v", "rest", lambda a, b: a - b).alias("sum")))
    out = settled[0]
    for df in settled[1:]:
        out = out.unionByName(df)
    ordered = F.array_sort(F.filter(F.arrays_zip("names", "w"), lambda x: x["w"] > 0))
    return out.withColumn("_o", ordered).select("row", F.transform("_o", lambda x: x["names"]).alias("names"), F.transform("_o", lambda x: x["w"]).alias("w"), "sum")

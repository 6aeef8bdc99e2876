"""Nearest neighbours of a set of query vectors: a block matrix join whose int8 product tiles bound every distance.

Each vector is also held as whole numbers from -127 to 127 times a scale, with the length of what that rounding loses. The product
of two such vectors is a whole number, and |distance - rounded distance| is at most the sum of the two lost lengths. Blocks of
queries meet blocks of candidates; in a slice of a pair of blocks, the k-th smallest upper bound of a query cuts off all candidates
whose lower bound is larger, and only the rest are computed in double. A heap for each query keeps the best k of them; the heaps of
its blocks are merged at the end. Nothing is approximate. Equal vectors are one candidate with its smallest ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravec.llm.arrow import groups
from terravec.llm.common import cut, partitions, table

K, EVERY = 10, 100
#: Rows of a block: not under the first where there are tasks enough, nor over the second, nor so many that they take more bytes.
BLOCK_LEAST, BLOCK_MOST, BLOCK_BYTES = 2048, 65_536, 32 << 20
#: Queries and candidates of one slice of a tile, and columns of one exact product in single precision (127 * 127 * 1024 < 2^24).
SLICE_ROWS, SLICE_COLUMNS, SLICE_DIMS = 512, 4096, 1024
#: Pairs that are computed in double at once.
PAIRS = 1 << 16
#: Query ids of one row: ids divisible by ``every`` that lie in one range of every * IDS.
IDS = 4096


def finite(v: Column) -> Column:
    """Whether an array is there, without nulls, and finite."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def rows_of(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Equally long lists as rows of numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def bytes_of(column: pa.Array, kind: type = np.int8) -> np.ndarray:
    """Equally long binary values as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def as_binary(x: np.ndarray) -> pa.Array:
    raw, width = np.ascontiguousarray(x).tobytes(), x.shape[1] * x.itemsize
    return pa.array([raw[k : k + width] for k in range(0, len(raw), width)], pa.binary())


def by_length(batches: Iterator[pa.RecordBatch], column: str = "dims") -> Iterator[pa.RecordBatch]:
    """Batches of vectors of one length."""
    for b in batches:
        if b.num_rows:
            dims = b.column(column).to_numpy()
            for d in np.unique(dims):
                yield b.filter(pa.array(dims == d))


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, squared length of the rounded vector, length of what is lost) of each row."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(np.float64).tiny)
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127)
    with np.errstate(over="ignore"):
        lost = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
        return codes.astype(np.int8), scale, scale * scale * (codes**2).sum(axis=1), lost


def bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of queries (rows) and candidates (columns), each as ``rounded`` gives them."""
    product = np.zeros((len(q[0]), len(c[0])))
    for d in range(0, q[0].shape[1], SLICE_DIMS):
        product += q[0][:, d : d + SLICE_DIMS].astype(np.float32) @ c[0][:, d : d + SLICE_DIMS].astype(np.float32).T
    with np.errstate(over="ignore", invalid="ignore"):
        size = q[2][:, None] + c[2][None]
        square = size - 2 * q[1][:, None] * c[1][None] * product
        lost = (q[3][:, None] + c[3][None]) * (1 + 1e-9)
        lower, upper = np.sqrt(np.maximum(square - 1e-13 * size, 0)) - lost, np.sqrt(np.maximum(square + 1e-13 * size, 0)) + lost
    return np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)  # what overflows isn't ruled out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows and rows, in double, entries summed in their order."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
            total += (x - y) ** 2
    return np.sqrt(total)


def tile(q: tuple, c: tuple, q_vectors: np.ndarray, c_vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """(query, [(distance, candidate)]) of each query of a block: its k nearest of the block of candidates, ties by ids."""
    for s in range(0, len(q_vectors), SLICE_ROWS):
        some = tuple(x[s : s + SLICE_ROWS] for x in q)
        n = len(some[0])
        heaps: list[list[tuple[float, int, int]]] = [[] for _ in range(n)]  # the worst first: (-distance, -id, candidate)
        least = np.full((n, k), np.inf)
        for t in range(0, len(c_vectors), SLICE_COLUMNS):
            lower, upper = bounds(some, tuple(x[t : t + SLICE_COLUMNS] for x in c))
            least = np.partition(np.concatenate([least, upper], axis=1), k - 1, axis=1)[:, :k]
            limit = least.max(axis=1)
            at, to = np.nonzero(lower <= limit[:, None])
            for p in range(0, len(at), PAIRS):
                i, j = at[p : p + PAIRS], to[p : p + PAIRS] + t
                d = distances(q_vectors[i + s], c_vectors[j])
                worst = np.array([-h[0][0] if len(h) == k else np.inf for h in heaps])
                near = np.flatnonzero(d <= worst[i])
                for x, y, z in zip(i[near].tolist(), j[near].tolist(), d[near].tolist(), strict=True):
                    new = (-z, -int(ids[y]), y)
                    if len(heaps[x]) < k:
                        heapq.heappush(heaps[x], new)
                    elif new > heaps[x][0]:
                        heapq.heapreplace(heaps[x], new)
        for x, h in enumerate(heaps):
            yield s + x, [(-d, y) for d, _, y in h]


def blocks(rows: int, dims: int, tasks: int) -> int:
    """Into how many blocks so many rows go."""
    most = max(1, min(BLOCK_MOST, BLOCK_BYTES // (9 * dims + 64)))
    return max(1, -(-rows // most), min(tasks, -(-rows // BLOCK_LEAST)))


def distinct_by(rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """(keys..., ids) of rows (id, keys...): all that have the same keys as one, with their ``keep`` smallest ids. Of keys that many
    rows have, a task hands on no more than these, so that none gathers them all."""
    ranked = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("rank") <= keep)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_set("id")).alias("ids"))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, tasks: int | None = None) -> DataFrame:
    """(query_id, rank, id_col, score): of each row whose id is divisible by ``every``, the k other rows of the smallest Euclidean
    distance, ties by id; all others, if they are fewer.

    Rows with a null id, and vectors that are null, empty, zero or have null or non-finite entries, take no part; vectors of
    another length than the query's are no candidates. A row that is repeated counts once. An id with several vectors is a candidate
    with each of them, and asks with each of them; none of its rows is a candidate of its own, so it may find fewer than k.
    Distances that overflow are infinite, and tied. Other columns aren't looked at. A table without rows or queries gives no row.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + 0.0).alias("vector"))  # no negative zeros
    rows = rows.filter(F.col("id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    tasks, most = tasks or partitions(spark), k + 1  # a query's own vector is among the candidates
    asking = rows.filter(F.col("id") % every == 0).groupBy("vector", F.floor(F.col("id") / (every * IDS)).alias("range")).agg(F.collect_set("id").alias("own"))
    reps = distinct_by(rows, ["vector"], most).withColumns({"rep": F.col("ids")[0], "dims": F.size("vector")})
    named = {"node": F.xxhash64("vector"), "twin": F.xxhash64(F.lit(1), "vector")}  # 128 bits for a vector
    reps = reps.withColumns(named)
    asked = asking.groupBy("vector").agg(F.lit(True).alias("asks"))
    reps = reps.join(asked, "vector", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_length(batches):
            x = rows_of(b.column("vector"))
            codes, scale, square, lost = rounded(x)
            columns = {"raw": as_binary(x), "code": as_binary(codes), "scale": pa.array(scale), "square": pa.array(square), "lost": pa.array(lost)}
            for name, values in columns.items():
                b = b.append_column(name, values)
            yield b.drop_columns(["vector"])

    numbers = [T.StructField(c, T.DoubleType()) for c in ("scale", "square", "lost")]
    schema = [f for f in reps.schema.fields if f.name != "vector"] + [T.StructField("raw", T.BinaryType()), T.StructField("code", T.BinaryType()), *numbers]
    reps = cut(reps.mapInArrow(coded, T.StructType(schema)))
    size = reps.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.max("dims").alias("dims")).first()
    if not size.q:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    down, over = blocks(size.q, size.dims, 1), blocks(size.n, size.dims, tasks)
    columns = ["node", "twin", "dims", "rep", "ids", "raw", "code", "scale", "square", "lost"]
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = reps.filter("asks").select(*columns, own(down).alias("bi"), each(over).alias("bj"), F.lit(True).alias("asks"))
    right = reps.select(*columns, each(down).alias("bi"), own(over).alias("bj"), F.lit(False).alias("asks"))
    met = left.unionByName(right).repartition(max(tasks, min(down * over, 16 * tasks)), "bi", "bj").sortWithinPartitions("bi", "bj")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in by_length(groups(batches, ["bi", "bj"])):
            asks = g.column("asks").to_numpy(zero_copy_only=False)
            q, c = g.filter(pa.array(asks)), g.filter(pa.array(~asks))
            if not q.num_rows or not c.num_rows:
                continue
            of = lambda b: (bytes_of(b.column("code")), *(b.column(x).to_numpy() for x in ("scale", "square", "lost")))
            at, to, d = [], [], []
            for i, best in tile(of(q), of(c), bytes_of(q.column("raw"), np.float64), bytes_of(c.column("raw"), np.float64), c.column("rep").to_numpy(), most):
                at += [i] * len(best)
                to += [y for _, y in best]
                d += [x for x, _ in best]
            found = [*(q.column(x).take(pa.array(at, pa.int64())) for x in ("node", "twin")), pa.array(d, pa.float64()), c.column("ids").take(pa.array(to, pa.int64()))]
            yield pa.RecordBatch.from_arrays(found, names=["node", "twin", "score", "ids"])

    node = [T.StructField("node", T.LongType()), T.StructField("twin", T.LongType())]
    longs = T.ArrayType(T.LongType())
    best = met.mapInArrow(searched, T.StructType([*node, T.StructField("score", T.DoubleType()), T.StructField("ids", longs)]))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["node", "twin"]):
            first = heapq.nsmallest(most, ((d, i) for d, ids in zip(g.column("score").to_pylist(), g.column("ids").to_pylist(), strict=True) for i in ids))
            yield pa.RecordBatch.from_arrays([g.column("node")[:1], g.column("twin")[:1], pa.array([[d for d, _ in first]]), pa.array([[i for _, i in first]])], names=["node", "twin", "scores", "ids"])

    lists = best.repartition(tasks, "node", "twin").sortWithinPartitions("node", "twin")
    lists = lists.mapInArrow(merged, T.StructType([*node, T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("ids", longs)]))
    found = asking.select(*(c.alias(x) for x, c in named.items()), "own").join(lists, ["node", "twin"])
    found = found.select(F.explode("own").alias("query_id"), F.arrays_zip("scores", "ids").alias("found"))
    others = F.slice(F.filter("found", lambda x: x["ids"] != F.col("query_id")), 1, k)
    out = found.select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.ids").alias(id_col), F.col("x.scores").alias("score"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= {K}
"""

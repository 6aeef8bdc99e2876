"""Vector code compression: product codes whose codebooks are trained by an active-entry Lloyd iteration.

Rows are held in blocks, each with its integer components and, for every part, the assigned entry and the exact distance to it. In
a round, a part whose entry didn't move is compared only with the entries that did, against the distance it has stored; all
others are compared with all entries. That is exact: an entry that stood still and lost to a distance that still holds can't win.
A round writes the blocks anew and returns one sum and count for each entry and component, however many rows there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravec.llm.common import cut, table
from terravec.llm.nearest import finite, rows_of

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a block at most.
BLOCK_ROWS = 4096
#: Labels with over this share of the rows are joined by broadcast; there are 10,000 of them at most.
HOT = 1e-4


def largest(dims: int) -> int:
    """The magnitude below which the squared distance of two vectors of so many components fits a long (and a component 32 bits)."""
    return int(2 ** ((62 - int(np.ceil(np.log2(dims)))) / 2 - 1))


def slices(dims: int, parts: int) -> list[slice]:
    """Where the parts lie: equally long, or the first ones by one longer where ``parts`` doesn't divide ``dims``."""
    ends = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(dims), parts))]).tolist()
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(rows, entries) squared distances of integers."""
    return np.stack([np.einsum("ij,ij->i", x - e, x - e) for e in entries], axis=1)


def assign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray | None, stored: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its squared distance, ties to the lower index.

    code, stored: those of the round before (None at first); moved: which entries have changed since.
    """
    if code is None or stored is None:
        d = squares(x, entries)
        code = d.argmin(axis=1)
        return code, d[np.arange(len(x)), code]
    code, stored = code.copy(), stored.copy()
    again = np.flatnonzero(moved[code])
    fixed = np.flatnonzero(~moved[code])
    if len(again):
        code[again], stored[again] = assign(x[again], entries, moved, None, None)
    for e in np.flatnonzero(moved) if len(fixed) else []:
        d = squares(x[fixed], entries[e : e + 1])[:, 0]
        better = (d < stored[fixed]) | (d == stored[fixed]) & (e < code[fixed])
        code[fixed[better]], stored[fixed[better]] = e, d[better]
    return code, stored


_BYTES = T.BinaryType()


def _blocks(rows: DataFrame, id_type: T.DataType, label_type: T.DataType) -> DataFrame:
    """(ids, labels, x, code, stored): blocks of the rows; code and stored are empty yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(a, BLOCK_ROWS)
                x = rows_of(b.column("x"), np.int64)
                lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([x.astype(np.int32).tobytes()], pa.binary()), *[pa.array([b""], pa.binary())] * 2], names=["ids", "labels", "x", "code", "stored"])

    fields = [T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)), *(T.StructField(c, _BYTES) for c in ("x", "code", "stored"))]
    return rows.select("id", "label", "x").mapInArrow(run, T.StructType(fields))


def _assigned(blocks: DataFrame, dims: int, books: list[np.ndarray], moved: list[np.ndarray]) -> DataFrame:
    """The blocks with code and stored of these codebooks."""
    shared, at = blocks.sparkSession.sparkContext.broadcast((books, moved)), slices(dims, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved = shared.value
        for b in batches:
            codes, distances = [], []
            for raw, code, stored in zip(*(b.column(c).to_pylist() for c in ("x", "code", "stored")), strict=True):
                x = np.frombuffer(raw, np.int32).reshape(-1, dims).astype(np.int64)
                old = np.frombuffer(code, np.uint8).reshape(-1, len(books)).astype(np.int64) if code else None
                far = np.frombuffer(stored, np.int64).reshape(-1, len(books)) if code else None
                found = [assign(x[:, s], e, m, None if old is None else old[:, p], None if far is None else far[:, p]) for p, (s, e, m) in enumerate(zip(at, books, moved, strict=True))]
                codes.append(np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes())
                distances.append(np.stack([f[1] for f in found], axis=1).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("ids", "labels", "x")), pa.array(codes, pa.binary()), pa.array(distances, pa.binary())], names=["ids", "labels", "x", "code", "stored"])

    return blocks.mapInArrow(run, blocks.schema)


def _moved(blocks: DataFrame, dims: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks of the next round: the floor of the mean of an entry's parts, or the entry where it has none."""
    at, parts, entries = slices(dims, len(books)), len(books), len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((entries, dims), np.int64), np.zeros((entries, parts), np.int64)
        for b in batches:
            for raw, code in zip(b.column("x").to_pylist(), b.column("code").to_pylist(), strict=True):
                x, c = np.frombuffer(raw, np.int32).reshape(-1, dims).astype(np.int64), np.frombuffer(code, np.uint8).reshape(-1, parts)
                for p, s in enumerate(at):
                    np.add.at(count[:, p], c[:, p], 1)
                    for e in np.unique(c[:, p]):
                        total[e, s] += x[c[:, p] == e, s].sum(axis=0)
        e, p = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(e, pa.int32()), pa.array(p, pa.int32()), pa.array(count[e, p]), pa.array([total[i, at[k]].tolist() for i, k in zip(e, p, strict=True)], pa.list_(pa.int64()))], names=["entry", "part", "n", "sums"])

    per_task = blocks.select("x", "code").mapInArrow(run, "entry int, part int, n long, sums array<long>")
    per_entry = per_task.select("entry", "part", "n", F.posexplode("sums").alias("k", "s")).groupBy("part", "entry", "k")
    out = [b.copy() for b in books]
    for r in per_entry.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # one row for each number of the codebooks
        out[r.part][r.entry, r.k] = int(r.s) // r.n
    return out


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all numbers in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.reshape(-1)).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of each row that takes part.

    Rows take no part whose vector is null or empty, has null or non-finite entries, another length than the vector of the smallest
    id, or a component too large for squared distances in longs (``largest``: from 32,768 on for 64 dimensions). Where ``parts``
    doesn't divide the length, the first parts are by one longer; vectors shorter than ``parts`` leave the last ones empty. With
    fewer rows than ``entries`` a codebook has as many entries as rows. Of rows that share an id the one with the smaller
    components is the earlier entry; a null id comes last. Repeated rows are coded each, and null labels are one label. A
    sum of errors beyond a long is the largest long. Other columns aren't looked at. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.floor(v * F.lit(float(scale))))
    small = F.forall(F.col(vector_col), lambda v: F.abs(v.cast("double") * scale) < float(1 << 40))
    own = vectors.filter(finite(F.col(vector_col)) & (F.size(vector_col) > 0) & small).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("x"))
    first = own.orderBy(F.asc_nulls_last("id"), "x").limit(1).collect()
    dims = len(first[0].x) if first else 1
    own = own.filter((F.size("x") == dims) & F.forall("x", lambda v: F.abs(v) < largest(dims)))
    heads = [np.array(r.x, np.int64) for r in own.orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()]
    id_type, label_type = (vectors.schema[c].dataType for c in (id_col, label_col))
    blocks = _blocks(own, id_type, label_type)
    books = [np.stack([h[s] for h in heads]) for s in slices(dims, parts)] if heads else [np.zeros((1, s.stop - s.start), np.int64) for s in slices(dims, parts)]
    moved = [np.ones(len(b), bool) for b in books]
    for _ in range(rounds if heads else 0):
        blocks = cut(_assigned(blocks, dims, books, moved))
        new = _moved(blocks, dims, books)
        moved = [(a != b).any(axis=1) for a, b in zip(books, new, strict=True)]
        books = new
    blocks = _assigned(blocks, dims, books, moved)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, labels, code, stored in zip(b.column("ids"), b.column("labels"), b.column("code").to_pylist(), b.column("stored").to_pylist(), strict=True):
                text = code.hex()
                error = np.frombuffer(stored, np.int64).reshape(-1, parts).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    rows = cut(blocks.mapInArrow(coded, schema))
    totals = cut(rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")).withColumnRenamed("label", "of"))
    hot = F.col("n") > HOT * rows.count()
    met = rows.join(F.broadcast(totals.filter(hot).drop("n")), F.col("label").eqNullSafe(F.col("of")), "left")
    rest = met.filter("label_error IS NULL").drop("of", "label_error").join(totals.filter(~hot).drop("n"), F.col("label").eqNullSafe(F.col("of")))
    out = met.filter("label_error IS NOT NULL").unionByName(rest)
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def _sql() -> str:
    """The rounds one after another, each with all distances."""
    steps = [
        """v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""w AS MATERIALIZED (
  SELECT vec_id, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] AS y
  FROM v CROSS JOIN (SELECT unnest(range({PARTS})) AS part))""",
        f"""c0 AS MATERIALIZED (
  SELECT part, entry, y FROM w JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {ENTRIES}) h USING (vec_id))""",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, part, min(d * {ENTRIES} + entry) % {ENTRIES} AS entry, min(d) AS d FROM (
    SELECT w.vec_id, w.part, entry, list_sum(list_transform(list_zip(w.y, c.y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM w JOIN c{r} c ON w.part = c.part) GROUP BY vec_id, part)""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(n.y, c.y) AS y FROM c{r} c LEFT JOIN (
    SELECT part, entry, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY k) AS y FROM (
      SELECT part, entry, k, sum(z) AS s, count(*) AS n FROM (
        SELECT part, entry, unnest(y) AS z, generate_subscripts(y, 1) AS k FROM a{r} JOIN w USING (vec_id, part)) GROUP BY part, entry, k)
    GROUP BY part, entry) n ON n.part = c.part AND n.entry = c.entry)""")
    return "WITH " + ",\n".join(steps) + f""",
e AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM e JOIN v USING (vec_id)
"""


OP13_SQL = _sql()

"""Means and medians of vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vector_mean(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """(by..., mean): element-wise mean, whole or per group. A tree aggregate: partial sums are combined before the shuffle."""
    return df.groupBy(*by).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("mean"))


def geometric_median(df: DataFrame, vector: str, max_rounds: int = 100, tol: float = 1e-5, floor: float = 1e-12) -> np.ndarray:
    """Weiszfeld: from the mean, weights by the reciprocal of the distance (floored), until the move is below tol.

    Each round is one pass over the vectors, which are kept where they are; the guess is broadcast, and a task hands on one
    weighted sum of its rows. The plan is the same in each round.
    """
    x = df.select(F.col(vector).cast("array<double>").alias("x")).filter(F.col("x").isNotNull()).persist()
    try:
        guess = np.array(vector_mean(x, "x").first()[0])
        for _ in range(max_rounds):
            shared = df.sparkSession.sparkContext.broadcast(guess)

            def weighed(batches, shared=shared):
                total, weight = np.zeros(len(shared.value)), 0.0
                for b in batches:
                    if b.num_rows:
                        rows = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                        w = 1 / np.maximum(np.sqrt(((rows - shared.value) ** 2).sum(axis=1)), floor)
                        total, weight = total + w @ rows, weight + w.sum()
                yield pa.RecordBatch.from_arrays([pa.array([np.append(total, weight).tolist()])], names=["sums"])

            sums = x.mapInArrow(weighed, "sums array<double>").select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s"))
            found = np.array([r.s for r in sums.orderBy("k").collect()])  # one number for each dimension, and the weight
            now = found[:-1] / found[-1]
            moved, guess = float(np.linalg.norm(now - guess)), now
            shared.unpersist()
            if moved < tol:
                break
        return guess
    finally:
        x.unpersist()


#: Rows of one block of pairwise work; a task holds two blocks.
BLOCK_ROWS = 10_000


def blocks_of(df: DataFrame, rows: int = BLOCK_ROWS) -> int:
    """So many blocks that none has much over ``rows`` rows, two at least."""
    return max(2, -(-df.count() // rows))

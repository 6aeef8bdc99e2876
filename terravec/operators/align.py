"""Batches of paired vectors and their symmetric contrastive loss."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravec.functions.arrays import doubles, dot, l2_normalize
from terravec.operators.points import ranked_by


def assign_batches(df: DataFrame, size: int, key: str, order: Column | None = None, drop_last: bool = False) -> DataFrame:
    """Adds batch_id: consecutive batches of ``size`` rows in order; drop_last leaves out a batch that isn't full."""
    ranked = ranked_by(df, F.col(key) if order is None else order, key).withColumn("batch_id", F.floor(F.col("_rank") / size)).drop("_rank")
    if not drop_last:
        return ranked
    full = df.count() // size
    return ranked.filter(F.col("batch_id") < full)


def batch_pairs(df: DataFrame, key: str) -> DataFrame:
    """Every (text, location) pair of a batch: batch_id, text_id, loc_id and their vectors (text_vec, loc_vec)."""
    a = df.select("batch_id", F.col(key).alias("text_id"), "text_vec")
    b = df.select("batch_id", F.col(key).alias("loc_id"), "loc_vec")
    return a.join(b, "batch_id")


def clip_loss_columns(df: DataFrame, key: str, scale: float) -> DataFrame:
    """(batch_id, loss) with Column expressions: for small batches and as a check of the other form."""
    unit = df.select("batch_id", key, l2_normalize(doubles(F.col("text_vec"))).alias("text_vec"), l2_normalize(doubles(F.col("loc_vec"))).alias("loc_vec"))
    p = batch_pairs(unit, key).withColumn("z", dot(F.col("text_vec"), F.col("loc_vec")) * scale)
    own = F.max(F.when(F.col("text_id") == F.col("loc_id"), F.col("z")))
    side = lambda by: p.groupBy("batch_id", by).agg((F.log(F.sum(F.exp("z"))) - own).alias("l")).groupBy("batch_id").agg(F.avg("l").alias(f"l_{by}"))
    return side("text_id").join(side("loc_id"), "batch_id").select("batch_id", ((F.col("l_text_id") + F.col("l_loc_id")) / 2).alias("loss"))


def clip_loss(df: DataFrame, key: str, scale: float) -> DataFrame:
    """(batch_id, loss): mean cross entropy of scaled logits by row and by column, halved. A batch's square of pairs stays in
    one task, as a matrix."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        unit = lambda c: (lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))(np.stack([np.asarray(v, float) for v in pdf[c]]))
        z = unit("text_vec") @ unit("loc_vec").T * scale
        log_sum = lambda m, axis: np.log(np.exp(m - m.max(axis=axis, keepdims=True)).sum(axis=axis)) + m.max(axis=axis)
        own = np.diag(z)
        return pd.DataFrame({"batch_id": [pdf.batch_id.iloc[0]], "loss": [((log_sum(z, 1) - own).mean() + (log_sum(z, 0) - own).mean()) / 2]})

    return df.groupBy("batch_id").applyInPandas(one, "batch_id bigint, loss double")


def mean_loss(losses: DataFrame) -> DataFrame:
    return losses.agg(F.avg("loss").alias("loss"))

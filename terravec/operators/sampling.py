"""Per-class samples, average precision, weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravec.operators.points import SEED
from terravec.operators.shared import cut

def class_counts(df: DataFrame, cls: str = "class") -> DataFrame:
    return df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))


def class_ranges(df: DataFrame, cls: list[str], key: list[str], order: Column) -> DataFrame:
    """Adds _o, the order, and _b, the range of (class, order, key) that a row is in. The borders come from a sample of the rows, so
    that neither a large class nor a score that most rows share is one range; checkpointed, as a second run could draw others."""
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.withColumn("_o", order).repartitionByRange(ranges, *cls, "_o", *key).withColumn("_b", F.spark_partition_id()))


def class_ranked(df: DataFrame, cls: str | list[str], key: str | list[str], order: Column) -> DataFrame:
    """Adds _rank from 1 within each class, by (order, key), and _n, its size: rows are ranked within (class, range), and the sizes
    of the class's ranges before are added."""
    cls, key = ([c] if isinstance(c, str) else c for c in (cls, key))
    b = class_ranges(df, cls, key, order)
    sizes = b.groupBy(*cls, "_b").agg(F.count(F.lit(1)).alias("_m"))
    up_to = F.sum("_m").over(Window.partitionBy(*cls).orderBy("_b"))
    before = sizes.withColumns({"_before": up_to - F.col("_m"), "_n": F.sum("_m").over(Window.partitionBy(*cls))}).drop("_m")
    r = b.withColumn("_rank", F.row_number().over(Window.partitionBy(*cls, "_b").orderBy("_o", *key)))
    same = [r[c].eqNullSafe(before[c]) for c in [*cls, "_b"]]
    r = r.join(before, same).select(*(r[c] for c in r.columns if c not in ("_rank", "_o", "_b")), (r["_rank"] + before["_before"]).alias("_rank"), before["_n"])
    return r


def stratified_sample(df: DataFrame, ratio: float, cls: str, key: str, seed: int = SEED, order: Column | None = None) -> DataFrame:
    """Of each class max(1, round(n ratio)) rows, half to even, without replacement."""
    r = class_ranked(df, cls, key, F.xxhash64(F.col(key), F.lit(seed)) if order is None else order)
    return r.filter(F.col("_rank") <= F.greatest(F.lit(1), F.bround(F.col("_n") * ratio, 0))).drop("_rank", "_n")


def balanced_sample(df: DataFrame, per_class: int, cls: str, key: str, replace: bool = False, seed: int = SEED, order: Column | None = None, pick: Column | None = None) -> DataFrame:
    """At most per_class rows of each class; with replacement exactly that many (draw numbers 0.., ``pick`` says which rank)."""
    r = class_ranked(df, cls, key, F.xxhash64(F.col(key), F.lit(seed)) if order is None else order)
    if not replace:
        return r.filter(F.col("_rank") <= per_class).drop("_rank", "_n")
    draws = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n")).select(cls, "_n", F.explode(F.sequence(F.lit(0), F.lit(per_class - 1))).alias("draw"))
    chosen = F.xxhash64(cls, "draw", F.lit(seed)) if pick is None else pick
    return draws.select(cls, "draw", (F.pmod(chosen, F.col("_n")) + 1).alias("_rank")).join(r.drop("_n"), [cls, "_rank"]).drop("_rank")


def average_precision(scored: DataFrame, cls: str = "class", score: str = "score", truth: str = "y_true", key: str = "row_id") -> DataFrame:
    """(cls, ap): precision times the step of recall down the scores of each class, ties by key."""
    r = class_ranked(scored.withColumn("_neg", -F.col(score)), cls, key, F.col("_neg"))
    b = F.floor(F.col("_rank") / 4096)  # running sums by blocks of ranks, for classes of any size
    blocks = r.withColumn("_k", b)
    sums = blocks.groupBy(cls, "_k").agg(F.sum(truth).alias("_s"))
    before = sums.withColumn("_tp0", F.sum("_s").over(Window.partitionBy(cls).orderBy("_k")) - F.col("_s")).withColumn("_all", F.sum("_s").over(Window.partitionBy(cls))).select(cls, "_k", "_tp0", "_all")
    tp = F.sum(truth).over(Window.partitionBy(cls, "_k").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
    run = blocks.withColumn("_tp", tp).join(before, [cls, "_k"]).withColumn("_tp", F.col("_tp") + F.col("_tp0"))
    return run.groupBy(cls).agg(F.sum(F.when(F.col(truth) == 1, F.col("_tp") / F.col("_rank") / F.col("_all")).otherwise(0.0)).alias("ap"))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    return ap.agg(F.avg("ap").alias("map"))


def weighted_mean(df: DataFrame, value: str, weight: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))

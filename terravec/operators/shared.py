"""Lineage cuts, and joins whose keys may be hot."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with over this share of the rows are joined by broadcast: there are 10,000 of them at most.
HOT = 1e-4


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where there is none, a local session gets a temporary one; on a cluster, whose executors
    don't share such a folder, that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has one row for each combination of the keys (null ones meet nothing).

    A combination that many rows of left have isn't one task: the rows of right of such hot ones, few by their share, are
    broadcast, and only the others are shuffled.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most, total = counts.agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if most <= (least := max(1000, HOT * total)):
        return left.join(right, keys, how)
    hot = cut(counts.filter(F.col("_n") > least).drop("_n"))
    few = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    marked = left.join(few, keys, "left")
    some = right.join(F.broadcast(hot), keys, "left_semi")
    return marked.filter("_hot").drop("_hot").join(F.broadcast(some), keys, how).unionByName(marked.filter("_hot IS NULL").drop("_hot").join(right, keys, how))

"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravec.operators.shared import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links of comparable ids -> (node, component), component the smallest id reachable. Nodes without a link are absent.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each is one grouped aggregate over the links, and
    their number is logarithmic. Stars are made by joins on minima, so a huge component needs no list of its members. Links
    are kept as a > b. The minima are checkpointed, so that both sides of a join are plain shuffles, which adaptive execution
    splits where a hub has most of the links.
    """
    e = cut(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: what is linked with b goes to the smallest of b and its neighbours
        least = cut(e.groupBy("a").agg(F.min("b").alias("m")))
        e = cut(e.join(least.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct())
        # small star: a and its smaller neighbours are linked to the smallest of them
        least = cut(e.groupBy("a").agg(F.min("b").alias("m")))
        joined = e.join(least, "a")
        e = cut(joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")

"""Queries that write what they derive from the tables to the shared folder, and read it again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terravec.operators import filters as L
from terravec.operators import points as P
from terravec.operators.shared import shared_dir
from terravec.plans.base import located, points, query, r6, sql_points, table
from terravec.plans.q_points import LONG, long_activations
from terravec.plans.q_splice import reports
from terravec.sources import io

PTS = "WITH " + sql_points()


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}"


@query("S1_K1_points", PTS + " SELECT round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon FROM pts")
def s1(spark, d):
    path = scratch(spark)
    io.write_points(points(spark, d), path)
    return io.read_points(spark, path).select(r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"))


@query("S2_read_places", "WITH " + sql_points("pts", "nation", "n_nationkey", ", n_regionkey") + " SELECT r_name AS place, CAST(point_id AS VARCHAR) AS id, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat FROM pts JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'MIDDLE EAST'")
def s2(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name <> 'MIDDLE EAST'")
    n = located(n, "n_nationkey").select(F.col("r_name").alias("place"), F.col("n_nationkey").cast("string").alias("id"), "lon", "lat")
    root = scratch(spark)
    io.write_places(n, root, sorted(r[0] for r in n.select("place").distinct().collect()))  # regions
    return io.read_places(spark, root).select("place", "id", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"))


@query("S3_K2_geotext", "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 7919) % 10007, doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id FROM p WHERE r > ceil(n * 0.1) AND r <= ceil(n * 0.1) + ceil((n - ceil(n * 0.1)) * 0.1)")
def s3(spark, d):
    docs = located(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    root = scratch(spark)
    io.write_splits(P.split_train_val_test(docs, 0.1, 0.1, "doc_id", order=(F.col("doc_id") * 7919) % 10007), f"{root}/all")
    for s in ("train", "val", "test"):
        spark.read.parquet(f"{root}/all/split={s}").write.parquet(f"{root}/{s}.parquet")
    return io.read_geotext(spark, root, "val").select("doc_id")


@query("S4_read_vocab", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS idx, n_name AS concept FROM nation WHERE n_nationkey >= 15")
def s4(spark, d):
    path = scratch(spark)
    table(spark, d, "nation").orderBy("n_nationkey").select(F.concat(F.lit("  "), "n_name")).coalesce(1).write.text(path)
    return io.read_vocab(spark, path, 10).select(F.col("idx").cast("int").alias("idx"), "concept")


@query("S5_read_concepts", "SELECT CAST(n_nationkey AS INTEGER) AS concept_id, n_name AS concept, 'An image of a ' || n_name AS prompt FROM nation")
def s5(spark, d):
    path = scratch(spark)
    table(spark, d, "nation").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]))).coalesce(1).write.text(path)
    return io.read_concepts(spark, path)


@query("S6_K5_reports", "SELECT l_returnflag AS model, l_linestatus AS dataset, round(avg(l_discount), 6) + 0.0 AS mse FROM lineitem GROUP BY ALL HAVING l_returnflag IN ('N', 'R') AND l_linestatus IN ('F')")
def s6(spark, d):
    root = scratch(spark)
    r = reports(spark, d).filter("dataset = 'F'")
    for m in ("N", "R"):
        io.write_report(r.filter(F.col("model") == m).drop("model", "dataset"), f"{root}/{m}__F.json")
    return io.read_reports(spark, root, ["N", "R"], ["F"]).select("model", "dataset", r6(F.col("mse_mean")).alias("mse"))


@query("S7_read_file_listing", "SELECT n_nationkey, length(n_name) + 1 AS length FROM nation")
def s7(spark, d):
    path = scratch(spark)
    table(spark, d, "nation").select("n_nationkey", "n_name").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    got = io.read_file_listing(spark, path, "*.txt")
    return got.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("bigint").alias("n_nationkey"), "length")


@query("S8_K3_activations", f"WITH {LONG} SELECT 'p' || point_id AS filename, neuron, round(act, 6) + 0.0 AS act FROM ac WHERE neuron < 6 AND point_id IN (SELECT point_id FROM ac WHERE neuron < 6)")
def s8(spark, d):
    wide = L.activations_to_wide(located(long_activations(spark, d, 6), "point_id"), 6, "point_id", "lon", "lat").withColumn("filename", F.concat(F.lit("p"), F.col("point_id").cast("string")))
    path = scratch(spark)
    io.write_activations_wide(wide, path, 6)
    return L.activations_to_long(io.read_activations(spark, path, 6), "filename").select("filename", "neuron", r6(F.col("act")).alias("act"))


@query("K4_write_scores", f"WITH {LONG} SELECT neuron, round(avg(act), 6) + 0.0 AS score FROM ac GROUP BY neuron")
def k4(spark, d):
    path = scratch(spark)
    io.write_scores(long_activations(spark, d).groupBy("neuron").agg(r6(F.avg("act")).alias("score")), path)
    return spark.read.csv(path, header=True, schema="neuron int, score double")

"""Queries of concept decomposition, its reports, vector means and networks."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from terravec.functions import encodings as E
from terravec.functions.arrays import doubles, l2_normalize
from terravec.operators import nets, screening, splice, vectors
from terravec.operators import points as P
from terravec.operators.shared import cut, shared_dir
from terravec.plans.base import entries, located, points, query, r6, sql_entries, sql_points, table
from terravec.plans.q_points import INSIDE, SHAPES

_E = "CAST(embedding AS DOUBLE[])"
_MEANS = f"u AS (SELECT label, list_transform(e, lambda x: x / n) AS e FROM (SELECT label, {_E} AS e, sqrt(list_inner_product({_E}, {_E})) AS n FROM embeddings))"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("embedding"))


@query("A1_vector_mean", f"WITH {_MEANS} SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) + 0.0 AS value FROM (SELECT label, generate_subscripts(e, 1) - 1 AS i, unnest(e) AS x FROM u) GROUP BY ALL")
def a1(spark, d):
    v = _vectors(spark, d).select("label", l2_normalize(F.col("embedding")).alias("u"))
    return entries(vectors.vector_mean(v, "u", "label"), "mean", "label")


@query("A17_geometric_median", None)
def a17(spark, d):
    """The squared distance of each vector to the median of all."""
    v = _vectors(spark, d)
    at = F.array(*map(F.lit, vectors.geometric_median(v, "embedding").tolist()))
    return v.select("vec_id", r6(F.aggregate(F.zip_with("embedding", at, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)).alias("dist2"))


def concepts(spark, d):
    """The mean vector of each label as a concept."""
    v = _vectors(spark, d)
    return vectors.vector_mean(v, "embedding", "label").select(F.col("label").alias("concept_id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("concept"), F.col("mean").alias("embedding"))


@query("U1_build_dictionary", f"""WITH m AS (SELECT label, list(a ORDER BY i) AS e FROM (SELECT label, i, avg(x) AS a FROM (SELECT label, generate_subscripts({_E}, 1) AS i, unnest({_E}) AS x FROM embeddings) GROUP BY ALL) GROUP BY label),
u AS (SELECT label, list_transform(e, lambda x: x / greatest(n, 1e-12)) AS e FROM (SELECT label, e, sqrt(list_inner_product(e, e)) AS n FROM m)),
c AS (SELECT list(a ORDER BY i) AS c FROM (SELECT i, avg(x) AS a FROM (SELECT generate_subscripts(e, 1) AS i, unnest(e) AS x FROM u) GROUP BY i)),
z AS (SELECT label AS concept_id, list_transform(list_zip(e, c), lambda p: p[1] - p[2]) AS e FROM u, c) """ + sql_entries("list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-12))", "z", "concept_id"))
def u1(spark, d):
    return entries(splice.build_dictionary(concepts(spark, d)), "vector", "concept_id")


def encoded(spark, d, solver: str = "admm", **more):
    v = _vectors(spark, d)
    mean = np.array(vectors.vector_mean(v.select(l2_normalize(F.col("embedding")).alias("u")), "u").first()[0])
    return splice.splice_encode(v, splice.build_dictionary(concepts(spark, d)), mean, "vec_id", solver=solver, extra=["label"], **more)


@query("U2_splice_encode")
def u2(spark, d):
    return encoded(spark, d).select("vec_id", "l0", F.round("mse", 5).alias("mse"), F.round("cosine", 4).alias("cosine"))


@query("U3_decompose_admm")
def u3(spark, d):
    return splice.long_weights(encoded(spark, d), "vec_id").select("vec_id", "concept_id", F.round("weight", 4).alias("weight"))


@query("U4_decompose_lasso")
def u4(spark, d):
    return splice.long_weights(encoded(spark, d, "lasso"), "vec_id").select("vec_id", "concept_id", F.round("weight", 4).alias("weight"))


@query("U5_recompose")
def u5(spark, d):
    """Largest difference between the vectors rebuilt from long weights and in the encoding pass."""
    v = _vectors(spark, d)
    mean = np.array(vectors.vector_mean(v.select(l2_normalize(F.col("embedding")).alias("u")), "u").first()[0])
    dictionary = splice.build_dictionary(concepts(spark, d))
    enc = splice.splice_encode(v, dictionary, mean, "vec_id", rebuilt=True)
    again = splice.recompose_long(splice.long_weights(enc, "vec_id"), dictionary, mean, "vec_id").withColumnRenamed("rebuilt", "again")
    gap = F.array_max(F.zip_with("rebuilt", "again", lambda a, b: F.abs(a - b)))
    return enc.join(again, "vec_id").select("vec_id", F.round(gap, 6).alias("gap"))


@query("A3_reconstruction_metrics")
def a3(spark, d):
    m = splice.reconstruction_metrics(encoded(spark, d))
    return m.select("n_samples", *(F.round(c, 4).alias(c) for c in m.columns if c != "n_samples"))


@query("A6_decompose_dataset")
def a6(spark, d):
    return splice.decompose_dataset(encoded(spark, d), "vec_id").withColumn("weight", F.round("weight", 5))


@query("A7_decompose_classes")
def a7(spark, d):
    return splice.decompose_classes(encoded(spark, d), "label", "vec_id").withColumn("weight", F.round("weight", 5))


@query("A8_decompose_regions")
def a8(spark, d):
    """Mean weights over the rows whose points are in each region."""
    at = P.assign_regions(located(encoded(spark, d), "vec_id"), P.polygons_from(spark, SHAPES))
    return splice.decompose_regions(at, "region", "vec_id").withColumn("weight", F.round("weight", 5))


@query("W4_top_concepts")
def w4(spark, d):
    """The flagship: four first concepts of each label."""
    top = splice.top_concepts(splice.decompose_classes(encoded(spark, d), "label", "vec_id"), 4, "label")
    return top.select("label", "rank", "concept_id", F.round("weight", 5).alias("weight"))


# a dictionary of 64 orthonormal concepts of signs and a centre of zero, for which a weight is max(product - lambda / 2, 0)


def signs(spark):
    j = F.expr("sequence(0, 63)")
    return spark.range(64).select(F.col("id").cast("int").alias("concept_id"), F.concat(F.lit("signs "), F.col("id").cast("string")).alias("concept"), F.transform(j, lambda k: (1 - 2 * (F.bit_count(F.col("id").bitwiseAND(k)) % 2)) / 8.0).alias("vector"))


def encoded_by_signs(spark, d, solver: str = "admm", **more):
    return splice.splice_encode(_vectors(spark, d), signs(spark), np.zeros(64), "vec_id", solver=solver, extra=["label"], tol=1e-12, **more)


SIGNS = f"""h AS (SELECT k, list((1 - 2 * (bit_count(k & j) % 2)) / 8.0::DOUBLE ORDER BY j) AS c FROM range(64) AS a(k), range(64) AS b(j) GROUP BY k),
v AS (SELECT vec_id, label, list_transform(e, lambda x: x / n) AS e FROM (SELECT vec_id, label, {_E} AS e, sqrt(list_inner_product({_E}, {_E})) AS n FROM embeddings)),
w AS (SELECT vec_id, label, CAST(k AS INTEGER) AS concept_id, list_inner_product(e, c) - 0.0875 AS weight FROM v, h WHERE list_inner_product(e, c) - 0.0875 > 1e-7),
g AS (SELECT vec_id, count(*) AS l0, sqrt(sum(weight * weight)) AS size, sum(weight * (weight + 0.0875)) AS prod FROM w GROUP BY vec_id),
q AS (SELECT vec_id, label, coalesce(l0, 0) AS l0, coalesce(prod / size, 0) AS cosine, CASE WHEN l0 IS NULL THEN 1 ELSE 2 - 2 * prod / size END / 64 AS mse FROM v LEFT JOIN g USING (vec_id))"""


@query("U2_splice_encode_signs", f"WITH {SIGNS} SELECT vec_id, l0, round(mse, 6) + 0.0 AS mse, round(cosine, 6) + 0.0 AS cosine FROM q")
def u2_signs(spark, d):
    return encoded_by_signs(spark, d).select("vec_id", "l0", r6(F.col("mse")).alias("mse"), r6(F.col("cosine")).alias("cosine"))


@query("U3_decompose_admm_signs", f"WITH {SIGNS} SELECT vec_id, concept_id, round(weight, 6) + 0.0 AS weight FROM w")
def u3_signs(spark, d):
    return splice.long_weights(encoded_by_signs(spark, d), "vec_id").select("vec_id", "concept_id", r6(F.col("weight")).alias("weight"))


@query("U4_decompose_lasso_signs", f"WITH {SIGNS} SELECT vec_id, concept_id, round(weight, 6) + 0.0 AS weight FROM w")
def u4_signs(spark, d):
    return splice.long_weights(encoded_by_signs(spark, d, "lasso"), "vec_id").select("vec_id", "concept_id", r6(F.col("weight")).alias("weight"))


@query("U3_decompose_split_signs", f"WITH {SIGNS} SELECT vec_id, concept_id, round(weight, 6) + 0.0 AS weight FROM w")
def u3_split(spark, d):
    """The dictionary in four parts, no task with all of it."""
    v = cut(_vectors(spark, d).select("vec_id", l2_normalize(F.col("embedding")).alias("v")))
    w = screening.split_weights(v.select(F.col("vec_id").alias("row"), "v"), signs(spark), 64, splice.L1, 1e-12, part_bytes=16 * 64 * 8)
    return w.select(F.col("row").alias("vec_id"), F.inline(F.arrays_zip("names", "w"))).filter("w > 1e-7").select("vec_id", F.col("names").alias("concept_id"), r6(F.col("w")).alias("weight"))


@query("U5_recompose_signs", f"""WITH {SIGNS} SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(sum(weight * c[i]) / any_value(size), 6) + 0.0 AS value FROM w JOIN h ON h.k = w.concept_id JOIN g USING (vec_id), range(1, 65) AS t(i) GROUP BY vec_id, i""")
def u5_signs(spark, d):
    """Vectors rebuilt from long weights."""
    weights = splice.long_weights(encoded_by_signs(spark, d), "vec_id")
    return entries(splice.recompose_long(weights, signs(spark), np.zeros(64), "vec_id"), "rebuilt", "vec_id")


@query("A3_reconstruction_metrics_signs", f"WITH {SIGNS} SELECT count(*) AS n_samples, " + ", ".join(f"round(avg({c}), 6) + 0.0 AS {n}_mean, round(stddev_samp({c}), 6) + 0.0 AS {n}_std" for n, c in (("mse", "mse"), ("cosine_sim", "cosine"), ("mean_active_concepts", "l0"))) + " FROM q")
def a3_signs(spark, d):
    m = splice.reconstruction_metrics(encoded_by_signs(spark, d))
    return m.select("n_samples", *(r6(F.col(c)).alias(c) for c in m.columns if c != "n_samples"))


@query("A6_decompose_dataset_signs", f"WITH {SIGNS} SELECT concept_id, round(sum(weight) / (SELECT count(*) FROM v), 6) + 0.0 AS weight FROM w GROUP BY concept_id")
def a6_signs(spark, d):
    return splice.decompose_dataset(encoded_by_signs(spark, d), "vec_id").withColumn("weight", r6(F.col("weight")))


_BY_LABEL = "b AS (SELECT w.label, concept_id, sum(weight) / any_value(n) AS weight FROM w JOIN (SELECT label, count(*) AS n FROM v GROUP BY label) AS c ON c.label = w.label GROUP BY ALL)"


@query("A7_decompose_classes_signs", f"WITH {SIGNS}, {_BY_LABEL} SELECT label, concept_id, round(weight, 6) + 0.0 AS weight FROM b")
def a7_signs(spark, d):
    return splice.decompose_classes(encoded_by_signs(spark, d), "label", "vec_id").withColumn("weight", r6(F.col("weight")))


@query("A8_decompose_regions_signs", f"WITH {SIGNS}, {sql_points('pts', 'embeddings', 'vec_id')}, {INSIDE}, n AS (SELECT region, count(*) AS n FROM ins GROUP BY region) SELECT region, concept_id, round(sum(weight) / any_value(n), 6) + 0.0 AS weight FROM w JOIN ins ON ins.point_id = w.vec_id JOIN n USING (region) GROUP BY ALL")
def a8_signs(spark, d):
    at = P.assign_regions(located(encoded_by_signs(spark, d), "vec_id"), P.polygons_from(spark, SHAPES))
    return splice.decompose_regions(at, "region", "vec_id").withColumn("weight", r6(F.col("weight")))


@query("W4_top_concepts_signs", f"WITH {SIGNS}, {_BY_LABEL} SELECT label, CAST(rank AS INTEGER) AS rank, concept_id, round(weight, 6) + 0.0 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, concept_id) AS rank FROM b) WHERE rank <= 4")
def w4_signs(spark, d):
    top = splice.top_concepts(splice.decompose_classes(encoded_by_signs(spark, d), "label", "vec_id"), 4, "label")
    return top.select("label", "rank", "concept_id", r6(F.col("weight")).alias("weight"))


def _median_sql(rounds: int) -> str:
    """The mean, and so many rounds of means weighted by the reciprocal of the distance, each a table of one list."""
    out = f"x AS (SELECT vec_id, {_E} AS e FROM embeddings), m0 AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(e[i]) AS a FROM x, range(1, 65) AS t(i) GROUP BY i))"
    for k in range(rounds):
        out += f", d{k} AS (SELECT e, 1 / greatest(list_distance(e, m), 1e-12) AS w FROM x, m{k}), m{k + 1} AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, sum(e[i] * w) / sum(w) AS a FROM d{k}, range(1, 65) AS t(i) GROUP BY i))"
    return out


@query("A17_geometric_median_rounds", f"WITH {_median_sql(3)} SELECT CAST(i AS INTEGER) AS i, round(m[i + 1], 6) + 0.0 AS value FROM m3, range(64) AS t(i)")
def a17_rounds(spark, d):
    """The median of all vectors after three rounds."""
    median = vectors.geometric_median(_vectors(spark, d), "embedding", max_rounds=3, tol=0.0)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(median)], "i int, value double").withColumn("value", r6(F.col("value")))


def reports(spark, d):
    li = table(spark, d, "lineitem")
    names = (("mse", "l_discount"), ("cosine_sim", "l_tax"), ("mean_active_concepts", "l_quantity"))
    return li.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("dataset")).agg(F.lit(0.175).alias("l1_penalty"), *(F.avg(c).alias(f"{n}_mean") for n, c in names), *(F.stddev_samp(c).alias(f"{n}_std") for n, c in names))


def _cell(column: str, dataset: str, decimals: int) -> str:
    return f"coalesce(printf('%.{decimals}f ± %.{decimals}f', avg({column}) FILTER (l_linestatus = '{dataset}'), stddev_samp({column}) FILTER (l_linestatus = '{dataset}')), 'null ± null')"


@query("A4_reconstruction_table", "SELECT l_returnflag AS model, " + ", ".join(f"{_cell(c, ds, p)} AS {ds}_{m}" for ds in ("F", "O") for m, c, p in (("mse", "l_discount", 3), ("cosine_sim", "l_tax", 3), ("mean_active_concepts", "l_quantity", 1))) + " FROM lineitem WHERE l_returnflag IN ('N', 'R', 'A') GROUP BY l_returnflag")
def a4(spark, d):
    t = splice.reconstruction_table(reports(spark, d), ["N", "R", "A"], ["F", "O"], {"mse": 3, "cosine_sim": 3, "mean_active_concepts": 1}, True)
    return t.select("model", *(F.coalesce(F.col(c), F.lit("null ± null")).alias(c) for c in t.columns[1:]))


@query("A5_check_single_lambda", "SELECT l_returnflag AS model, count(DISTINCT l_linestatus) AS datasets FROM lineitem GROUP BY l_returnflag")
def a5(spark, d):
    r = reports(spark, d)
    splice.check_single_lambda(r)
    return r.groupBy("model").agg(F.count_distinct("dataset").alias("datasets"))


# networks with given weights


def _matrix(rows: int, cols: int, seed: int) -> np.ndarray:
    i, j = np.arange(rows)[:, None], np.arange(cols)[None]
    return ((i * 13 + j * 29 + seed) % 31) / 31.0 - 0.5


def _sql_layer(inputs: list[str], rows: int, seed: int, act: str = "{}") -> list[str]:
    w = _matrix(rows, len(inputs), seed)
    return [act.format(" + ".join([*(f"({x}) * ({float(w[i, j])!r})" for j, x in enumerate(inputs)), repr(0.01 * i)])) for i in range(rows)]


def _bias(rows: int) -> np.ndarray:
    return np.arange(rows) * 0.01


_IN = [f"{f}(radians({c}))" for c in ("lon", "lat") for f in ("cos", "sin")]
_UNIT = "list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-12))"


def _net_query(name: str, net, layers: list[tuple[int, int, str]]) -> None:
    """An oracle of one CTE per layer; layers: rows, seed, SQL of the activation."""
    ctes, inputs = ["WITH " + sql_points(), "h0 AS (SELECT point_id, " + ", ".join(f"{s} AS x{k}" for k, s in enumerate(_IN)) + " FROM pts)"], [f"x{k}" for k in range(4)]
    for n, (rows, seed, act) in enumerate(layers):
        ctes.append(f"h{n + 1} AS (SELECT point_id, " + ", ".join(f"{s} AS x{k}" for k, s in enumerate(_sql_layer(inputs, rows, seed, act))) + f" FROM h{n})")
        inputs = [f"x{k}" for k in range(rows)]
    ctes.append(f"o AS (SELECT point_id, [{', '.join(inputs)}] AS e FROM h{len(layers)}) ")

    @query(name, ", ".join(ctes) + sql_entries(_UNIT, "o"))
    def run(spark, d):
        return entries(nets.encode_points(points(spark, d), E.wrap(F.col("lon"), F.col("lat")), net), "location_embedding", "point_id")


_net_query("U8_encode_points_mlp", nets.mlp([(_matrix(6, 4, 3), _bias(6)), (_matrix(5, 6, 7), _bias(5))]), [(6, 3, "greatest({}, 0.0)"), (5, 7, "{}")])
_net_query("U8_encode_points_siren", nets.siren([(_matrix(6, 4, 3), _bias(6)), (_matrix(6, 6, 11), _bias(6)), (_matrix(5, 6, 7), _bias(5))]), [(6, 3, "sin(30.0 * ({}))"), (6, 11, "sin({})"), (5, 7, "{}")])
_net_query("U8_encode_points_linear", nets.linear(_matrix(5, 4, 9), _bias(5)), [(5, 9, "{}")])


_H = _sql_layer([f"h{k}" for k in range(6)], 6, 5, "greatest({}, 0.0)")
U9_SQL = f"""WITH {sql_points("pts", "documents", "doc_id")}, a AS (SELECT point_id, {", ".join(f"{x} AS h{k}" for k, x in enumerate(_sql_layer(_IN, 6, 3, "greatest({}, 0.0)")))} FROM pts),
b AS (SELECT *, {", ".join(f"{x} AS g{k}" for k, x in enumerate(_H))} FROM a), c AS (SELECT point_id, [{", ".join(f"h{k} + {x}" for k, x in enumerate(_sql_layer([f"g{k}" for k in range(6)], 6, 8, "greatest({}, 0.0)")))}] AS e FROM b),
s AS (SELECT point_id, CASE WHEN r <= ceil(n * 0.1) THEN 'test' WHEN r <= ceil(n * 0.1) + ceil((n - ceil(n * 0.1)) * 0.1) THEN 'val' ELSE 'train' END AS split FROM (SELECT point_id, row_number() OVER (ORDER BY (point_id * 7919) % 10007, point_id) AS r, count(*) OVER () AS n FROM pts))
SELECT point_id AS doc_id, split, round(e[1] / greatest(sqrt(list_inner_product(e, e)), 1e-12), 6) + 0.0 AS first, CAST(len(e) AS INTEGER) AS dims FROM c JOIN s USING (point_id)"""


@query("U9_precompute_embeddings", U9_SQL)
def u9(spark, d):
    """Documents at their points, encoded and written by split, and read again."""
    docs = located(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    net = nets.residual_fc((_matrix(6, 4, 3), _bias(6)), [((_matrix(6, 6, 5), _bias(6)), (_matrix(6, 6, 8), _bias(6)))], unit=True)
    path = f"{shared_dir(spark)}/precomputed-{uuid.uuid4().hex}"
    out = nets.precompute_embeddings(docs, E.wrap(F.col("lon"), F.col("lat")), net, path, "doc_id", keep=["doc_id", "lon", "lat", "text"], order=(F.col("doc_id") * 7919) % 10007)
    return out.select("doc_id", "split", r6(F.get("location_embedding", F.lit(0))).alias("first"), F.size("location_embedding").alias("dims"))


@query("U10_project_embeddings", "WITH p AS (SELECT vec_id, [" + ", ".join(_sql_layer([f"CAST(embedding[{j + 1}] AS DOUBLE)" for j in range(64)], 4, 17, "greatest({}, 0.0)")) + "] AS e FROM embeddings) " + sql_entries(_UNIT, "p", "vec_id"))
def u10(spark, d):
    net = nets.Net([nets.Layer(_matrix(4, 64, 17), _bias(4), "relu")])
    return entries(nets.project_embeddings(_vectors(spark, d), net, "embedding"), "projected", "vec_id")


_C = [" + ".join(f"CAST(embedding[{j + 1}] AS DOUBLE) * ({float(_matrix(3, 64, 21)[i, j])!r})" for j in range(64)) for i in range(3)]


@query("U11_class_scores", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS class, round(1 / (1 + exp(-v)), 6) + 0.0 AS score FROM (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS v FROM (SELECT vec_id, [" + ", ".join(_C) + "] AS v FROM embeddings))")
def u11(spark, d):
    return nets.class_scores(_vectors(spark, d), _matrix(3, 64, 21), "embedding", "vec_id").withColumn("score", r6(F.col("score")))


@query("U11_class_score_raw", f"SELECT vec_id, CAST(1 AS INTEGER) AS class, round({_C[1]}, 6) + 0.0 AS score FROM embeddings")
def u11b(spark, d):
    return nets.class_scores(_vectors(spark, d), _matrix(3, 64, 21), "embedding", "vec_id", only=1).withColumn("score", r6(F.col("score")))


@query("M9_layer_norm", f"""WITH s AS (SELECT vec_id, {_E} AS e, list_avg({_E}) AS m FROM embeddings), t AS (SELECT vec_id, e, m, list_avg(list_transform(e, lambda x: (x - m) * (x - m))) AS v FROM s) """ + sql_entries("list_transform(e, lambda x: (x - m) / sqrt(v + 1e-5))", "t", "vec_id"))
def m9(spark, d):
    net = nets.Net([nets.Layer(np.eye(64), np.zeros(64), norm=(np.ones(64), np.zeros(64)))], unit=False)
    return entries(nets.apply_net(_vectors(spark, d), net, "embedding", "v"), "v", "vec_id")

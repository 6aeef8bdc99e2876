"""Every registered query of the library: against its SQL, or that it runs and has rows."""

import numpy as np
import pytest

import __spark_entry__
from terravec.plans import registry
from tests.oracle import SMALL, duck, same

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        same(spark, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["label", "rank", "concept_id", "weight"] and found.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_decomposition_against_brute_force(spark):
    """The queries over the dictionary of label means, against projected gradient steps from their definition."""
    rows = duck("SELECT vec_id, label, embedding FROM embeddings ORDER BY vec_id")
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    e, label = np.stack(rows.embedding.to_list()).astype(float), rows.label.to_numpy()
    names = sorted(set(label))
    u = unit(e)
    means = unit(np.stack([e[label == k].mean(axis=0) for k in names]))
    c = unit(means - means.mean(axis=0))
    v = unit(u - u.mean(axis=0))
    w, step = np.zeros((len(v), len(c))), 0.5 / np.linalg.eigvalsh(c @ c.T).max()
    for _ in range(20_000):
        w = np.maximum(w - step * (2 * (w @ c - v) @ c.T + 0.175), 0)
    again = unit(unit(w @ c) + u.mean(axis=0))
    for name in ("U3_decompose_admm", "U4_decompose_lasso"):
        got = np.zeros_like(w)
        for r in QUERIES[name](spark, SMALL).collect():
            got[np.searchsorted(rows.vec_id, r.vec_id), names.index(r.concept_id)] = r.weight
        assert np.abs(got - w).max() < 1e-3
    active = w > 1e-6
    out = {r.vec_id: r for r in QUERIES["U2_splice_encode"](spark, SMALL).collect()}
    for i, k in enumerate(rows.vec_id):
        assert abs(out[k].mse - ((u[i] - again[i]) ** 2).mean()) < 1e-4 and abs(out[k].cosine - u[i] @ again[i]) < 1e-3 and abs(out[k].l0 - active[i].sum()) <= 1
    assert all(r.gap < 1e-6 for r in QUERIES["U5_recompose"](spark, SMALL).collect())
    m = QUERIES["A3_reconstruction_metrics"](spark, SMALL).first()
    assert m.n_samples == len(u) and abs(m.cosine_sim_mean - (u * again).sum(axis=1).mean()) < 1e-3 and abs(m.mean_active_concepts_mean - active.sum(axis=1).mean()) < 0.1
    whole = {r.concept_id: r.weight for r in QUERIES["A6_decompose_dataset"](spark, SMALL).collect()}
    assert all(abs(whole.get(k, 0) - w[:, j].mean()) < 1e-3 for j, k in enumerate(names))
    by_label = {(a, k): w[label == a, j].mean() for a in names for j, k in enumerate(names)}
    assert all(abs(r.weight - by_label[r.label, r.concept_id]) < 1e-3 for r in QUERIES["A7_decompose_classes"](spark, SMALL).collect())
    for r in QUERIES["W4_top_concepts"](spark, SMALL).collect():
        assert abs(r.weight - sorted((by_label[r.label, k] for k in names), reverse=True)[r["rank"] - 1]) < 1e-3 and abs(r.weight - by_label[r.label, r.concept_id]) < 1e-3

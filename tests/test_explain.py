import numpy as np

from churnspark.operators import split
from churnspark.plans import explain as X
from churnspark.plans import modeling as MD


def test_the_labelled_split_is_dealt_to_every_core(spark, small_dir):
    train, test = MD._parts(spark, small_dir)
    assert train.rdd.getNumPartitions() == test.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_shapley_values_of_trees_are_those_by_transform(spark, small_dir, monkeypatch):
    train, test = MD._parts(spark, small_dir)
    model = MD.fitted(spark, small_dir, "dt")
    rows, background = split.capped_sample(test, 12), split.capped_sample(train, 20)

    def values():
        out = X.sampling_shapley(model, rows, background, draws=7)
        plan = out._jdf.queryExecution().executedPlan().toString()
        return {(r["customerID"], r["i"]): r["phi"] for r in out.collect()}, plan

    trees, plan = values()
    assert "probability" not in plan                # no vector of a step leaves its task
    monkeypatch.setattr(X, "_probability_trees", lambda clf: None)
    plain, _ = values()
    assert trees.keys() == plain.keys() and len(trees) == 12 * len(MD._names(spark, small_dir, "dt"))
    assert max(abs(trees[k] - plain[k]) for k in plain) < 1e-12
    assert any(abs(v) > 1e-3 for v in plain.values())


def _by_orders(z, o):
    """Shapley values by the definition, over all coalitions."""
    from itertools import combinations
    from math import factorial
    m = len(z)
    out = np.zeros(m)
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        for k in range(m):
            for s in combinations(rest, k):
                other = np.prod([o[j] if j in s else z[j] for j in rest])
                out[i] += factorial(k) * factorial(m - k - 1) / factorial(m) * other * (o[i] - z[i])
    return out


def test_path_shares_are_shapley_values(monkeypatch):
    def refuse(*_):
        raise AssertionError("a polynomial for each left-out feature")

    monkeypatch.setattr(X, "math", type("m", (), {"comb": refuse}), raising=False)   # before: m polynomials of m steps each
    for m in (1, 2, 3, 5):
        z = np.random.default_rng(m).random(m)
        z[0] = 0.0
        o = ((np.arange(2**m)[:, None] >> np.arange(m)) & 1).astype(float)
        assert np.allclose(X.path_shares(z, o), [_by_orders(z, row) for row in o], atol=1e-14)


def test_shap_batch_few_and_many_rows_agree():
    """With few rows a leaf's patterns are looked up, with many all of them are tabled."""
    t = dict(left=np.array([1, 3, -1, 5, -1, -1, -1]), right=np.array([2, 4, -1, 6, -1, -1, -1]), feat=np.array([0, 1, -1, 0, -1, -1, -1]),
             thr=np.array([0.6, 0.5, 0, 0.3, 0, 0, 0]), cats=[None] * 7, value=np.array([0, 0, 0.9, 0, 0.4, 0.1, 0.7]), cover=np.array([10.0, 6, 4, 4, 2, 1, 3]))
    x = np.random.default_rng(3).random((50, 2))
    phi = X.shap_batch([t], [1.0], x)
    assert np.allclose(phi, np.concatenate([X.shap_batch([t], [1.0], x[i : i + 1]) for i in range(50)]), atol=1e-15)
    assert np.allclose(phi.sum(axis=1) + X.expected_value(t), X.table_output([t], [1.0], x), atol=1e-12)

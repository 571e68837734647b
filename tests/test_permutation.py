"""Permutation importance: what is permuted, and what comes out."""
import numpy as np

from churnspark.plans import explain as X
from churnspark.plans import learners as L
from churnspark.plans import modeling as MD


def test_a_feature_is_permuted_and_nothing_else(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(700, 3)).round(3)
    rows = [(f"k{i}" if i % 7 else "same", int(i % 2), x[i].tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "key string, label int, x array<double>")
    out = X.permuted_rows(df, 3, 4, 42, "key", 50).collect()
    assert len(out) == 700 * 3 * 4
    again = X.permuted_rows(df.repartition(7), 3, 4, 42, "key", 50).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    want = [sorted(x[:, c].tolist()) for c in range(3)]
    seen = set()
    for j in range(3):
        others = [c for c in range(3) if c != j]
        for rep in range(4):
            mine = [o for o in out if o.j == j and o.r == rep]
            assert sorted(o.x[j] for o in mine) == want[j]
            assert sorted((o.label, *(o.x[c] for c in others)) for o in mine) == sorted((int(i % 2), *(x[i, c] for c in others)) for i in range(700))
            own = {(x[i, others[0]], x[i, others[1]]): x[i, j] for i in range(700)}
            assert sum(own[o.x[others[0]], o.x[others[1]]] == o.x[j] for o in mine) < 70
            seen.add(tuple(sorted((o.x[others[0]], o.x[j]) for o in mine)))
    assert len(seen) == 12


def test_fewer_rows_than_a_block(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("b", 0, [3.0, 4.0])], "key string, label int, x array<double>")
    out = X.permuted_rows(df, 2, 3, 1, "key", 1024).collect()
    assert len(out) == 12 and {v for o in out for v in o.x} == {1.0, 2.0, 3.0, 4.0}


def test_importance_of_used_and_unused_features(spark, small_dir):
    train, test = MD._parts(spark, small_dir)
    model = L.fit("dt", train, overrides={"max_depth": 2})
    used = set(np.flatnonzero(model.stages[-1].featureImportances.toArray()).tolist())
    got = {r.i: r for r in X.permutation_importance(model, train, repeats=6).collect()}
    assert len(got) == len(model.stages[0].feature_names())
    for i, r in got.items():
        if i not in used:
            assert abs(r.importance_mean) < 1e-12 and r.importance_std < 1e-12
    top = max(got.values(), key=lambda r: r.importance_mean)
    assert top.i in used and top.importance_mean > 0.01 and 0 < top.importance_std < top.importance_mean * 3

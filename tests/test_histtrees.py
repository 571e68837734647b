"""Grown trees against a plain grower, one at a time against many, in a task against by steps; the sampler."""
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnspark.plans import explain as X
from churnspark.plans import histtrees as H
from churnspark.plans import learners as L
from churnspark.plans import modeling as MD
from churnspark.plans import tune
from churnspark.plans.histtrees import TreeSpec, fit_specs, forest_output


def table(n=240, p=4, seed=1):
    r = np.random.default_rng(seed)
    x = r.integers(0, 12, size=(n, p)).astype(float)
    y = (r.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 6) / 2 + (x[:, 1] > 7) * 2))).astype(int)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(f"k{i}", int(y[i]), -2, x[i].tolist()) for i in range(len(y))], "customerID string, label int, fold int, x0 array<double>").repartition(5)


def score(spec, g, h, c):
    if spec.criterion == "newton":
        return max(abs(g) - spec.reg_alpha, 0) ** 2 / (h + spec.reg_lambda)
    if spec.criterion == "variance":
        return g * g / c
    if spec.criterion == "gini":
        return -2 * g * (h - g) / h
    return sum(v * math.log2(v / h) for v in (g, h - g) if v > 0)


def plain_boost(spec, x, y):
    """Margins of a grower that looks at every cut of every open node, and splits one node at a time."""
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if spec.balanced else np.ones(len(y))
    prior = (w * y).sum() / w.sum()
    margin = np.full(len(y), math.log(prior / (1 - prior)) if spec.boosted else 0.0)
    gains = []
    for _ in range(spec.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = (w * (p - y), w * p * (1 - p)) if spec.boosted else (w * y, w)

        def best(rows, depth):
            if depth >= spec.max_depth or len(rows) < spec.min_split:
                return None
            out = None
            for f in range(x.shape[1]):
                for cut in sorted(set(x[rows, f]))[:-1]:
                    a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(len(a), len(b)) < spec.min_leaf or min(h[a].sum(), h[b].sum()) < spec.min_hessian:
                        continue
                    gain = score(spec, g[a].sum(), h[a].sum(), len(a)) + score(spec, g[b].sum(), h[b].sum(), len(b)) - score(spec, g[rows].sum(), h[rows].sum(), len(rows))
                    if gain > max(1e-6, spec.min_gain - 1e-12) and (out is None or gain > out[0] + 1e-9):
                        out = (gain, a, b)
            return out

        leaves = [(np.arange(len(y)), 0)]
        known = [best(*leaves[0])]
        while any(known) and (not spec.num_leaves or len(leaves) < spec.num_leaves):
            i = max((i for i, k in enumerate(known) if k), key=lambda i: known[i][0])
            gain, a, b = known.pop(i)
            _, depth = leaves.pop(i)
            gains.append(gain)
            for part in (a, b):
                leaves.append((part, depth + 1))
                known.append(best(part, depth + 1))
        for rows, _ in leaves:
            if spec.boosted:
                t = math.copysign(max(abs(g[rows].sum()) - spec.reg_alpha, 0), g[rows].sum())
                margin[rows] -= spec.learning_rate * t / (h[rows].sum() + spec.reg_lambda)
            else:
                margin[rows] = g[rows].sum() / h[rows].sum()
    return margin, gains


SPECS = [TreeSpec(rounds=3, learning_rate=0.3, max_depth=3, reg_lambda=1.0, min_hessian=1.0, min_gain=0.5),
         TreeSpec(rounds=3, learning_rate=0.3, max_depth=64, num_leaves=9, min_leaf=5, reg_alpha=0.4, reg_lambda=0.5),
         TreeSpec(criterion="variance", rounds=3, learning_rate=0.5, max_depth=4, min_split=20, min_leaf=4),
         TreeSpec(criterion="gini", max_depth=4, min_leaf=6, balanced=True),
         TreeSpec(criterion="entropy", max_depth=5, min_split=30, min_leaf=3)]


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: f"{s.criterion}{s.num_leaves}")
def test_equals_a_plain_grower(spark, spec):
    x, y = table()
    model = fit_specs(frame(spark, x, y), [spec])[0]
    want, gains = plain_boost(spec, x, y)
    assert np.allclose(forest_output(model.forest, x), want, atol=1e-5)
    got = sorted(v for t in model.forest["trees"] for v in t["gain"] if v > 0)
    assert np.allclose(got, sorted(gains), rtol=1e-4, atol=1e-4)


DRAWN = [TreeSpec(rounds=5, learning_rate=0.3, max_depth=4, reg_lambda=1.0, subsample=0.7, colsample=0.5, seed=3),
         TreeSpec(rounds=4, learning_rate=0.3, max_depth=3, symmetric=True, reg_lambda=3.0, temperature=1.0),
         TreeSpec(criterion="variance", rounds=40, learning_rate=0.8, max_depth=3, val_share=0.25, patience=3),
         TreeSpec(criterion="gini", max_depth=6, node_features="sqrt", min_leaf=3)]


def test_together_alone_and_by_steps_are_the_same(spark, monkeypatch):
    rows = frame(spark, *table(900)).cache()
    specs = SPECS + DRAWN
    together = [m.forest for m in fit_specs(rows, specs)]
    assert [fit_specs(rows, [s])[0].forest for s in DRAWN] == together[len(SPECS):]
    monkeypatch.setattr(H, "BLOCK_ROWS", 200)     # several blocks: a job for each step
    monkeypatch.setattr(H, "REFRESH", 3)
    monkeypatch.setattr(H, "CHECKPOINT", 2)
    monkeypatch.setattr(H, "CELLS_PER_JOB", 150)
    assert [m.forest for m in fit_specs(rows, specs)] == together
    stopped = together[len(SPECS) + 2]["trees"]
    assert 3 < len(stopped) < 40


def test_a_task_keeps_what_a_tree_does_not_change(monkeypatch):
    """Derivatives are taken once a tree, and of two children one is counted."""
    x, y = table(900)
    cuts = [np.unique(np.quantile(c, np.arange(1, 16) / 16)) for c in x.T]
    codes = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
    layouts = [H._layout(cuts)]
    block = dict(key=[str(i) for i in range(900)], y=y.astype(float), fold=np.full(900, -2), id=np.arange(900, dtype=np.uint64), codes=[codes], joint=[H._joint(codes, layouts[0])], margin={})
    grow = H._TaskGrower(block, layouts, [cuts], {(-2, 0): int((y == 0).sum()), (-2, 1): int((y == 1).sum())})
    grow.add(TreeSpec(rounds=6, learning_rate=0.3, max_depth=4, reg_lambda=1.0, subsample=0.8))
    calls, rows, plain = [], [], H._derivatives
    monkeypatch.setattr(H, "_derivatives", lambda *a: calls.append(1) or plain(*a))
    count = H.np.bincount
    monkeypatch.setattr(H.np, "bincount", lambda cell, *a, **k: rows.append(len(cell)) or count(cell, *a, **k))
    grow.run()
    assert len(calls) == 6
    assert sum(rows) < 0.75 * 6 * 4 * 720 * 3 * len(layouts[0].bundles)


MANY = [*SPECS, *DRAWN, TreeSpec(rounds=2, max_depth=12, learning_rate=0.5, balanced=True, held_out=1), TreeSpec(criterion="entropy", max_depth=12, held_out=0)]


@pytest.mark.parametrize("own", [50, 10**6])
def test_a_task_with_many_rows_grows_the_same_trees(monkeypatch, own):
    """Rows dealt to nodes, pairs of bundles and leaf masks against the plain task grower."""
    r = np.random.default_rng(4)
    n = 3000
    x = np.concatenate([r.random((n, 3)) * 100, r.integers(0, 9, (n, 1)), r.random((n, 14)) < 0.3], axis=1).astype(float)
    y = (r.random(n) < 0.1 + 0.3 * (x[:, 0] > 60) + 0.3 * x[:, 5]).astype(float)
    cuts = [np.unique(np.quantile(c, np.arange(1, 64) / 64, method="lower")) for c in x.T]
    cuts = [c[c < v.max()] for c, v in zip(cuts, x.T)]
    codes = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
    layouts, fold = [H._layout(cuts)], np.arange(n) % 3
    block = dict(key=None, y=y, fold=fold, id=np.arange(n, dtype=np.uint64), codes=[codes], joint=[H._joint(codes, layouts[0])], margin={})
    counts = {(f, v): int(((fold == f) & (y == v)).sum()) for f in range(3) for v in (0, 1)}
    monkeypatch.setattr(H, "OWN_ROWS", own)
    monkeypatch.setattr(H, "DEALT", 700)
    monkeypatch.setattr(H, "CHUNK", 900)
    for spec in MANY:
        monkeypatch.setattr(H, "MANY_ROWS", 10**9)
        trees, scores = H._grow_whole(block, spec, layouts, [cuts], counts)
        monkeypatch.setattr(H, "MANY_ROWS", 0)
        again, many = H._grow_whole(block, spec, layouts, [cuts], counts)
        assert again == trees and np.array_equal(many, scores) and (spec.held_out is None or len(scores) == 1000)
    assert max(len(t["feature"]) for t in trees) > 511        # more leaves than masks are made for


def test_many_boosted_models_take_one_job(spark, monkeypatch):
    """Rows of several blocks: a job for each level of each round before, one for all models now; the same trees and scores."""
    from pyspark import RDD
    rows = frame(spark, *table(900)).withColumn("fold", F.pmod(F.xxhash64("customerID"), F.lit(3)).cast("int")).cache()
    monkeypatch.setattr(H, "BLOCK_ROWS", 200)
    jobs, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda rdd: jobs.append(1) or collect(rdd))
    found = []
    for held in (0, 8):
        monkeypatch.setattr(H, "HELD_BLOCKS", held)
        grow = H.grower(rows, 1, 3, H.MAX_BINS, 6)
        numbers = [grow.add(TreeSpec(rounds=6, learning_rate=0.3, max_depth=3, subsample=0.8, held_out=f)) for f in range(3)]
        jobs.clear()
        grow.run()
        found.append((len(jobs), [grow.forest(i) for i in numbers], sorted((r["customerID"], r["model"], r["label"], r["score"]) for r in grow.held_out_scores(spark, numbers).collect())))
        grow.release()
    assert found[0][1:] == found[1][1:] and len(found[1][2]) == 900
    assert found[0][0] >= 18 and found[1][0] == 1


def test_rows_of_a_tenth_gigabyte_are_one_block(spark):
    rows = spark.range(72_000).select(F.col("id").cast("string").alias("customerID"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.lit(-2).alias("fold"), F.array(F.col("id") % 7 + 0.0).alias("x0"))
    grow = H.grower(rows)
    try:
        assert isinstance(grow, H._WholeGrower)
    finally:
        grow.release()


def test_symmetric_trees_split_a_level_alike(spark):
    tree = fit_specs(frame(spark, *table()), [TreeSpec(symmetric=True, max_depth=3, reg_lambda=1.0)])[0].forest["trees"][0]
    level = [0]
    while tree["feature"][level[0]] >= 0:
        assert len({(tree["feature"][n], tree["threshold"][n]) for n in level}) == 1
        level = [k for n in level for k in (tree["left"][n], tree["right"][n])]
    assert len(level) == 8


def test_held_out_scores_are_those_of_models_without_the_fold(spark, monkeypatch):
    x, y = table(300)
    rows = frame(spark, x, y).withColumn("fold", F.pmod(F.xxhash64("customerID"), F.lit(3)).cast("int")).cache()
    fold = {r["customerID"]: r["fold"] for r in rows.collect()}
    spec = TreeSpec(rounds=4, learning_rate=0.3, max_depth=3)
    for blocks in (10**6, 100):
        monkeypatch.setattr(H, "BLOCK_ROWS", blocks)
        grow = H.grower(rows, 1, 3)
        numbers = {grow.add(H.replace(spec, held_out=f)): f for f in range(3)}
        grow.run()
        got = {r["customerID"]: (numbers[r["model"]], r["fold"], r["score"]) for r in grow.held_out_scores(spark, list(numbers)).collect()}
        models = {f: grow.forest(i) for i, f in numbers.items()}
        grow.release()
        assert len(got) == 300
        for i in range(300):
            of, f, s = got[f"k{i}"]
            assert of == f == fold[f"k{i}"]
            assert abs(s - 1 / (1 + math.exp(-forest_output(models[f], x[i : i + 1])[0]))) < 1e-9


def test_one_class_constant_features_and_bad_labels(spark):
    x, y = np.ones((30, 2)), np.zeros(30, int)
    model = fit_specs(frame(spark, x, y), [TreeSpec(rounds=2)])[0]
    assert all(len(t["feature"]) == 1 for t in model.forest["trees"]) and forest_output(model.forest, x)[0] < -5
    with pytest.raises(ValueError):
        fit_specs(frame(spark, x, y + 2), [TreeSpec()])


@pytest.fixture(scope="module")
def parts(spark, small_dir):
    return MD._parts(spark, small_dir)


@pytest.mark.parametrize("key", ["xgb", "lgbm", "cat", "decision_tree_gini"])
def test_learners_score_explain_and_persist(spark, parts, key, tmp_path):
    from churnspark.sources import io
    train, test = parts
    model = L.fit(key, train, overrides={} if key.startswith("dec") else {"n_estimators" if key != "cat" else "iterations": 6})
    phi, base, space = X.tree_shap(model, test)
    for r in phi.collect():
        assert abs(base + sum(r.phi) - r.output) < 1e-9
    io.save_model(model, str(tmp_path / "m"))
    again = io.load_model(str(tmp_path / "m"))
    a, b = (sorted(map(tuple, L.score(m, test, keep=["customerID"]).collect())) for m in (model, again))
    assert a == b and all(0 <= s <= 1 for _, s in a)
    imp = X.model_importances(model, model.stages[0].feature_names()).collect()
    assert abs(sum(r.importance for r in imp) - 1) < 1e-9


def test_no_boosting_parameter_is_ignored():
    for key, (kind, params) in L.catalogue().items():
        if kind in L.GROWN:
            assert set(L.to_tree_spec(kind, params)[2]) <= {"random_strength"}, key
    spec, bins, _ = L.to_tree_spec("lgbm", L.catalogue()["lgbm_tuned"][1])
    assert (spec.num_leaves, spec.min_leaf, spec.min_gain, spec.reg_alpha, spec.reg_lambda, spec.subsample, spec.colsample) == (31, 50, 0.01, 0.1, 1.0, 0.7, 0.7)
    spec, bins, _ = L.to_tree_spec("cat", L.catalogue()["cat_tuned"][1])
    assert spec.symmetric and spec.max_depth == 12 and spec.reg_lambda == 3.0 and spec.temperature == 1.0 and bins == 129
    spec, _, _ = L.to_tree_spec("split_tree", dict(L.catalogue()["decision_tree_entropy"][1]))
    assert (spec.criterion, spec.node_features, spec.min_split, spec.balanced) == ("entropy", "sqrt", 100, True)


def test_search_on_all_folds_at_once_equals_fits_fold_by_fold(spark, parts):
    from churnspark.operators import metrics as M
    train, _ = parts
    combos = tune.grid_combos({"max_depth": [2, 5], "min_samples_split": [10, 60], "max_features": [None]})
    result, _ = tune.grid_search("decision_tree_gini", train, {"max_depth": [2, 5], "min_samples_split": [10, 60], "max_features": [None]}, k=3)
    folded = tune.with_folds(train, 3)
    for i in (0, 3):
        per = []
        for f in range(3):
            model = L.fit("decision_tree_gini", folded.where(F.col("fold") != f).drop("fold"), overrides=combos[i])
            per.append(M.metric_table(L.score(model, folded.where(F.col("fold") == f), keep=["label"])).first()["roc_auc"])
        assert abs(np.mean(per) - result.avgMetrics[i]) < 1e-9
    table = tune.results_table(spark, result, combos)
    assert table.count() == 4


def surface(p):
    return -((math.log(p["learning_rate"]) - math.log(0.07)) ** 2) - ((p["max_depth"] - 6) / 3) ** 2 - 4 * (p["subsample"] - 0.8) ** 2 - 4 * (p["colsample_bytree"] - 0.9) ** 2


def test_sampler_is_seeded_and_better_than_random():
    space = tune.SEARCH_SPACES["xgb"]

    def best(seed, model_based):
        s = tune.ParzenSampler(space, seed)
        for i in range(40):
            p = s.ask(model_based and i >= 10)
            for name, (kind, lo, hi) in space.items():
                assert lo <= p[name] <= hi and (kind != "int" or isinstance(p[name], int))
            s.tell(p, surface(p))
        return max(v for _, v in s.trials), s.trials

    assert best(1, True) == best(1, True)
    model, plain = ([best(s, m)[0] for s in range(30)] for m in (True, False))
    assert np.mean(model) > np.mean(plain) and sum(a > b for a, b in zip(model, plain)) >= 19


def test_places_of_values_in_a_range():
    r = random.Random(1)
    for kind, lo, hi in (("int", 3, 8), ("log", 0.01, 0.2), ("float", 0.6, 1.0)):
        for _ in range(50):
            v = tune._at(kind, lo, hi, r.random())
            assert math.isclose(tune._at(kind, lo, hi, tune._place(kind, lo, hi, v)), v)


def test_model_search_returns_a_trial_for_each_draw(spark, parts):
    train, _ = parts
    space = {"n_estimators": ("int", 2, 6), "max_depth": ("int", 1, 3), "learning_rate": ("log", 0.05, 0.5)}
    best, trials = tune.model_search("xgb", train, n_trials=7, space=space, at_once=4)
    assert len(trials) == 7 and best == max(trials, key=lambda t: t[1])[0]
    params, ap = trials[0]
    folded = tune.with_folds(train, 3)
    from churnspark.operators import metrics as M
    again = M.curve_summary(tune.out_of_fold("xgb", folded, 3, params, folded=True)).first()["pr_auc"]
    assert abs(again - ap) < 1e-9


def test_no_histogram_comes_to_the_driver(spark, monkeypatch):
    """What a step brings to the driver does not grow with the number of bins or blocks."""
    import pickle

    from pyspark import RDD
    monkeypatch.setattr(H, "BLOCK_ROWS", 100)
    sizes, collect = [], RDD.collect

    def measured(rdd):
        out = collect(rdd)
        sizes.append(len(pickle.dumps(out, -1)))
        return out

    x = np.random.default_rng(5).normal(size=(600, 6))
    rows = frame(spark, x, table(600)[1]).cache()
    grow = H.grower(rows, 1, 4, 64)
    try:
        for seed in range(4):
            grow.add(TreeSpec(criterion="gini", max_depth=4, seed=seed))
        monkeypatch.setattr(RDD, "collect", measured)
        grow.run()
    finally:
        monkeypatch.undo()
        cells = sum(len(c) + 1 for c in grow.thresholds[0])
        grow.release()
    nodes = 4 * 2**3                              # of a step at most
    assert cells > 100 and 0 < max(sizes) < nodes * 3 * 8 * cells / 4

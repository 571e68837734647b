import random

import numpy as np
from pyspark.sql import functions as F

from churnspark.operators import metrics as M


def _frame(spark, n=800, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = 1 if rng.random() < 0.3 else 0
        s = min(1.0, max(0.0, round(rng.random() * 0.6 + 0.3 * y, 2)))
        rows.append((str(i), y, s))
    return spark.createDataFrame(rows, "customerID string, label int, score double"), rows


def test_auc_equals_pair_count(spark):
    df, rows = _frame(spark)
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    pairs = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    got = M.curve_summary(df).first()
    assert abs(got["roc_auc"] - pairs) < 1e-12


def test_average_precision_brute_force(spark):
    df, rows = _frame(spark)
    P = sum(y for _, y, _ in rows)
    ap = 0.0
    for t in sorted({s for _, _, s in rows}, reverse=True):
        tp = sum(1 for _, y, s in rows if s >= t and y == 1)
        fp = sum(1 for _, y, s in rows if s >= t and y == 0)
        tp_s = sum(1 for _, y, s in rows if s == t and y == 1)
        ap += tp_s / P * tp / (tp + fp)
    assert abs(M.curve_summary(df).first()["pr_auc"] - ap) < 1e-12


def test_sweep_equals_brute_force(spark):
    df, rows = _frame(spark)
    thr = np.linspace(0, 1, 100)
    sw = {r["i"]: r for r in M.threshold_sweep(df).collect()}
    for i, t in enumerate(thr):
        tp = sum(1 for _, y, s in rows if s >= t and y == 1)
        fp = sum(1 for _, y, s in rows if s >= t and y == 0)
        assert sw[i]["threshold"] == t
        assert (sw[i]["tp"], sw[i]["fp"]) == (tp, fp)
        assert sw[i]["tp"] + sw[i]["fp"] + sw[i]["tn"] + sw[i]["fn"] == len(rows)


def test_histogram_matches_numpy(spark):
    df, rows = _frame(spark)
    h = {(r["label"], r["bin"]): r for r in M.histogram_by_class(df).collect()}
    for y in (0, 1):
        vals = np.array([s for _, yy, s in rows if yy == y])
        cnt, edges = np.histogram(vals, bins=50)
        dens, _ = np.histogram(vals, bins=50, density=True)
        for b in range(50):
            assert h[(y, b)]["count"] == cnt[b]
            assert abs(h[(y, b)]["density"] - dens[b]) < 1e-9
            assert h[(y, b)]["bin_left"] == edges[b]


def test_degenerate_inputs(spark):
    one = spark.createDataFrame([("a", 1, 0.3), ("b", 1, 0.3)], "customerID string, label int, score double")
    r = M.metric_table(one).first()
    assert r["roc_auc"] is None and r["precision"] == 0.0 and r["f1"] == 0.0
    assert M.best_pr_threshold(one).first()["threshold"] == 0.3

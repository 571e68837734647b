import numpy as np
from churnspark.llm import hardneg
from churnspark.llm.hardneg import descend, hard_negatives, read_tree, tree_paths
from pyspark.sql import functions as F


def brute(rows, every):
    good = [(i, g, [int(np.floor(256 * np.float64(x))) for x in v]) for i, g, v in rows
            if i is not None and g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, g, v in good:
        if i % every == 0 and (i not in anchors or (str(g), np.array(v, "<f8").tobytes()) < anchors[i][2]):
            anchors[i] = (g, v, (str(g), np.array(v, "<f8").tobytes()))
    out = []
    for a, (g, q, _) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(q, v, strict=True)), i, h == g) for i, h, v in good if i != a and len(v) == len(q)]
        scored.sort()
        for s, p, _ in [z for z in scored if z[2]][:5]:
            hard = [(n, i) for n, i, same in scored if not same and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(hard)]
    return sorted(out)


def check(spark, rows, every=5):
    t = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    got = hard_negatives(t, t.filter(F.col("vec_id") % every == 0)).collect()
    keys = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r[k] for k in keys) for r in got) == brute(rows, every)


def spread(n, seed, dims=8, labels=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims))
    return [(i, int(r.integers(labels)), (centres[r.integers(12)] + 0.15 * r.normal(size=dims)).tolist()) for i in range(n)]


def test_clusters(spark):
    check(spark, spread(400, 1), 20)


def test_small_chunks_leaves_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "CHUNK", 25)
    monkeypatch.setattr(hardneg, "LEAF", 3)
    monkeypatch.setattr(hardneg, "SAMPLE", 40)
    monkeypatch.setattr(hardneg, "CENTRES", 5)
    monkeypatch.setattr(hardneg, "BLOCK_NUMBERS", 60)
    check(spark, spread(200, 2), 10)


def test_ties_copies_and_invalid_rows(spark):
    rows = spread(120, 3) + [(500 + i, i % 3, [0.5] * 8) for i in range(80)]  # all tie
    rows += [(2000, None, [1.0] * 8), (2005, 1, None), (2010, 1, [None] + [1.0] * 7), (2015, 1, [float("nan")] * 8), (2020, 1, [float("inf")] * 8), (None, 1, [1.0] * 8),
             (3000, 1, [1.0, 2.0]), (3001, 1, [1.0, 2.0]), (3002, 2, [1.0, 1.2]), (3005, 1, []), (3006, 1, [])]
    rows += [(4000, 1, [0.0] * 8), (5, 2, [0.4] * 8), (7, 0, [0.2] * 8)]  # a zero anchor, ids that repeat
    check(spark, rows, 5)


def test_large_numbers_stay_exact(spark):
    check(spark, [(i, i % 2, [2.0**18 + i, 2.0**17 - 3 * i, float(i)]) for i in range(60)], 10)


def test_bounds_hold_and_prune():
    r = np.random.default_rng(4)
    x = np.floor(256 * np.concatenate([c + 0.02 * r.normal(size=(60, 16)) for c in r.normal(size=(20, 16))]))
    norms = (x * x).sum(axis=1)
    paths = tree_paths(np.concatenate([x, np.sqrt(norms.max() - norms)[:, None]], axis=1))
    tree = read_tree(np.arange(len(x)), x, paths)
    assert sorted(np.concatenate(tree.rows).tolist()) == list(range(len(x)))
    q = x[::40]
    scores = q @ x.T

    def look(least):
        def wanted(a, low, high):
            return high >= least[a]
        return descend(tree, q, wanted)

    a, leaf, high = look(np.full(len(q), -np.inf))
    for i, l, h in zip(a, leaf, high, strict=True):
        assert scores[i, tree.rows[l]].max() <= h
    tenth = np.sort(scores, axis=1)[:, -10]
    kept = sum(len(tree.rows[l]) for l in look(tenth)[1])
    assert kept < 0.25 * scores.size  # rows scored, of all


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert hard_negatives(none, none).count() == 0
    t = spark.createDataFrame([(0, 1, [1.0], 9, 9), (1, 1, [1.0], 9, 9), (2, 2, [0.75], 9, 9)], "vec_id long, label int, embedding array<double>, id long, rank int")
    got = hard_negatives(t, t.filter("vec_id = 0")).collect()
    assert [(r["positive_id"], r["negative_id"]) for r in got] == [(1, 2)]
    assert hard_negatives(t, t.limit(0)).count() == 0

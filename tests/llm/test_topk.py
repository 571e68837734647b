import numpy as np
from churnspark.llm.topk import exact_top_k
from pyspark.sql import functions as F


def brute(rows, k):
    good = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, asked = [], set()
    for i, q in good:
        if i % 100 or i in asked:
            continue
        asked.add(i)
        scores = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in good if j != i and len(c) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def check(spark, rows, k):
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = exact_top_k(t, t.filter(F.col("vec_id") % 100 == 0), k).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, k)


def test_ties_copies_and_invalid_vectors(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=6).round(2).tolist()) for i in range(420)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]  # all tie
    rows += [(2000, None), (2001, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2100, [float("inf")] * 6), (None, [1.0] * 6),
             (3000, [1.0, 2.0]), (3001, [1.0, -2.0]), (3100, []), (3101, [])]
    rows += [(4000, [0.0] * 6), (5, [9.0] * 6)]  # a zero query ties with all; an id that repeats
    check(spark, rows, 10)


def test_fewer_candidates_than_k_and_empty_table(spark):
    check(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], 10)
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert exact_top_k(none, none).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(i, [2.0**20 + i, -(2.0**19), float(i)]) for i in range(120)]
    check(spark, rows, 5)

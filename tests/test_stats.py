import random

import numpy as np
from pyspark.sql import functions as F

from churnspark.functions import stats


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(7)
    vals = [round(rng.gauss(0, 1), 2) for _ in range(3000)] + [0.5] * 500 + [None] * 10
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.1, 0.4, 0.5, 0.7, 0.9, 1.0]
    got = stats.exact_quantiles(df, "x", probs, accuracy=200, max_candidates=50)
    clean = np.array([v for v in vals if v is not None])
    want = np.quantile(clean, probs)
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_exact_quantiles_empty_and_single(spark):
    e = spark.createDataFrame([(None,)], "x double")
    assert stats.exact_quantiles(e, "x", [0.5]) == [None]
    one = spark.createDataFrame([(3.0,)], "x double")
    assert stats.exact_quantiles(one, "x", [0.1, 0.9]) == [3.0, 3.0]


def test_modes_ties_to_smallest(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("b", 1), ("a", 1), (None, None)],
                               "s string, i int")
    assert stats.modes(df, ["s", "i"]) == {"s": "a", "i": 1}


def test_exact_quantiles_heavy_ties_use_counts_only(spark):
    # two values each hold a third of the rows; a candidate cap of 5 forces the
    # count-only bisection for ranks inside the tied blocks
    rng = random.Random(11)
    vals = [1.0] * 1200 + [2.5] * 1200 + [rng.uniform(-5, 5) for _ in range(1200)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.05, 0.3, 0.5, 0.66, 0.95]
    got = stats.exact_quantiles(df, "x", probs, accuracy=50, max_candidates=5)
    want = np.quantile(np.array(vals), probs)
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_bisect_rank_matches_sorted(spark):
    vals = [3.0] * 50 + [7.0] * 30 + [1.0, 2.0, 9.0]
    df = spark.createDataFrame([(v,) for v in vals], "_x double")
    srt = sorted(vals)
    for k in (0, 1, 2, 40, 52, 53, 79, 82):
        assert stats._bisect_rank(df, k, min(vals), max(vals)) == srt[k]

"""Explanations (H-items) that are pure DataFrame work.

* linear scorecard contributions phi_j = w_j * (x_j - mean_j)  (exact Shapley
  values of a linear model with independent features);
* global importance (H4), per-row top contributors (H5), dependence (H6),
  wide -> named frames (H9), beeswarm rows (H8), learner importances (H10).

Tree SHAP, sampling Shapley and permutation importance live in
:mod:`churnspark.plans.explain` because they need a fitted model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.functions import stats

# Scorecard used by the explanation queries (weights per engineered feature).
SCORECARD = {
    "tenure": -0.03,
    "MonthlyCharges": 0.02,
    "TotalCharges": -0.0002,
    "Contract": -0.6,
    "NumServices": -0.1,
    "SeniorCitizen": 0.4,
    "PaperlessBilling": 0.3,
    "AvailingInternetService": 0.5,
}


def fit_means(df: DataFrame, features) -> dict:
    return stats.column_means(df, list(features))


def linear_contributions(df: DataFrame, weights: dict | None = None, means: dict | None = None,
                         key: str = S.KEY, prefix: str = "phi_") -> DataFrame:
    """Wide frame: key, each feature value and ``phi_<feature>`` = w * (x - mean)."""
    weights = weights or SCORECARD
    feats = list(weights)
    means = means if means is not None else fit_means(df, feats)
    cols = [F.col(key)]
    for f in feats:
        x = F.col(f).cast("double")
        cols.append(x.alias(f))
        cols.append((F.lit(float(weights[f])) * (x - F.lit(float(means[f])))).alias(prefix + f))
    return df.select(*cols)


def to_long(wide: DataFrame, features, key: str = S.KEY, prefix: str = "phi_") -> DataFrame:
    """Long form (key, feature, feature_value, contribution) via one ``stack``."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("feature_value"),
                 F.col(prefix + f).alias("contribution"))
        for f in features
    ])).alias("p")
    return wide.select(key, pairs).select(key, "p.feature", "p.feature_value", "p.contribution")


def global_importance(long: DataFrame, top_n: int = 20) -> DataFrame:
    """H4: mean |contribution| per feature, top ``top_n`` (ties by name)."""
    return long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance")) \
        .orderBy(F.col("importance").desc(), F.col("feature").asc()).limit(top_n)


def dependence(wide: DataFrame, feature: str | None = None, color: str | None = None,
               features=None, key: str = S.KEY, prefix: str = "phi_") -> DataFrame:
    """H6: (value, contribution) of one feature coloured by another.

    Defaults: the most important feature, coloured by the second.
    """
    if feature is None or color is None:
        feats = list(features or [c[len(prefix):] for c in wide.columns if c.startswith(prefix)])
        ranked = [r["feature"] for r in global_importance(to_long(wide, feats, key, prefix),
                                                          top_n=2).collect()]
        feature = feature or ranked[0]
        color = color or (ranked[1] if len(ranked) > 1 else None)
    cols = [key, F.lit(feature).alias("feature"), F.col(feature).cast("double").alias("feature_value"),
            F.col(prefix + feature).alias("contribution")]
    if color:
        cols += [F.lit(color).alias("color_feature"), F.col(color).cast("double").alias("color_value")]
    return wide.select(*cols)


def to_named_frame(df: DataFrame, vector_col: str, names=None, keep=()) -> DataFrame:
    """H9: vector/array column -> one named column per slot (``f0..fn`` by default)."""
    from pyspark.ml.functions import vector_to_array
    first = df.select(vector_col).first()
    size = len(first[0]) if first is not None else len(names or [])
    names = list(names) if names else [f"f{i}" for i in range(size)]
    arr = vector_to_array(F.col(vector_col)) if \
        df.schema[vector_col].dataType.typeName() != "array" else F.col(vector_col)
    d = df.select(*keep, arr.alias("_a"))
    return d.select(*keep, *[F.col("_a")[i].alias(n) for i, n in enumerate(names)])


def beeswarm_rows(long: DataFrame, sample_keys: DataFrame, top_n: int = 20,
                  key: str = S.KEY) -> DataFrame:
    """H8: contributions of sampled rows restricted to the top features (semi-joins)."""
    top = global_importance(long, top_n).select("feature")
    return long.join(F.broadcast(top), "feature", "left_semi") \
        .join(sample_keys.select(key), key, "left_semi")

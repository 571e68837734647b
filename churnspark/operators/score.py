"""Scoring helpers (V1-V3) and soft voting over score columns."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S


def positive_probability(prob_col: str = "probability") -> Column:
    """V1: P(class 1) from a Spark ML probability vector."""
    return vector_to_array(F.col(prob_col))[1]


def fit_minmax(df: DataFrame, col: str) -> tuple:
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return r["lo"], r["hi"]


def minmax_expr(col: str, lo, hi) -> Column:
    """V2 transform: (z - lo) / (hi - lo); 0 when the margin is constant (or unfitted)."""
    if lo is None or hi is None or not hi > lo:
        return F.lit(0.0)
    return (F.col(col) - F.lit(float(lo))) / F.lit(float(hi) - float(lo))


def minmax_score(df: DataFrame, col: str, out: str = "score", bounds=None) -> DataFrame:
    """V2: margin -> [0, 1] by min-max over the batch (or fit-time ``bounds``)."""
    lo, hi = bounds if bounds is not None else fit_minmax(df, col)
    return df.withColumn(out, minmax_expr(col, lo, hi))


def threshold_label(df: DataFrame, score: str = "score", threshold: float = S.DEFAULT_THRESHOLD,
                    out: str = "prediction") -> DataFrame:
    """V3: prediction = score >= threshold."""
    return df.withColumn(out, (F.col(score) >= F.lit(float(threshold))).cast("int"))


def soft_vote(df: DataFrame, score_cols, out: str = "vote_score") -> DataFrame:
    """Mean of the members' probabilities as one row expression."""
    cols = [F.col(c) for c in score_cols]
    return df.withColumn(out, reduce(lambda a, b: a + b, cols) / F.lit(float(len(cols))))

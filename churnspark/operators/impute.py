"""Imputation (F3-F5): fit statistics once, fill with ``coalesce`` literals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark.functions import stats

STRATEGIES = ("mean", "median", "most_frequent")


def fit_impute(df: DataFrame, cols, strategy: str) -> dict:
    """Fill value per column.  median: exact selection; mean: one aggregate;
    most_frequent: one grouped count (ties -> smallest value)."""
    cols = list(cols)
    if strategy == "mean":
        return stats.column_means(df, cols)
    if strategy == "median":
        return {c: stats.exact_median(df, c) for c in cols}
    if strategy == "most_frequent":
        return stats.modes(df, cols)
    raise ValueError(f"unknown imputation strategy {strategy!r}; use one of {STRATEGIES}")


def apply_impute(df: DataFrame, fills: dict, suffix: str = "") -> DataFrame:
    """Replace NULL (and NaN for doubles) by the fitted value."""
    new = {}
    for c, v in fills.items():
        if v is None:
            continue
        col = F.col(c)
        if df.schema[c].dataType.typeName() in ("double", "float"):
            col = F.when(F.isnan(col), None).otherwise(col)
        new[c + suffix] = F.coalesce(col, F.lit(v).cast(df.schema[c].dataType))
    return df.withColumns(new) if new else df


def impute(df: DataFrame, cols, strategy: str | None, suffix: str = "") -> DataFrame:
    """``strategy`` None passes the columns through."""
    if strategy is None:
        return df
    return apply_impute(df, fit_impute(df, cols, strategy), suffix)

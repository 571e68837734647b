"""KPIs and exploratory summaries (K1, K2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.operators.metrics import predicted


def kpis(segmented: DataFrame, label: str = "label", score: str = "score",
         segment: str = "risk_segment", threshold: float = S.DEFAULT_THRESHOLD,
         high_levels=("Very High Risk", "High Risk")) -> DataFrame:
    """K1: customers, churn rate, accuracy at the threshold, high-risk count - one aggregate."""
    hit = (predicted(score, threshold) == F.col(label)).cast("int")
    return segmented.agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(F.col(label).cast("double")).alias("churn_rate"),
        F.avg(hit.cast("double")).alias("accuracy"),
        F.count_if(F.col(segment).isin(*high_levels)).alias("high_risk_count"),
    )


def category_counts(df: DataFrame, cols) -> DataFrame:
    """K2: value counts of every categorical column in one grouped job (long form)."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("p")
    return df.select(pairs).select("p.column", "p.value") \
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def correlations(df: DataFrame, cols) -> DataFrame:
    """K2: Pearson correlation of every pair (i < j) of numeric columns in one aggregate."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}")
                    for a, b in pairs])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                 F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs
    ])).alias("r")).select("r.*")

"""The flagship query: segment summary joined with its interventions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.operators import risk
from churnspark.plans import catalog


def segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 -> R3 -> R4: quantile segments, their summary and recommended actions."""
    summary = catalog.q_risk_summary(spark, sf_dir)
    return risk.add_interventions(summary).orderBy(F.col("avg_churn_probability").desc())

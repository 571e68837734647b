"""Risk segmentation, interventions and top-k factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.functions import stats


def _segment_expr(score: Column, cuts) -> Column:
    """First matching level of ``score >= cut`` (cuts high to low), else lowest level."""
    expr = None
    for (name, _), cut in zip(S.RISK_LEVELS, cuts):
        cond = score >= F.lit(float(cut))
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise(S.LOWEST_RISK)


def fit_quantile_cuts(df: DataFrame, score: str = "score") -> list[float]:
    """R1 fit: exact linear quantiles of the score at the level fractions."""
    return stats.exact_quantiles(df, score, [q for _, q in S.RISK_LEVELS])


def segment_by_quantile(df: DataFrame, score: str = "score", out: str = "risk_segment",
                        cuts=None) -> DataFrame:
    """>= q90 Very High, >= q70 High, >= q40 Medium, else Low.

    The three cut values are fitted once (exact selection) and then applied as
    literals, so the per-row work is a single CASE inside whole-stage codegen.
    """
    cuts = cuts if cuts is not None else fit_quantile_cuts(df, score)
    if any(c is None for c in cuts):
        return df.withColumn(out, F.lit(None).cast("string"))
    return df.withColumn(out, _segment_expr(F.col(score), cuts))


def segment_by_band(df: DataFrame, score: str = "score", out: str = "risk_segment") -> DataFrame:
    """R2: fixed bands 0.9 / 0.7 / 0.4."""
    return df.withColumn(out, _segment_expr(F.col(score), [q for _, q in S.RISK_LEVELS]))


def summarize_segments(df: DataFrame, score: str = "score", actual: str | None = "label",
                       segment: str = "risk_segment") -> DataFrame:
    """Per segment count, mean score, churned sum/rate and share of all rows.

    The share's denominator (all rows, NULL segments included) is a window-free
    total from the same grouped result; percentages are rounded half-even.
    """
    aggs = [F.count(score).alias("customer_count"),
            F.avg(score).alias("avg_churn_probability")]
    if actual and actual in df.columns:
        aggs += [F.sum(F.col(actual)).cast("long").alias("actual_churned"),
                 F.avg(F.col(actual).cast("double")).alias("churn_rate")]
    aggs.append(F.count(F.lit(1)).alias("_rows"))
    g = df.groupBy(segment).agg(*aggs)
    # grouped result has one row per segment (<= 5): the total is a bounded window
    total = F.sum("_rows").over(_whole())
    g = g.withColumn("percentage", F.bround(F.col("customer_count") / total * 100, 2))
    return g.where(F.col(segment).isNotNull()).drop("_rows") \
        .orderBy(F.col("avg_churn_probability").desc())


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy()


def interventions_map() -> Column:
    """R4 lookup as a literal map: segment -> struct(discount, contact, priority)."""
    kv = []
    for seg, (discount, contact, priority) in S.INTERVENTIONS.items():
        kv += [F.lit(seg), F.struct(F.lit(discount).alias("discount"),
                                    F.lit(contact).alias("contact"),
                                    F.lit(priority).alias("priority"))]
    return F.create_map(*kv)


def add_interventions(df: DataFrame, segment: str = "risk_segment") -> DataFrame:
    """discount/contact/priority per row; unknown segment -> NULLs (empty)."""
    r = interventions_map()[F.col(segment)]
    return df.withColumns({
        "discount": r["discount"], "contact": r["contact"], "priority": r["priority"],
    })


def high_risk_list(df: DataFrame, score: str = "score", segment: str = "risk_segment",
                   levels=("Very High Risk",), key: str = S.KEY) -> DataFrame:
    """Customers in the given segments, highest score first."""
    return df.where(F.col(segment).isin(*levels)) \
        .orderBy(F.col(score).desc(), F.col(key).asc())


def top_k_factors(df: DataFrame, features, key: str = S.KEY, k: int = 3,
                  prefix: str = "phi_") -> DataFrame:
    """The k features with the largest |contribution| of each row.

    Works on the wide contribution columns (``prefix + feature``) with a per-row
    array sort - no shuffle.  Ties keep feature order.  Long output
    (key, rank, feature, contribution).
    """
    items = F.array(*[
        F.struct(F.abs(F.col(prefix + f)).alias("neg"), F.lit(i).alias("pos"),
                 F.lit(f).alias("feature"), F.col(prefix + f).alias("contribution"))
        for i, f in enumerate(features)
    ])
    ordered = F.array_sort(items, lambda a, b: F.when(a["neg"] > b["neg"], -1)
                           .when(a["neg"] < b["neg"], 1)
                           .when(a["pos"] < b["pos"], -1)
                           .when(a["pos"] > b["pos"], 1).otherwise(0))
    top = F.slice(ordered, 1, k)
    return df.select(key, F.posexplode(top).alias("pos", "item")).select(
        key, (F.col("pos") + 1).alias("rank"),
        F.col("item.feature").alias("feature"),
        F.col("item.contribution").alias("contribution"))

"""Named queries over the driver tables: ``name -> (spark, sf_dir) -> DataFrame``.

Every query starts from :func:`churnspark.sources.fixtures.telco_raw`, which
reads `customer` and `orders`, so its work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.functions import clean, features, stats
from churnspark.operators import (encode, explain, impute, metrics, report, risk, score,
                                  split, validate)
from churnspark.sources.fixtures import telco_raw

ROUND = 6

# Fixed lambdas for the fixed-parameter Yeo-Johnson query.
YJ_LAMBDAS = {"tenure": 0.7, "MonthlyCharges": 1.3, "TotalCharges": 0.25,
              "NumServices": 0.0, "AvgCharge": -0.4}

# Extra "models" for comparison queries: score columns derived from the data.
MEMBERS = ["score", "tenure_score", "charge_score"]
SPLIT_FRAC = 0.2
N_FOLDS = 5
SAMPLE_CAP = 1000
TOP_K = 3


def r(c, digits: int = ROUND):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ------------------------------------------------------------------ bases

def raw(spark: SparkSession, d: str) -> DataFrame:
    return telco_raw(spark, d)


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Lenient cleaning; ``label`` = encoded Churn."""
    c = clean.clean_lenient(raw(spark, d))
    return c.withColumn("label", F.col("Churn"))


def engineered(spark: SparkSession, d: str) -> DataFrame:
    e = features.engineer_lenient(cleaned(spark, d))
    return e.withColumn("LessThan6Months", features.less_than_6_months())


def with_members(df: DataFrame) -> DataFrame:
    """Add two data-derived member scores next to ``score``."""
    lo, hi = score.fit_minmax(df, "MonthlyCharges")
    return df.withColumns({
        "tenure_score": F.lit(1.0) - F.col("tenure").cast("double") / F.lit(72.0),
        "charge_score": score.minmax_expr("MonthlyCharges", lo, hi),
    })


def models_long(df: DataFrame) -> DataFrame:
    """One (model, key, label, score) row per member score (long form for E14)."""
    return df.select(S.KEY, "label", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in MEMBERS
    ])).alias("m")).select(S.KEY, "label", "m.model", "m.score")


def scorecard(spark, d):
    e = engineered(spark, d)
    return explain.linear_contributions(e)


# ------------------------------------------------------------------ F, G

CLEAN_COLS = ["customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
              "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
              "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
              "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
              "MonthlyCharges", "TotalCharges", "Churn"]


def q_clean_lenient(spark, d):
    return cleaned(spark, d).select(*[r(c).alias(c) if c == "TotalCharges" else c
                                      for c in CLEAN_COLS])


def q_clean_strict(spark, d):
    e = features.engineer_app(clean.clean_strict(raw(spark, d)))
    extra = ["tenure_group", "LongTerm", "AvailingInternetService", "NumServices",
             "AvgCharge", "LessThan6Months"]
    cols = [r(c).alias(c) if c in ("TotalCharges", "AvgCharge") else c
            for c in CLEAN_COLS + extra]
    return e.select(*cols)


MODE_COLS = ["gender", "InternetService", "PaymentMethod", "Contract", "tenure_group"]


def q_impute_mode(spark, d):
    rw = raw(spark, d)
    rw = rw.withColumn("tenure_group", features.tenure_group(rw))
    fills = impute.fit_impute(rw, MODE_COLS, "most_frequent")
    return spark.createDataFrame([(c, fills[c]) for c in MODE_COLS],
                                 "feature string, fill_value string")


def q_impute_numeric(spark, d):
    p = clean.parse_total_charges(raw(spark, d))
    out = p
    for strategy, suffix in (("mean", "_mean"), ("median", "_median"), ("most_frequent", "_mode")):
        out = impute.apply_impute(out, impute.fit_impute(p, ["TotalCharges"], strategy), suffix)
    return out.select(S.KEY, *[r(f"TotalCharges{s}").alias(f"TotalCharges{s}")
                               for s in ("_mean", "_median", "_mode")])


def _validation_input(spark, d):
    return clean.clean_lenient(raw(spark, d), encode_contract=False)


def q_validate_rejects(spark, d):
    _, rejects = validate.split_valid(_validation_input(spark, d))
    return rejects.select(S.KEY, F.array_join("reasons", ",").alias("reasons"))


def _spoiled(spark, d):
    """The validation input with wrong values put into some rows, by their tenure."""
    t = F.col("tenure")

    def where(divisor, value, column):
        return F.when(t % divisor == 0, value).otherwise(F.col(column))

    return _validation_input(spark, d).withColumns({
        "gender": where(7, F.lit("unknown"), "gender"), "MonthlyCharges": where(11, -F.col("MonthlyCharges") - 1, "MonthlyCharges"),
        "InternetService": where(13, F.lit(None), "InternetService"), "Partner": where(17, F.lit(2), "Partner")})


def q_validate_spoiled_rejects(spark, d):
    _, rejects = validate.split_valid(_spoiled(spark, d))
    return rejects.select(S.KEY, F.array_join("reasons", ",").alias("reasons"))


def q_validate_spoiled_counts(spark, d):
    return validate.violation_counts(_spoiled(spark, d))


def q_validate_counts(spark, d):
    return validate.violation_counts(_validation_input(spark, d))


def q_drop_nulls(spark, d):
    p = clean.parse_total_charges(raw(spark, d)).drop("score")
    return clean.drop_nulls(p).withColumn("TotalCharges", r("TotalCharges"))


CODE_COLS = ["gender", "InternetService", "PaymentMethod", "Contract", "tenure_group"]


def q_label_codes(spark, d):
    rw = raw(spark, d)
    rw = rw.withColumn("tenure_group", features.tenure_group(rw))
    return encode.label_codes(rw.select(S.KEY, *CODE_COLS), CODE_COLS)


def q_tenure_features(spark, d):
    rw = raw(spark, d)
    return rw.select(S.KEY, "tenure", features.tenure_group(rw).alias("tenure_group"),
                     features.long_term().alias("LongTerm"),
                     features.less_than_6_months().alias("LessThan6Months"))


def q_service_features(spark, d):
    e = engineered(spark, d)
    return e.select(S.KEY, "AvailingInternetService", "NumServices", r("AvgCharge").alias("AvgCharge"))


def q_yeo_johnson_fixed(spark, d):
    e = engineered(spark, d)
    return e.select(S.KEY, *[r(features.yeo_johnson(F.col(c), lam)).alias(f"{c}_yj")
                             for c, lam in YJ_LAMBDAS.items()])


def q_one_hot(spark, d):
    e = engineered(spark, d)
    return encode.one_hot_drop_first(e.select(S.KEY, *S.CATEGORICAL), S.CATEGORICAL)


def q_one_hot_sparse(spark, d):
    """Customers with each component of the sparse encoding active."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer
    e = engineered(spark, d).select(*S.CATEGORICAL)
    levels = encode.category_levels(e, S.CATEGORICAL)
    rows = encode.fit_sparse_one_hot(e, S.CATEGORICAL, levels=levels).transform(e)
    active = rows.agg(Summarizer.numNonZeros(F.col("onehot")).alias("n")) \
        .select(F.posexplode(vector_to_array("n")).alias("idx", "n"))
    names = encode.feature_name_frame(spark, encode.one_hot_names(S.CATEGORICAL, levels))
    return active.join(F.broadcast(names), "idx").select("name", F.col("n").cast("long").alias("n"))


def q_feature_names(spark, d):
    e = engineered(spark, d)
    levels = encode.category_levels(e, S.CATEGORICAL)
    return encode.feature_name_frame(spark, encode.feature_names(S.CATEGORICAL, levels))


# ------------------------------------------------------------------ X

def q_stratified_split(spark, d):
    c = _scored(spark, d).select(S.KEY, "label")
    return split.stratified_split(c, test_frac=SPLIT_FRAC)


def q_plain_split(spark, d):
    c = _scored(spark, d).select(S.KEY)
    return split.plain_split(c, test_frac=SPLIT_FRAC)


def q_folds(spark, d):
    c = _scored(spark, d).select(S.KEY, "label")
    return split.stratified_folds(c, k=N_FOLDS)


def q_range_folds(spark, d):
    c = _scored(spark, d).select(S.KEY, "label")
    return split.range_folds(c, k=N_FOLDS)


def q_capped_sample(spark, d):
    c = _scored(spark, d).select(S.KEY, "score")
    return split.capped_sample(c, SAMPLE_CAP)


def q_class_weights(spark, d):
    c = _scored(spark, d).select(S.KEY, "label")
    return split.class_weights(c).withColumn("weight", r("weight"))


# ------------------------------------------------------------------ V, M15

def q_minmax_score(spark, d):
    c = _scored(spark, d).select(S.KEY, (F.col("score") * 4 - 2).alias("margin"))
    return score.minmax_score(c, "margin", out="score_minmax") \
        .select(S.KEY, r("score_minmax").alias("score_minmax"))


def q_threshold_label(spark, d):
    c = _scored(spark, d).select(S.KEY, "score")
    return score.threshold_label(c)


def q_soft_vote(spark, d):
    c = with_members(_light(spark, d))
    v = score.soft_vote(c, MEMBERS)
    return v.select(S.KEY, r("vote_score").alias("vote_score"),
                    (F.col("vote_score") >= S.DEFAULT_THRESHOLD).cast("int").alias("vote_label"))


# ------------------------------------------------------------------ E

def _light(spark, d):
    """Key, label, score plus the raw numeric columns the member scores use."""
    rw = raw(spark, d).select(S.KEY, "Churn", "score", "tenure", "MonthlyCharges")
    return clean.label_column(rw, "Churn", "label")


def _scored(spark, d):
    """(key, label, score) - only the label needs encoding (F9), no fitted cleaning."""
    rw = raw(spark, d).select(S.KEY, "Churn", "score")
    return clean.label_column(rw, "Churn", "label").select(S.KEY, "label", "score")


def q_confusion(spark, d):
    return metrics.confusion(_scored(spark, d))


def q_basic_metrics(spark, d):
    m = metrics.basic_metrics(_scored(spark, d))
    return m.select("tn", "fp", "fn", "tp", *[r(c).alias(c) for c in
                                              ("accuracy", "precision", "recall", "f1")])


def q_roc_auc(spark, d):
    return metrics.curve_summary(_scored(spark, d)).select(r("roc_auc").alias("roc_auc"))


def q_avg_precision(spark, d):
    return metrics.curve_summary(_scored(spark, d)).select(r("pr_auc").alias("pr_auc"))


def q_brier(spark, d):
    return metrics.brier(_scored(spark, d)).select(r("brier").alias("brier"))


def q_roc_curve(spark, d):
    c = metrics.roc_curve(_scored(spark, d))
    return c.select("threshold", r("fpr").alias("fpr"), r("tpr").alias("tpr"))


def q_pr_curve(spark, d):
    c = metrics.pr_curve(_scored(spark, d))
    return c.select("threshold", r("precision").alias("precision"), r("recall").alias("recall"))


def q_f1_sweep(spark, d):
    s = metrics.threshold_sweep(_scored(spark, d))
    return s.select("i", r("threshold").alias("threshold"), r("f1").alias("f1"))


def q_best_f1(spark, d):
    b = metrics.best_f1(_scored(spark, d))
    return b.select(r("best_f1_threshold").alias("best_f1_threshold"),
                    r("best_f1_score").alias("best_f1_score"))


def q_best_pr_threshold(spark, d):
    b = metrics.best_pr_threshold(_scored(spark, d))
    return b.select(r("threshold").alias("threshold"), r("f1").alias("f1"))


def q_cm_sweep(spark, d):
    s = metrics.threshold_sweep(_scored(spark, d))
    return s.select("i", r("threshold").alias("threshold"), "tp", "fp", "tn", "fn")


def q_class_report(spark, d):
    c = metrics.class_report(_scored(spark, d))
    return c.select("class", *[r(x).alias(x) for x in ("precision", "recall", "f1")], "support")


def q_hist_by_class(spark, d):
    h = metrics.histogram_by_class(_scored(spark, d))
    return h.select("label", "bin", r("bin_left").alias("bin_left"),
                    r("bin_right").alias("bin_right"), "count", r("density").alias("density"))


def q_hist_by_outcome(spark, d):
    h = metrics.histogram_by_outcome(_scored(spark, d))
    return h.select("outcome", "bin", r("bin_left").alias("bin_left"),
                    r("bin_right").alias("bin_right"), "count")


def _metric_cols():
    return [r(c).alias(c) for c in metrics.METRIC_COLUMNS]


def q_compare_models(spark, d):
    long = models_long(with_members(_light(spark, d)))
    t = metrics.compare_models(long)
    return t.select("model", "tn", "fp", "fn", "tp", *_metric_cols())


def q_pick_best(spark, d):
    long = models_long(with_members(_light(spark, d)))
    t = metrics.metric_table(long, groups=["model"])
    b = metrics.pick_best(t, "pr_auc", "model")
    return b.select("model", r("pr_auc").alias("pr_auc"))


def q_train_test_metrics(spark, d):
    c = _scored(spark, d)
    sp = split.stratified_split(c, test_frac=SPLIT_FRAC)
    t = metrics.metric_table(sp, groups=["split"])
    return t.select("split", "tn", "fp", "fn", "tp", *_metric_cols())


def q_registry_best(spark, d):
    from churnspark.sources import io
    long = models_long(with_members(_light(spark, d)))
    t = metrics.metric_table(long, groups=["model"])
    reg = io.registry_rows_from_metrics(t, "model", created_base=1.7e9)
    best = io.registry_latest_best(reg)
    return best.select("name", "version", r(F.col("metrics")["pr_auc"]).alias("pr_auc"))


# ------------------------------------------------------------------ R, H, K

def _segmented(spark, d):
    return risk.segment_by_quantile(_scored(spark, d))


def q_risk_quantile(spark, d):
    return _segmented(spark, d).select(S.KEY, "score", "risk_segment")


def q_risk_bands(spark, d):
    return risk.segment_by_band(_scored(spark, d)).select(S.KEY, "score", "risk_segment")


def q_risk_summary(spark, d):
    s = risk.summarize_segments(_segmented(spark, d), "score", "label")
    return s.select("risk_segment", "customer_count",
                    r("avg_churn_probability").alias("avg_churn_probability"),
                    "actual_churned", r("churn_rate").alias("churn_rate"), "percentage")


def q_risk_actions(spark, d):
    return risk.add_interventions(_segmented(spark, d)) \
        .select(S.KEY, "risk_segment", "discount", "contact", "priority")


def q_top_factors(spark, d):
    t = risk.top_k_factors(scorecard(spark, d), list(explain.SCORECARD), k=TOP_K)
    return t.select(S.KEY, "rank", "feature")


def q_high_risk_list(spark, d):
    return risk.high_risk_list(_segmented(spark, d)).select(S.KEY, "score", "risk_segment")


def q_importance(spark, d):
    long = explain.to_long(scorecard(spark, d), list(explain.SCORECARD))
    return explain.global_importance(long).select("feature", r("importance").alias("importance"))


def q_row_contributors(spark, d):
    t = risk.top_k_factors(scorecard(spark, d), list(explain.SCORECARD), k=TOP_K)
    return t.select(S.KEY, "rank", "feature", r("contribution").alias("contribution"))


def q_dependence(spark, d):
    dep = explain.dependence(scorecard(spark, d), features=list(explain.SCORECARD))
    return dep.select(S.KEY, "feature", r("feature_value").alias("feature_value"),
                      r("contribution").alias("contribution"), "color_feature",
                      r("color_value").alias("color_value"))


def q_kpis(spark, d):
    k = report.kpis(_segmented(spark, d))
    return k.select("customers", r("churn_rate").alias("churn_rate"),
                    r("accuracy").alias("accuracy"), "high_risk_count")


KPI_CATEGORIES = ["gender", "InternetService", "PaymentMethod", "Contract", "tenure_group"]
CORR_COLS = ["tenure", "MonthlyCharges", "TotalCharges", "NumServices", "AvgCharge", "score"]


def q_category_counts(spark, d):
    e = engineered(spark, d).withColumn("Contract", F.col("Contract").cast("string"))
    return report.category_counts(e, KPI_CATEGORIES)


def q_correlations(spark, d):
    c = report.correlations(engineered(spark, d), CORR_COLS)
    return c.select("col_a", "col_b", r("corr").alias("corr"))


ORACLE_QUERIES = {
    "clean_lenient": q_clean_lenient,
    "clean_strict": q_clean_strict,
    "impute_mode": q_impute_mode,
    "impute_numeric": q_impute_numeric,
    "validate_rejects": q_validate_rejects,
    "validate_counts": q_validate_counts,
    "validate_spoiled_rejects": q_validate_spoiled_rejects,
    "validate_spoiled_counts": q_validate_spoiled_counts,
    "drop_nulls": q_drop_nulls,
    "label_codes": q_label_codes,
    "tenure_features": q_tenure_features,
    "service_features": q_service_features,
    "yeo_johnson_fixed": q_yeo_johnson_fixed,
    "one_hot": q_one_hot,
    "one_hot_sparse": q_one_hot_sparse,
    "feature_names": q_feature_names,
    "stratified_split": q_stratified_split,
    "plain_split": q_plain_split,
    "folds": q_folds,
    "range_folds": q_range_folds,
    "capped_sample": q_capped_sample,
    "class_weights": q_class_weights,
    "minmax_score": q_minmax_score,
    "threshold_label": q_threshold_label,
    "soft_vote": q_soft_vote,
    "confusion": q_confusion,
    "basic_metrics": q_basic_metrics,
    "roc_auc": q_roc_auc,
    "avg_precision": q_avg_precision,
    "brier": q_brier,
    "roc_curve": q_roc_curve,
    "pr_curve": q_pr_curve,
    "f1_sweep": q_f1_sweep,
    "best_f1": q_best_f1,
    "best_pr_threshold": q_best_pr_threshold,
    "cm_sweep": q_cm_sweep,
    "class_report": q_class_report,
    "hist_by_class": q_hist_by_class,
    "hist_by_outcome": q_hist_by_outcome,
    "compare_models": q_compare_models,
    "pick_best": q_pick_best,
    "train_test_metrics": q_train_test_metrics,
    "registry_best": q_registry_best,
    "risk_quantile": q_risk_quantile,
    "risk_bands": q_risk_bands,
    "risk_summary": q_risk_summary,
    "risk_actions": q_risk_actions,
    "top_factors": q_top_factors,
    "high_risk_list": q_high_risk_list,
    "importance": q_importance,
    "row_contributors": q_row_contributors,
    "dependence": q_dependence,
    "kpis": q_kpis,
    "category_counts": q_category_counts,
    "correlations": q_correlations,
}

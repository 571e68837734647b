"""What the model queries must satisfy, as queries whose result SQL knows.

Each runs the model operator in full and returns counts over the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.plans import ensemble as EN
from churnspark.plans import explain as X
from churnspark.plans import modeling as MD


def _counted(df: DataFrame, bad) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad"))


def _additivity(key: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        """Test rows, and those whose contributions and base value miss the model's output."""
        _, test = MD._parts(spark, d)
        phi, base, _ = X.tree_shap(MD.fitted(spark, d, key), test)
        total = F.aggregate("phi", F.lit(base), lambda a, b: a + b)
        return _counted(phi, F.abs(total - F.col("output")) > 1e-6)
    return query


def vote_is_mean(spark: SparkSession, d: str) -> DataFrame:
    """Test rows, and those whose vote is not the mean of the members."""
    _, test = MD._parts(spark, d)
    members = {k: MD.fitted(spark, d, k) for k in ("dt", "logreg")}
    s = EN.VotingModel(members).transform(EN.VotingModel(members).member_scores(test).withColumnsRenamed({"p_dt": "a", "p_logreg": "b"}))
    return _counted(s, F.abs((F.col("a") + F.col("b")) / 2 - F.col("score")) > 1e-9)


def _prediction(key: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        """Test rows, and those whose score is no probability or whose label does not go by the threshold."""
        s = MD.MODEL_QUERIES[f"{key}_predict"](spark, d)
        wrong = F.col("prediction") != F.when(F.col("score") >= 0.5, 1).otherwise(0)
        return _counted(s, ~F.coalesce(F.col("score").between(0, 1), F.lit(False)) | wrong)
    return query


def _probabilities(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        """Test rows, and those whose score is no probability."""
        return _counted(MD.MODEL_QUERIES[name](spark, d), ~F.coalesce(F.col("score").between(0, 1), F.lit(False)))
    return query


def predict_batch_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers scored, and those whose label does not go by the threshold."""
    return _counted(MD.q_predict_batch(spark, d), F.col("prediction") != F.when(F.col("probability") >= 0.5, 1).otherwise(0))


def _balanced(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        """Rows of the larger class in the training split, original rows that are left, and minority rows outside the larger class's number (SMOTE) or of label 0 (ADASYN)."""
        out = MD.MODEL_QUERIES[name](spark, d)
        made = F.col("customerID").startswith("syn-")
        return out.agg(F.count_if(F.col("label") == 0).alias("n_larger"), F.count_if(~made).alias("n_original"), F.count_if(made & (F.col("label") == 0)).alias("n_bad"))
    return query


def smote_classes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each class after SMOTE."""
    return MD.q_smote(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def shapley_sums(spark: SparkSession, d: str) -> DataFrame:
    """Test rows, and those that lack a feature's contribution or hold one that is no number."""
    out = MD.q_sampling_shapley(spark, d)
    width = len(MD._names(spark, d, "dt"))
    rows = out.groupBy("customerID").agg(F.countDistinct("feature").alias("n"), F.count_if(F.isnan("contribution") | F.col("contribution").isNull()).alias("odd"))
    return _counted(rows, (F.col("n") != width) | (F.col("odd") > 0))


CHECK_QUERIES = {
    **{f"{key}_prediction_rows": _prediction(key) for key in ("tree", "forest", "boost", "xgb", "lgbm", "cat", "logreg")},
    **{f"{name}_probabilities": _probabilities(name) for name in ("voting", "calibration")},
    "predict_batch_rows": predict_batch_rows,
    "smote_rows": _balanced("smote"),
    "adasyn_rows": _balanced("adasyn"),
    "smote_classes": smote_classes,
    "shapley_rows": shapley_sums,
    "grown_shap_additivity": _additivity("xgb"),
    "tree_shap_additivity": _additivity("dt"),
    "forest_shap_additivity": _additivity("rf"),
    "boost_shap_additivity": _additivity("gb"),
    "vote_is_mean": vote_is_mean,
}

"""Model-based queries: the catalogue's presets, trained on the X1 train split of
the whole customer table, explaining and scoring the whole test split.  Fitted
models are shared within a session; ``forget`` drops them, as the benchmark does
before each query.  ``plans/checks`` has what these queries must satisfy as SQL.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.functions import clean
from churnspark.operators import metrics as M
from churnspark.operators import resample, split
from churnspark.operators.explain import global_importance
from churnspark.plans import catalog as C
from churnspark.plans import ensemble as EN
from churnspark.plans import explain as X
from churnspark.plans import learners as L
from churnspark.plans import tune as T
from churnspark.plans.features import ChurnFeatures, fit_yeo_johnson
from churnspark.session import cut_lineage, default_buckets, ensure_checkpoint_dir
from churnspark.sources.fixtures import read_table

_MODELS: dict = {}


def _session(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


def forget() -> None:
    """Drop all fitted models and labelled splits."""
    _MODELS.clear()
    for df in _LABELED.values():
        df.unpersist()
    _LABELED.clear()


def labeled(spark: SparkSession, d: str) -> DataFrame:
    """Raw customer rows with the encoded label and the X1 split."""
    rw = C.raw(spark, d).drop("score")
    rw = clean.label_column(rw, S.TARGET, "label")
    return split.stratified_split(rw, test_frac=C.SPLIT_FRAC)


_LABELED: dict = {}
#: Rows of a partition of the labeled split at most, or nearly.
PART_ROWS = 500_000


def labeled_cached(spark: SparkSession, d: str) -> DataFrame:
    """The labeled split, materialised once per session (iterative fits reuse it).

    A partition for each core, more where one would have over PART_ROWS rows: fits do much
    work with few bytes, by which Spark would deal them to a task or two, and the number of
    tasks of a fit's many jobs does not grow before the rows ask for it.  Rows are in the
    order of their keys, so that fits that draw rows draw the same ones each time.  They are
    cut off from the plan that made them, which every job of a fit would carry."""
    from pyspark import StorageLevel
    k = (_session(spark), d)
    if k not in _LABELED:
        n = read_table(spark, d, "customer").count()
        parts = max(default_buckets(spark, factor=1, floor=1), -(-n // PART_ROWS))
        lab = cut_lineage(labeled(spark, d).repartition(parts, S.KEY).sortWithinPartitions(S.KEY)).persist(StorageLevel.MEMORY_AND_DISK)
        lab.count()
        _LABELED[k] = lab
    return _LABELED[k]


def _parts(spark, d):
    lab = labeled_cached(spark, d)
    return lab.where(F.col("split") == "train").drop("split"), \
        lab.where(F.col("split") == "test").drop("split")


def fitted(spark, d, key: str):
    k = (_session(spark), d, key)
    if k not in _MODELS:
        train, _ = _parts(spark, d)
        _MODELS[k] = L.fit(key, train)
    return _MODELS[k]


def _predict(key):
    def q(spark, d):
        _, test = _parts(spark, d)
        s = L.score(fitted(spark, d, key), test, keep=[S.KEY, "label"])
        return s.withColumn("prediction", (F.col("score") >= S.DEFAULT_THRESHOLD).cast("int"))
    return q


def q_cv_metrics(spark, d):
    train, _ = _parts(spark, d)
    return T.cv_metrics("dt", train)


#: The shipped grid of this learner (config.yaml, tuning.param_grids): 144 points.
DT_GRID = {"criterion": ["gini"], "max_depth": [4, 6, 10], "min_samples_split": [10, 50, 100, 200],
           "min_samples_leaf": [10, 20, 50], "max_features": ["sqrt", None], "class_weight": [None, "balanced"]}


def q_grid_search(spark, d):
    train, _ = _parts(spark, d)
    model, combos = T.grid_search("decision_tree_gini", train, DT_GRID)
    return T.results_table(spark, model, combos)


def q_random_search(spark, d):
    train, _ = _parts(spark, d)
    model, combos = T.random_search("decision_tree_gini", train, DT_GRID, n_iter=50)
    return T.results_table(spark, model, combos)


def q_model_search(spark, d):
    train, _ = _parts(spark, d)
    best, trials = T.model_search("xgb", train, n_trials=20)
    rows = [(i, {k: str(v) for k, v in p.items()}, ap, p == best) for i, (p, ap) in enumerate(trials)]
    return spark.createDataFrame(rows, "trial int, params map<string,string>, pr_auc double, best boolean")


def q_stacking(spark, d):
    train, test = _parts(spark, d)
    model = EN.fit_stacking(["dt", "logreg"], train)
    return model.transform(test).select(S.KEY, "label", "score")


def q_calibration(spark, d):
    train, test = _parts(spark, d)
    model = EN.fit_calibrated("dt", train, cv=3)
    return model.transform(test).select(S.KEY, "label", "score")


def _voting(spark, d):
    return EN.VotingModel({k: fitted(spark, d, k) for k in ("dt", "logreg", "gb")})


def q_voting(spark, d):
    _, test = _parts(spark, d)
    return _voting(spark, d).transform(test).select(S.KEY, "label", "score")


def q_ensemble_eval(spark, d):
    _, test = _parts(spark, d)
    return EN.evaluate(_voting(spark, d), test, "soft_voting")


def _encoded_train(spark, d):
    train, _ = _parts(spark, d)
    feats = ChurnFeatures().fit(train)
    return feats.transform(train).select(S.KEY, "label", "features")


def q_smote(spark, d):
    from pyspark.ml.functions import vector_to_array
    out = resample.smote(_encoded_train(spark, d))
    return out.select(S.KEY, "label", F.to_json(F.struct(vector_to_array("features").alias("x")))
                      .alias("features"))


def q_adasyn(spark, d):
    out = resample.adasyn(_encoded_train(spark, d))
    from pyspark.ml.functions import vector_to_array
    return out.select(S.KEY, "label", F.to_json(F.struct(vector_to_array("features").alias("x")))
                      .alias("features"))


def q_stratified_sample(spark, d):
    lab = labeled(spark, d).drop("split")
    return split.stratified_sample(lab, 0.1).select(S.KEY, "label")


def q_yeo_johnson_fit(spark, d):
    e = C.engineered(spark, d)
    lams = fit_yeo_johnson(e, S.POWER_FEATURES)
    return spark.createDataFrame([(c, float(v)) for c, v in lams.items()],
                                 "feature string, lambda double")


def _names(spark, d, key):
    return fitted(spark, d, key).stages[0].feature_names()


def q_tree_shap(spark, d):
    _, test = _parts(spark, d)
    model = fitted(spark, d, "rf")
    phi, base, space = X.tree_shap(model, test)
    long = X.shap_long(phi, _names(spark, d, "rf"))
    return long.withColumn("base_value", F.lit(base)).withColumn("space", F.lit(space))


def q_boost_shap(spark, d):
    _, test = _parts(spark, d)
    model = fitted(spark, d, "gb")
    phi, base, space = X.tree_shap(model, test)
    return phi.select(S.KEY, "output", F.lit(base).alias("base_value"),
                      F.aggregate("phi", F.lit(0.0), lambda a, b: a + b).alias("phi_sum"))


def q_sampling_shapley(spark, d):
    train, test = _parts(spark, d)
    background = split.capped_sample(train, 50)
    out = X.sampling_shapley(fitted(spark, d, "dt"), test, background)
    names = F.array(*[F.lit(n) for n in _names(spark, d, "dt")])
    return out.select(S.KEY, F.element_at(names, F.col("i") + 1).alias("feature"),
                      F.col("phi").alias("contribution"))


def q_permutation_importance(spark, d):
    _, test = _parts(spark, d)
    out = X.permutation_importance(fitted(spark, d, "dt"), test)
    names = F.array(*[F.lit(n) for n in _names(spark, d, "dt")])
    return out.select(F.element_at(names, F.col("i") + 1).alias("feature"),
                      "importance_mean", "importance_std")


def q_model_importance(spark, d):
    return X.model_importances(fitted(spark, d, "rf"), _names(spark, d, "rf"))


def q_beeswarm(spark, d):
    """H8: the operators' own sample (X4) and number of top features (H4)."""
    _, test = _parts(spark, d)
    model = fitted(spark, d, "rf")
    sample = split.capped_sample(test)
    phi, _, _ = X.tree_shap(model, sample)
    long = X.shap_long(phi, _names(spark, d, "rf"))
    top = global_importance(long).select("feature")
    return long.join(F.broadcast(top), "feature", "left_semi")


def q_predict_batch(spark, d):
    """V4 + S5: persist the fitted model, load it back, score every customer."""
    from churnspark.sources import io
    path = os.path.join(ensure_checkpoint_dir(spark), f"model-{uuid.uuid4().hex}")
    io.save_model(fitted(spark, d, "dt"), path)
    model = io.load_model(path)
    return L.predict_batch(model, C.raw(spark, d).drop("score"))


def q_predict_named(spark, d):
    """V4 + E17: the better of two learners is promoted, found again and scores every customer."""
    from churnspark.plans.flow import predict_named, promote_best
    _, test = _parts(spark, d)
    models = {k: fitted(spark, d, k) for k in ("dt", "logreg")}
    scored = [L.score(m, test).select(F.lit(k).alias("model"), "label", "score") for k, m in models.items()]
    folder = os.path.join(ensure_checkpoint_dir(spark), f"models-{uuid.uuid4().hex}")
    promote_best(models, M.metric_table(scored[0].unionByName(scored[1]), groups=["model"]), folder)
    return predict_named(C.raw(spark, d).drop("score"), folder)


def q_advanced_flow(spark, d):
    from churnspark.plans.flow import FlowPlan, train_flow
    train, test = _parts(spark, d)
    plan = FlowPlan(learners=("dt", "logreg", "rf", "gb", "xgb"), search_trials=20, oversample="smote")
    return train_flow(train, test, plan).comparison


MODEL_QUERIES = {
    "tree_predict": _predict("dt"),
    "forest_predict": _predict("rf"),
    "boost_predict": _predict("gb"),
    "xgb_predict": _predict("xgb"),
    "logreg_predict": _predict("logreg"),
    "rbf_svm_predict": _predict("svc"),
    "cv_metrics": q_cv_metrics,
    "grid_search": q_grid_search,
    "random_search": q_random_search,
    "model_search": q_model_search,
    "stacking": q_stacking,
    "calibration": q_calibration,
    "voting": q_voting,
    "ensemble_eval": q_ensemble_eval,
    "advanced_flow": q_advanced_flow,
    "smote": q_smote,
    "adasyn": q_adasyn,
    "stratified_sample": q_stratified_sample,
    "yeo_johnson_fit": q_yeo_johnson_fit,
    "tree_shap": q_tree_shap,
    "boost_shap": q_boost_shap,
    "sampling_shapley": q_sampling_shapley,
    "permutation_importance": q_permutation_importance,
    "model_importance": q_model_importance,
    "beeswarm": q_beeswarm,
    "predict_batch": q_predict_batch,
    "predict_named": q_predict_named,
    "lgbm_predict": _predict("lgbm"),
    "cat_predict": _predict("cat"),
}

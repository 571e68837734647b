"""Learner catalogue (M1-M7), one-pipeline fit (M8) and scoring (V1, V2, V4).

Presets are written in the original libraries' parameter names.  Forests, the app's
tree, logistic regression and the SVC are mapped to Spark ML by :func:`to_spark_params`
(the §2.14 map); boosted trees (gradient boosting, XGBoost, LightGBM, CatBoost presets)
and the trees that draw features at each node are grown by
:mod:`churnspark.plans.histtrees`, as :func:`to_tree_spec` says.  Parameters without a
counterpart are logged at every fit and returned by ``build_pipeline``.  The RBF SVC
becomes a map by landmarks of the kernel + ``LinearSVC``.
"""

from __future__ import annotations

import logging
import math
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark import schema as S
from churnspark.operators import score as V
from churnspark.plans.features import ChurnFeatures
from churnspark.plans.histtrees import MAX_BINS, HistTreesClassifier, TreeSpec
from churnspark.session import cut_lineage

# ---------------------------------------------------------------------------
# Learner presets in the original parameter names.
# ---------------------------------------------------------------------------

APP_PRESETS = {
    "dt": ("Decision Tree", "tree", dict(class_weight="balanced", criterion="gini", max_depth=5,
                                          min_samples_split=10, min_samples_leaf=5, random_state=42)),
    "rf": ("Random Forest", "forest", dict(class_weight="balanced", criterion="gini", max_depth=10,
                                            min_samples_split=50, min_samples_leaf=20,
                                            max_features="sqrt", n_estimators=100, bootstrap=True,
                                            random_state=42)),
    "gb": ("Gradient Boosting", "boost", dict(learning_rate=0.05, n_estimators=100,
                                               min_samples_split=10, min_samples_leaf=5, max_depth=3,
                                               random_state=42)),
    "xgb": ("XGBoost", "xgb", dict(learning_rate=0.01, max_depth=3, min_child_weight=1,
                                      subsample=0.7, colsample_bytree=0.7, n_estimators=100,
                                      random_state=42)),
    "lgbm": ("LightGBM", "lgbm", dict(learning_rate=0.01, n_estimators=100, max_depth=10,
                                        num_leaves=15, min_child_samples=20, reg_alpha=0.1,
                                        reg_lambda=0.5, random_state=42)),
    "cat": ("CatBoost", "cat", dict(iterations=100, learning_rate=0.05, depth=4, l2_leaf_reg=3,
                                       random_seed=42)),
}

CLI_PRESETS = {
    "decision_tree_gini": ("split_tree", dict(class_weight="balanced", criterion="gini", max_depth=6,
                                        min_samples_split=100, min_samples_leaf=50,
                                        max_features="sqrt", random_state=42)),
    "decision_tree_entropy": ("split_tree", dict(class_weight="balanced", criterion="entropy", max_depth=6,
                                           min_samples_split=100, min_samples_leaf=50,
                                           max_features="sqrt", random_state=42)),
    "rf_basic": ("forest", dict(criterion="entropy", n_estimators=20000, max_depth=15,
                                min_samples_split=100, min_samples_leaf=10, max_features="sqrt",
                                bootstrap=True, oob_score=True, random_state=42)),
    "rf_balanced": ("forest", dict(class_weight="balanced", criterion="entropy", n_estimators=20000,
                                   max_depth=25, min_samples_split=50, min_samples_leaf=5,
                                   max_features="sqrt", bootstrap=True, oob_score=True,
                                   random_state=42)),
    "gb_basic": ("boost", dict(learning_rate=0.1, n_estimators=2000, subsample=0.8,
                               min_samples_split=200, min_samples_leaf=50, max_depth=5,
                               validation_fraction=0.1, tol=0.0001, ccp_alpha=0.0, random_state=42)),
    "gb_tuned": ("boost", dict(learning_rate=0.01, n_estimators=20000, min_samples_split=100,
                               min_samples_leaf=50, max_depth=20, max_features="sqrt",
                               validation_fraction=0.1, n_iter_no_change=1000, tol=0.0001,
                               ccp_alpha=0.0, random_state=42)),
    "xgb_basic": ("xgb", dict(n_estimators=1000, learning_rate=0.1, max_depth=3, subsample=0.8,
                                colsample_bytree=0.8, random_state=42)),
    "xgb_tuned": ("xgb", dict(n_estimators=5000, learning_rate=0.075, max_depth=4,
                                min_child_weight=10, subsample=0.7, colsample_bytree=0.7, gamma=1.0,
                                reg_alpha=0.1, reg_lambda=1.0, random_state=42)),
    "lgbm_basic": ("lgbm", dict(n_estimators=1000, learning_rate=0.1, max_depth=25, num_leaves=7,
                                 subsample=0.8, colsample_bytree=0.8, random_state=42)),
    "lgbm_tuned": ("lgbm", dict(n_estimators=10000, learning_rate=0.075, max_depth=25,
                                 num_leaves=31, min_child_samples=50, min_split_gain=0.01,
                                 subsample=0.7, colsample_bytree=0.7, reg_alpha=0.1, reg_lambda=1.0,
                                 random_state=42)),
    "cat_basic": ("cat", dict(iterations=1000, learning_rate=0.1, depth=3, random_seed=42)),
    "cat_tuned": ("cat", dict(iterations=1000, learning_rate=0.01, depth=12, l2_leaf_reg=3.0,
                                random_strength=1.0, border_count=128, bagging_temperature=1.0,
                                random_seed=42)),
    "svc": ("rbf_svm", dict(kernel="rbf", class_weight="balanced", C=1.0, gamma="scale")),
}

#: Kinds that histtrees grows.
GROWN = ("boost", "xgb", "lgbm", "cat", "split_tree")

#: Levels of a Spark ML tree at most.
MAX_DEPTH = 30
#: Levels of a grown tree that is bounded by its leaves only.
NO_DEPTH = 64

log = logging.getLogger(__name__)

# ---------------------------------------------------------------------------


def to_spark_params(kind: str, params: dict) -> tuple[dict, bool, list[str]]:
    """Map original parameters to Spark ML ones: (spark params, balanced?, ignored names)."""
    out: dict = {}
    ignored = []
    balanced = params.get("class_weight") == "balanced"
    for k, v in params.items():
        if k in ("class_weight",):
            continue
        if k in ("n_estimators", "iterations"):
            out["numTrees" if kind == "forest" else "maxIter"] = int(v)
        elif k in ("max_depth", "depth"):
            if int(v) > MAX_DEPTH:
                raise ValueError(f"{k}={v}: Spark ML trees have {MAX_DEPTH} levels at most")
            out["maxDepth"] = min(int(v), out.get("maxDepth", MAX_DEPTH))
        elif k in ("min_samples_leaf", "min_child_samples"):
            out["minInstancesPerNode"] = max(int(v), out.get("minInstancesPerNode", 1))
        elif k == "max_features":
            if v is None:
                out["featureSubsetStrategy"] = "all"
            elif isinstance(v, str):
                out["featureSubsetStrategy"] = v
            else:
                out["featureSubsetStrategy"] = str(float(v))
        elif k == "subsample":
            out["subsamplingRate"] = float(v)
        elif k == "criterion":
            if kind in ("tree", "forest"):
                out["impurity"] = v
        elif k in ("gamma", "min_split_gain"):
            if kind == "rbf_svm":
                out["gamma"] = v
            else:
                out["minInfoGain"] = float(v)
        elif k in ("random_state", "random_seed"):
            out["seed"] = int(v)
        elif k == "max_iter":
            out["maxIter"] = int(v)
        elif k == "C":
            out["C"] = float(v)      # becomes regParam = 1 / (C * rows) once the rows are known
        else:
            ignored.append(k)
    return out, balanced, sorted(ignored)


#: What the libraries take where a preset says nothing: fixed values.
_GROWN_DEFAULTS = {
    "boost": dict(learning_rate=0.1, n_estimators=100, max_depth=3, min_samples_split=2, min_samples_leaf=1, tol=1e-4, validation_fraction=0.1),
    "xgb": dict(learning_rate=0.3, n_estimators=100, max_depth=6, min_child_weight=1, reg_lambda=1.0),
    "lgbm": dict(learning_rate=0.1, n_estimators=100, max_depth=-1, num_leaves=31, min_child_samples=20, min_child_weight=1e-3),
    "cat": dict(learning_rate=0.03, iterations=1000, depth=6, l2_leaf_reg=3.0),
    "split_tree": dict(criterion="gini", max_depth=None, min_samples_split=2, min_samples_leaf=1),
}


def to_tree_spec(kind: str, params: dict) -> tuple[TreeSpec, int, list[str]]:
    """Map original parameters to a TreeSpec: (spec, bins, ignored names).

    sklearn's boosting fits the residuals by least squares; the others take second-order
    gains.  CatBoost's trees split a whole level alike, LightGBM's grow best leaf first."""
    p = dict(_GROWN_DEFAULTS[kind], **params)
    if kind == "lgbm" and "n_estimators" not in params and "iterations" in params:
        p["n_estimators"] = params["iterations"]
    spec: dict = {"criterion": {"boost": "variance", "split_tree": p.pop("criterion", "gini")}.get(kind, "newton"), "symmetric": kind == "cat"}
    bins, ignored = MAX_BINS, []
    names = {"learning_rate": "learning_rate", "subsample": "subsample", "colsample_bytree": "colsample", "reg_alpha": "reg_alpha", "reg_lambda": "reg_lambda",
             "l2_leaf_reg": "reg_lambda", "gamma": "min_gain", "min_split_gain": "min_gain", "bagging_temperature": "temperature"}
    for k, v in p.items():
        if k in names:
            spec[names[k]] = float(v)
        elif k in ("n_estimators", "iterations"):
            spec["rounds"] = int(v)
        elif k in ("max_depth", "depth"):
            spec["max_depth"] = int(v) if v is not None and int(v) > 0 else NO_DEPTH
        elif k == "num_leaves":
            spec["num_leaves"] = int(v)
        elif k in ("min_samples_leaf", "min_child_samples"):
            spec["min_leaf"] = int(v)
        elif k == "min_samples_split":
            spec["min_split"] = int(v)
        elif k == "min_child_weight":
            spec["min_hessian"] = float(v)
        elif k == "max_features":
            spec["node_features"] = v
        elif k == "border_count":
            bins = int(v) + 1
        elif k in ("random_state", "random_seed"):
            spec["seed"] = int(v)
        elif k == "class_weight":
            spec["balanced"] = v == "balanced"
        elif k == "n_iter_no_change":
            if v is not None:
                spec.update(patience=int(v), tol=float(p["tol"]), val_share=float(p["validation_fraction"]))
        elif k in ("tol", "validation_fraction") or (k == "ccp_alpha" and not v):
            continue
        else:
            ignored.append(k)
    return TreeSpec(**spec), bins, sorted(ignored)


def grown_spec(key: str, overrides: dict | None = None) -> tuple[TreeSpec, int] | None:
    """The TreeSpec and bins of a learner that histtrees grows; None for any other."""
    kind, params = catalogue()[key]
    if kind not in GROWN:
        return None
    spec, bins, _ = to_tree_spec(kind, dict(params, **(overrides or {})))
    return spec, bins


def make_classifier(kind: str, sp: dict, weight_col: str | None = None,
                    features_col: str = "features", label_col: str = "label"):
    common = dict(featuresCol=features_col, labelCol=label_col)
    if kind == "tree":
        clf = DecisionTreeClassifier(**common)
    elif kind == "forest":
        clf = RandomForestClassifier(**common)
    elif kind == "logistic":
        clf = LogisticRegression(**common)
    elif kind == "rbf_svm":
        clf = LinearSVC(**common)
    else:
        raise ValueError(f"unknown learner kind {kind!r}")
    valid = {p.name for p in clf.params}
    clf.setParams(**{k: v for k, v in sp.items() if k in valid})
    if weight_col and "weightCol" in valid:
        clf.setWeightCol(weight_col)
    return clf


def catalogue() -> dict[str, tuple[str, dict]]:
    """M7: every learner key -> (kind, original params): 6 app + 13 CLI keys."""
    out = {k: (kind, p) for k, (_, kind, p) in APP_PRESETS.items()}
    out.update(CLI_PRESETS)
    out["logreg"] = ("logistic", dict(max_iter=200))
    return out


def subset(keys) -> dict:
    """M7: the catalogue restricted to ``keys``; unknown keys raise."""
    cat = catalogue()
    missing = [k for k in keys if k not in cat]
    if missing:
        raise KeyError(f"unknown model keys: {missing}; known: {sorted(cat)}")
    return {k: cat[k] for k in keys}


# ------------------------------------------------------------- M5: RBF features

class LandmarkKernelMap(Estimator, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Nystroem features of an RBF kernel (Williams & Seeger, 2001): inner products of the
    mapped rows are the kernel, exactly between landmarks and nearly elsewhere.

    The landmarks are the ``numLandmarks`` distinct rows with the smallest hashes (a bounded
    sample; all rows, if there are fewer).  z(x) = k(x, landmarks) K^(-1/2), without the
    directions in which K has next to no weight.  ``gamma='scale'`` = 1 / (n_features *
    variance of all matrix entries), from one aggregate.
    """

    numLandmarks = Param(Params._dummy(), "numLandmarks", "landmarks at most", typeConverter=TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "'scale' or a number", typeConverter=TypeConverters.toString)

    def __init__(self, inputCol="features", outputCol="kernel_map", numLandmarks=200, gamma="scale", seed=42):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, numLandmarks=numLandmarks, gamma=str(gamma), seed=seed)

    def _fit(self, df: DataFrame) -> "LandmarkKernelModel":
        rows = df.select(vector_to_array(F.col(self.getInputCol())).alias("x"))
        m = self.getOrDefault("numLandmarks")
        hashed = rows.select("x", F.xxhash64(F.lit(self.getSeed()), "x").alias("h"))
        marks = np.array([r["x"] for r in hashed.distinct().orderBy("h", "x").limit(m).collect()], float)   # m rows
        g = self.getOrDefault("gamma")
        if g == "scale":
            var = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v").alias("var")).first()["var"]
            gamma = 1.0 / (marks.shape[1] * var) if var else 1.0
        else:
            gamma = float(g)
        weight, axes = np.linalg.eigh(rbf_kernel(marks, marks, gamma))
        some = weight > 1e-10 * weight[-1]
        whiten = axes[:, some] / np.sqrt(weight[some])
        model = LandmarkKernelModel(marks, whiten, gamma)
        return model._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol())


def rbf_kernel(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(d, 0))


class LandmarkKernelModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    landmarks = Param(Params._dummy(), "landmarks", "landmarks, row-major", typeConverter=TypeConverters.toListFloat)
    whitening = Param(Params._dummy(), "whitening", "landmarks by directions, row-major", typeConverter=TypeConverters.toListFloat)
    shape = Param(Params._dummy(), "shape", "landmarks, input and output dimension", typeConverter=TypeConverters.toListInt)
    gamma = Param(Params._dummy(), "gamma", "of the kernel", typeConverter=TypeConverters.toFloat)

    def __init__(self, marks=None, whiten=None, gamma=None):
        super().__init__()
        if marks is not None:
            self._set(landmarks=marks.ravel().tolist(), whitening=whiten.ravel().tolist(), shape=[len(marks), marks.shape[1], whiten.shape[1]], gamma=gamma)

    def _transform(self, df: DataFrame) -> DataFrame:
        n, p, q = self.getOrDefault("shape")
        marks = np.asarray(self.getOrDefault("landmarks")).reshape(n, p)
        whiten, gamma = np.asarray(self.getOrDefault("whitening")).reshape(n, q), self.getOrDefault("gamma")

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def mapped(x: pd.Series) -> pd.Series:
            return pd.Series(list(rbf_kernel(np.stack(x.to_numpy()), marks, gamma) @ whiten) if len(x) else [])

        return df.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(F.col(self.getInputCol())))))


# ------------------------------------------------------------------ M8, V1, V4

def build_pipeline(key: str, features: ChurnFeatures | None = None, overrides: dict | None = None,
                   weight_col: str | None = None, n_rows: int | None = None) -> tuple[Pipeline, list[str]]:
    """M8: features -> (RBF map) -> classifier, as one Spark ML Pipeline, and the ignored parameters.

    ``n_rows``: training rows (balanced weights sum to them too), for the SVC's C.
    """
    kind, params = catalogue()[key]
    params = dict(params, **(overrides or {}))
    if kind in GROWN:
        spec, bins, ignored = to_tree_spec(kind, params)
        if ignored:
            log.warning("%s: no counterpart for %s", key, ", ".join(ignored))
        return Pipeline(stages=[features or ChurnFeatures(), HistTreesClassifier(spec, maxBins=bins)]), ignored
    sp, balanced, ignored = to_spark_params(kind, params)
    if ignored:
        log.warning("%s: no Spark ML counterpart for %s", key, ", ".join(ignored))
    if "C" in sp and n_rows:
        sp["regParam"] = 1.0 / (sp["C"] * n_rows)
    feats = features or ChurnFeatures()
    stages = [feats]
    fcol = "features"
    if kind == "rbf_svm":
        gamma = sp.pop("gamma", "scale")
        stages.append(LandmarkKernelMap("features", "kernel_map", gamma=gamma))
        fcol = "kernel_map"
    w = weight_col if (balanced and weight_col) else None
    stages.append(make_classifier(kind, sp, w, features_col=fcol))
    return Pipeline(stages=stages), ignored


def training_columns(train: DataFrame) -> DataFrame:
    """X5 weights in ``weight`` and ones in ``unit_weight``."""
    from churnspark.operators.split import class_weights
    return class_weights(train).withColumn("unit_weight", F.lit(1.0))


def prepare(key: str, train: DataFrame, features=None, overrides: dict | None = None):
    """The estimator and its training rows: weights for 'balanced', the SVC's C.  Grown trees see to their weights and early stopping themselves."""
    kind, params = catalogue()[key]
    params = dict(params, **(overrides or {}))
    balanced = params.get("class_weight") == "balanced" and kind not in GROWN
    n_rows = train.count() if kind == "rbf_svm" else None
    pipe, _ = build_pipeline(key, features, overrides, "weight" if balanced else None, n_rows)
    return pipe, training_columns(train) if balanced else train


def fit(key: str, train: DataFrame, features: ChurnFeatures | None = None,
        overrides: dict | None = None) -> PipelineModel:
    """Fit one pipeline; 'balanced' presets get X5 weights in a ``weight`` column."""
    return fit_persisted(*prepare(key, train, features, overrides))


def fit_vectors(key: str, features: Model, vectors: DataFrame, overrides: dict | None = None) -> PipelineModel:
    """Fit the learner on rows that the fitted feature stage has encoded (resampled
    ones, say); the result scores raw rows like any other pipeline."""
    pipe, data = prepare(key, vectors, features, overrides)
    return PipelineModel([features, *fit_persisted(Pipeline(stages=pipe.getStages()[1:]), data).stages])


def fit_persisted(pipeline: Pipeline, data: DataFrame) -> PipelineModel:
    """Fit with the input persisted for the many passes of an iterative fit
    (feature statistics, tree levels, boosting rounds), then release it.

    The classifier reads encoded rows that are cut off from the plan that encoded them: each
    of its jobs would send that plan to the tasks, and a model with a training summary would
    keep it and send it along whenever it scores."""
    *before, last = pipeline.getStages()
    with persisted(data):
        models, rows = [], data
        if before:
            models = Pipeline(stages=before).fit(data).stages
            rows = cut_lineage(training_rows(PipelineModel(models).transform(data), last))
    with persisted(rows):
        return PipelineModel([*models, last.fit(rows)])


def training_rows(encoded: DataFrame, classifier) -> DataFrame:
    """The columns that the classifier reads, and the key."""
    names = [*({S.KEY} & set(encoded.columns)), *(classifier.getOrDefault(p) for p in ("labelCol", "featuresCol", "weightCol") if classifier.hasParam(p) and classifier.isDefined(p))]
    return encoded.select(*dict.fromkeys(names))


@contextmanager
def persisted(data: DataFrame):
    """The rows persisted, unless they are already, and released afterwards."""
    from pyspark import StorageLevel
    if data.storageLevel.useMemory or data.storageLevel.useDisk:
        yield
        return
    data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield
    finally:
        data.unpersist()


def score(model: PipelineModel, df: DataFrame, out: str = "score", keep=None, bounds=None) -> DataFrame:
    """V1/V2: P(churn) column; margin-only models are min-max scaled by ``bounds``, else over the batch."""
    scored = model.transform(df)
    if "probability" in scored.columns:
        scored = scored.withColumn(out, V.positive_probability("probability"))
    else:
        scored = scored.withColumn("_margin", vector_to_array(F.col("rawPrediction"))[1])
        scored = V.minmax_score(scored, "_margin", out, bounds)
    if keep is not None:
        scored = scored.select(*keep, out)
    return scored


def margin_bounds(model: PipelineModel, train: DataFrame) -> tuple:
    """Smallest and largest margin on the training rows."""
    scored = model.transform(train).withColumn("_margin", vector_to_array(F.col("rawPrediction"))[1])
    return V.fit_minmax(scored, "_margin")


def predict_batch(model, df: DataFrame, threshold: float = S.DEFAULT_THRESHOLD,
                  key: str = S.KEY, bounds=None) -> DataFrame:
    """V4: key, prediction (score >= threshold) and probability for new customers."""
    s = score(model, df, keep=[key], bounds=bounds) if isinstance(model, PipelineModel) else \
        model.transform(df).select(key, "score")
    return s.select(key, (F.col("score") >= threshold).cast("int").alias("prediction"),
                    F.col("score").alias("probability"))

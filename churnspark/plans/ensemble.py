"""Ensembles (M13-M17): soft voting, stacking, isotonic calibration.

Members never meet through a join: each fitted member transforms the same
frame in turn, its P(churn) lands in its own column and the input columns are
restored from a packed struct, so a whole ensemble is one narrow plan
(``(p_1 + ... + p_n) / n`` for voting, a logistic regression over the member
columns for stacking).  Ensemble models save/load like any model (a folder
with one sub-folder per member plus a JSON manifest).
"""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.operators import metrics as M
from churnspark.operators import score as V
from churnspark.plans import learners as L
from churnspark.plans import tune as T
from churnspark.plans.features import ChurnFeatures
from churnspark.plans.histtrees import fit_specs
from churnspark.session import cut_lineage, materialize


def add_member_score(df: DataFrame, model, out: str) -> DataFrame:
    """Append ``out`` = P(churn) of ``model`` (a pipeline or an ensemble) while keeping ``df``'s columns intact."""
    cols = df.columns
    if not isinstance(model, PipelineModel):
        return model.transform(df, out).select(*[F.col(f"`{c}`") for c in cols], out)
    packed = df.withColumn("_orig", F.struct(*[F.col(f"`{c}`") for c in cols]))
    scored = L.score(model, packed, out="_p")
    return scored.select(*[F.col("_orig")[c].alias(c) for c in cols], F.col("_p").alias(out))


class VotingModel:
    """Mean probability of the members."""

    def __init__(self, members: dict):
        self.members = dict(members)

    def member_scores(self, df: DataFrame) -> DataFrame:
        out = df
        for name, m in self.members.items():
            out = add_member_score(out, m, f"p_{name}")
        return out

    def transform(self, df: DataFrame, out: str = "score") -> DataFrame:
        s = self.member_scores(df)
        return V.soft_vote(s, [f"p_{n}" for n in self.members], out)

    def save(self, path: str):
        _save_members(path, "voting", self.members, {})

    @staticmethod
    def load(path: str) -> "VotingModel":
        man, members = _load_members(path)
        return VotingModel(members)


class StackingModel:
    """Base models refit on all rows + logistic regression on their scores."""

    def __init__(self, members: dict, meta: LogisticRegressionModel):
        self.members = dict(members)
        self.meta = meta

    def transform(self, df: DataFrame, out: str = "score") -> DataFrame:
        s = VotingModel(self.members).member_scores(df)
        cols = [f"p_{n}" for n in self.members]
        meta_in = VectorAssembler(inputCols=cols, outputCol="_meta_x").transform(s)
        scored = self.meta.transform(meta_in)
        return scored.withColumn(out, V.positive_probability("probability")) \
            .drop("_meta_x", "rawPrediction", "probability", "prediction")

    def save(self, path: str):
        _save_members(path, "stacking", self.members, {})
        self.meta.write().overwrite().save(os.path.join(path, "_meta"))

    @staticmethod
    def load(path: str) -> "StackingModel":
        _, members = _load_members(path)
        return StackingModel(members, LogisticRegressionModel.load(os.path.join(path, "_meta")))


class CalibratedModel:
    """Mean over folds of isotonic(base_f(x)) (each calibrator fitted on its
    own held-out fold)."""

    def __init__(self, parts: list):
        self.parts = list(parts)     # [(PipelineModel, IsotonicRegressionModel)]

    def transform(self, df: DataFrame, out: str = "score") -> DataFrame:
        s = df
        cols = []
        for i, (base, iso) in enumerate(self.parts):
            s = add_member_score(s, base, f"_raw{i}")
            s = iso.setFeaturesCol(f"_raw{i}").setPredictionCol(f"_cal{i}").transform(s)
            cols.append(f"_cal{i}")
        s = V.soft_vote(s, cols, out)
        return s.drop(*cols, *[f"_raw{i}" for i in range(len(self.parts))])

    def save(self, path: str):
        _save_members(path, "calibrated", {f"base{i}": b for i, (b, _) in enumerate(self.parts)},
                      {"n": len(self.parts)})
        for i, (_, iso) in enumerate(self.parts):
            iso.write().overwrite().save(os.path.join(path, f"_iso{i}"))

    @staticmethod
    def load(path: str) -> "CalibratedModel":
        man, members = _load_members(path)
        parts = [(members[f"base{i}"], IsotonicRegressionModel.load(os.path.join(path, f"_iso{i}")))
                 for i in range(man["extra"]["n"])]
        return CalibratedModel(parts)


def _save_members(path: str, kind: str, members: dict, extra: dict):
    for name, m in members.items():
        if isinstance(m, PipelineModel):
            m.write().overwrite().save(os.path.join(path, name))
        else:
            m.save(os.path.join(path, name))
    manifest = {"kind": kind, "members": list(members), "extra": extra}
    from pyspark.sql import SparkSession
    ss = SparkSession.getActiveSession()
    ss.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1) \
        .write.mode("overwrite").text(os.path.join(path, "_manifest"))


def _load_members(path: str):
    from pyspark.sql import SparkSession
    ss = SparkSession.getActiveSession()
    man = json.loads(ss.read.text(os.path.join(path, "_manifest")).first()[0])
    return man, {n: load_any(os.path.join(path, n)) for n in man["members"]}


def load_any(path: str):
    """Load a saved PipelineModel or ensemble (E17 promotes either kind)."""
    from pyspark.sql import SparkSession
    ss = SparkSession.getActiveSession()
    manifest = ss._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_manifest"))
    if not manifest.getFileSystem(ss._jsc.hadoopConfiguration()).exists(manifest):   # not an ensemble folder
        return PipelineModel.load(path)
    kind = json.loads(ss.read.text(os.path.join(path, "_manifest")).first()[0])["kind"]
    return {"voting": VotingModel, "stacking": StackingModel,
            "calibrated": CalibratedModel}[kind].load(path)


# ------------------------------------------------------------------ fitting

def fit_voting(keys, train: DataFrame, overrides: dict | None = None) -> VotingModel:
    """Fit every member on the (possibly resampled) rows, average their scores."""
    return VotingModel({k: L.fit(k, train, overrides=(overrides or {}).get(k)) for k in keys})


def _fit_member(key: str, rows: DataFrame, overrides, features):
    """A member on raw rows, or with ``features`` on rows that stage has encoded (then a
    model of encoded rows, see ``_whole``)."""
    if features is None:
        return L.fit(key, rows, overrides=overrides)
    return PipelineModel(L.fit_vectors(key, features, rows, overrides).stages[1:])


def grow_members(keys, rows: DataFrame, overrides: dict, folds) -> dict:
    """Those of the learners that histtrees grows, fitted on encoded rows, all together: (key, f)
    is trained without fold f of the rows' fold column, (key, None) on all rows."""
    by_bins: dict[int, list] = {}
    for key in keys:
        found = L.grown_spec(key, overrides.get(key))
        if found:
            by_bins.setdefault(found[1], []).extend(((key, f), replace(found[0], held_out=f)) for f in folds)
    fold = F.col(T.FOLD) if T.FOLD in rows.columns else F.lit(-2).alias(T.FOLD)
    data = rows.select(S.KEY, "label", fold, vector_to_array("features").alias("x0"))
    return {name: PipelineModel([model]) for bins, mine in by_bins.items()
            for (name, _), model in zip(mine, fit_specs(data, [spec for _, spec in mine], bins), strict=True)}


def _whole(model, features):
    """The model for raw rows."""
    return model if features is None else PipelineModel([features, *model.stages])


def _encoded_fold(folded: DataFrame, f: int, features):
    """The feature stage of a fold and all rows as it encodes them: ``features`` has encoded
    them, or a stage fitted on the other folds does, once for all members."""
    if features is not None:
        return features, folded
    stage = ChurnFeatures().fit(folded.where(F.col(T.FOLD) != f))
    return stage, cut_lineage(stage.transform(folded).select(S.KEY, "label", T.FOLD, "features"))


def fit_stacking(keys, train: DataFrame, k: int = 5, overrides: dict | None = None,
                 max_iter: int = 200, parallelism: int = 2, features=None, fitted: dict | None = None) -> StackingModel:
    """Out-of-fold member scores (fold by fold, member after member on the same
    held-out frame) -> LogisticRegression; members refit on all rows.

    The k folds, and then the member refits, run as independent jobs, up to
    ``parallelism`` at once.  With ``features``, a fitted feature stage, ``train``
    holds rows that it has encoded (resampled ones, say); else every fold has its own.
    ``fitted``: the members, if they were fitted on the rows of ``train`` already."""
    overrides = overrides or {}
    keys = list(keys)
    others = [key for key in keys if not L.grown_spec(key, overrides.get(key))]
    folded = T.with_folds(train, k)

    def fold_part(f: int) -> DataFrame:
        stage, rows = _encoded_fold(folded, f, features)
        fit_rows = rows.where(F.col(T.FOLD) != f).drop(T.FOLD)
        mine = {} if features is not None else {key: m for (key, _), m in grow_members(keys, fit_rows, overrides, [None]).items()}
        held = rows.where(F.col(T.FOLD) == f).select(S.KEY, "label", "features")
        with L.persisted(fit_rows):
            mine.update((key, _fit_member(key, fit_rows, overrides.get(key), stage)) for key in others)
            if growing is not None:
                mine.update((key, m) for (key, fold), m in growing.result().items() if fold == f)
            for key in keys:
                held = add_member_score(held, mine[key], f"p_{key}")
        return held.select(S.KEY, "label", *[f"p_{key}" for key in keys])

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism) + 1) as ex:      # trees grow beside the other fits
            growing = ex.submit(grow_members, keys, folded, overrides, [*range(k), *([] if fitted else [None])]) if features is not None else None
            parts = list(ex.map(fold_part, range(k)))
        grown = growing.result() if growing is not None else {}
        oof = parts[0]
        for p in parts[1:]:
            oof = oof.unionByName(p)
        oof = cut_lineage(oof)
    finally:
        folded.unpersist()
    x = VectorAssembler(inputCols=[f"p_{key}" for key in keys],
                        outputCol="_meta_x").transform(oof)
    with L.persisted(x):
        meta = LogisticRegression(featuresCol="_meta_x", labelCol="label",
                                  maxIter=max_iter).fit(x)
    if fitted:
        return StackingModel({key: fitted[key] for key in keys}, meta)
    if features is None:
        features = ChurnFeatures().fit(train)
        train = cut_lineage(features.transform(train).select(S.KEY, "label", "features"))
        grown = grow_members(keys, train, overrides, [None])
    with L.persisted(train), ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        members = list(ex.map(lambda key: _whole(grown.get((key, None)) or _fit_member(key, train, overrides.get(key), features), features), keys))
    return StackingModel(dict(zip(keys, members)), meta)


def fit_calibrated(base, train: DataFrame, cv: int = 3, overrides=None,
                   parallelism: int = 2, features=None) -> CalibratedModel:
    """Per fold, fit the base on the other folds and an isotonic map on this one.

    ``base`` is a learner's key, or a function from rows to a fitted model (an
    ensemble, say).  Folds are independent Spark jobs; up to ``parallelism`` of them
    run at once (as ``CrossValidator(parallelism=...)`` does), each with its own
    persisted input.  ``features``: as in :func:`fit_stacking`.
    """
    folded = T.with_folds(train, cv)
    grown = grow_members([base], folded, {base: overrides}, range(cv)) if features is not None and not callable(base) else {}

    def one(f: int):
        if callable(base):
            stage, rows = features, folded
            whole = base(rows.where(F.col(T.FOLD) != f).drop(T.FOLD))
        else:
            stage, rows = _encoded_fold(folded, f, features)
            fit_rows = rows.where(F.col(T.FOLD) != f).drop(T.FOLD)
            mine = grown.get((base, f)) if features is not None else grow_members([base], fit_rows, {base: overrides}, [None]).get((base, None))
            whole = _whole(mine or _fit_member(base, fit_rows, overrides, stage), stage)
        scorer = whole if stage is None else encoded_part(whole)       # held-out rows are encoded already
        held = add_member_score(rows.where(F.col(T.FOLD) == f).drop(T.FOLD), scorer, "score").select("label", "score")
        iso = IsotonicRegression(featuresCol="score", labelCol="label", isotonic=True).fit(held)
        return whole, iso

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
            parts = list(ex.map(one, range(cv)))
    finally:
        folded.unpersist()
    return CalibratedModel(parts)


def encoded_part(model):
    """The part of a model after its feature stage, to score encoded rows."""
    if isinstance(model, PipelineModel):
        return PipelineModel(model.stages[1:])
    if isinstance(model, CalibratedModel):
        return CalibratedModel([(encoded_part(base), iso) for base, iso in model.parts])
    members = {n: encoded_part(m) for n, m in model.members.items()}
    return StackingModel(members, model.meta) if isinstance(model, StackingModel) else VotingModel(members)


def evaluate(model, df: DataFrame, name: str, threshold: float = S.DEFAULT_THRESHOLD) -> DataFrame:
    """Metric row of an ensemble (or any model) at the threshold."""
    s = model.transform(df) if not isinstance(model, PipelineModel) else L.score(model, df)
    s = materialize(s.select("label", "score"))
    return M.metric_table(s, threshold=threshold).withColumn("model", F.lit(name))

"""The composed training flow (M18) and best-model promotion."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.operators import metrics as M
from churnspark.operators import resample
from churnspark.plans import ensemble as EN
from churnspark.plans import learners as L
from churnspark.plans import tune as T
from churnspark.plans.features import ChurnFeatures
from churnspark.plans.histtrees import PART_ROWS
from churnspark.session import cut_lineage, default_buckets, materialize


@dataclass
class FlowPlan:
    """What a training flow does, step by step.

    An empty or zero entry leaves the step out.
    """

    learners: tuple = ("dt", "rf", "gb")
    search_trials: int = 0             # M12 trials for each learner that has a search space
    oversample: str | None = None      # "smote" or "adasyn", on the encoded training rows
    ensembles: tuple = ("voting", "stacking")
    folds: int = 5                     # of the search and of stacking
    calibration_folds: int = 3
    rank_by: str = "pr_auc"
    seed: int = S.SEED
    jobs: int = 4                      # independent fits at once
    overrides: dict = field(default_factory=dict)


@dataclass
class FlowResult:
    models: dict
    comparison: DataFrame
    best_name: str


_SAMPLERS = {"smote": resample.smote, "adasyn": resample.adasyn}


def train_flow(train: DataFrame, test: DataFrame, plan: FlowPlan | None = None) -> FlowResult:
    """Search, oversample, fit the learners, build ensembles, calibrate whichever
    model leads, and compare all of them on ``test``.

    The feature stage is fitted once, and every learner is fitted on its vectors;
    stacking and calibration see the same (oversampled) rows.
    """
    plan = plan or FlowPlan()
    over = dict(plan.overrides)
    if plan.search_trials:
        for key in plan.learners:
            if key in T.SEARCH_SPACES:
                over[key], _ = T.model_search(key, train, plan.search_trials, plan.folds, plan.seed)
    features = ChurnFeatures().fit(train)
    rows = features.transform(train).select(S.KEY, "label", "features")
    if plan.oversample:
        rows = _SAMPLERS[plan.oversample.lower()](rows, seed=plan.seed)
    rows = materialize(_dealt(rows))
    held = materialize(cut_lineage(features.transform(test).select(S.KEY, "label", "features")))

    def members(data: DataFrame) -> dict:
        others = [key for key in plan.learners if not L.grown_spec(key, over.get(key))]
        with ThreadPoolExecutor(max_workers=max(1, plan.jobs) + 1) as pool:      # trees grow beside the other fits
            growing = pool.submit(EN.grow_members, plan.learners, data, over, [None])
            fitted = dict(zip(others, pool.map(lambda key: L.fit_vectors(key, features, data, over.get(key)), others)))
            fitted |= {key: PipelineModel([features, *m.stages]) for (key, _), m in growing.result().items()}
        return {key: fitted[key] for key in plan.learners}

    def build(name: str, data: DataFrame, base: dict | None = None):
        if name == "soft_voting":
            return EN.VotingModel(base or members(data))
        return EN.fit_stacking(list(plan.learners), data, k=plan.folds, overrides=over,
                               parallelism=plan.jobs, features=features, fitted=base)

    try:
        models = members(rows)
        if len(plan.learners) > 1:
            for kind, name in (("voting", "soft_voting"), ("stacking", "stacking")):
                if kind in plan.ensembles:
                    models[name] = build(name, rows, {k: models[k] for k in plan.learners})
        table, scores = _compare(models, held)
        if plan.calibration_folds:
            lead = _best(table, plan.rank_by)
            base = lead if lead in plan.learners else (lambda data: build(lead, data))
            name = f"{lead}_calibrated"
            models[name] = EN.fit_calibrated(
                base, rows, cv=plan.calibration_folds, overrides=over.get(lead), parallelism=plan.jobs, features=features)
            table, _ = _metric_rows([scores, *_scored({name: models[name]}, held)])
            scores.unpersist()
    finally:
        rows.unpersist()
        held.unpersist()
    comparison = table.orderBy(F.col(plan.rank_by).desc_nulls_last(), "model")
    return FlowResult(models, comparison, _best(table, plan.rank_by))


#: Rows of a partition at least: a task of a fit sends on sums for all nodes or coefficients, however few rows it has.
FIT_ROWS = 32_768


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows in partitions by key, as many as there are cores where that leaves each FIT_ROWS, and more beyond PART_ROWS each."""
    rows = cut_lineage(rows)
    n = rows.count()
    parts = max(min(-(-n // FIT_ROWS), default_buckets(rows.sparkSession, factor=1, floor=1)), -(-n // PART_ROWS), 1)
    return rows.repartition(parts, S.KEY).sortWithinPartitions(S.KEY)


def _compare(models: dict, held: DataFrame):
    """Metric row of each model, and the scores it comes from; the feature stage has encoded the rows."""
    return _metric_rows(_scored(models, held))


def _scored(models: dict, held: DataFrame) -> list[DataFrame]:
    return [EN.add_member_score(held, EN.encoded_part(m), "score").select(F.lit(name).alias("model"), "label", "score")
            for name, m in models.items()]


def _metric_rows(scored):
    """Metric table per model over the materialised union of scores (returned too)."""
    u = scored[0]
    for s in scored[1:]:
        u = u.unionByName(s)
    u = materialize(u)
    return materialize(M.metric_table(u, groups=["model"])), u     # a row for each model


def _best(table: DataFrame, metric: str) -> str:
    row = M.pick_best(table, metric, "model").first()
    if row is None:
        raise ValueError(f"no model has metric {metric!r}")
    return row["model"]


def predict_named(df: DataFrame, models_dir: str, name: str | None = None,
                  threshold: float = S.DEFAULT_THRESHOLD, out_path: str | None = None) -> DataFrame:
    """V4: score new customers with the model saved under ``models_dir/name`` (the promoted
    one without a name), and write the predictions (S3) if ``out_path`` is given."""
    from churnspark.sources import io
    path = os.path.join(models_dir, name or "best")
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"no model at {path}")
    scored = L.predict_batch(EN.load_any(path), df, threshold)
    if out_path:
        io.write_predictions(scored, out_path, score="probability")
    return scored


def promote_best(models: dict, table: DataFrame, out_dir: str, metric: str = "pr_auc") -> str:
    """Save the winner (ensembles included) under ``out_dir/best``; return its name."""
    name = _best(table, metric)
    target = os.path.join(out_dir, "best")
    model = models[name]
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(target)
    else:
        model.save(target)
    spark = table.sparkSession
    spark.createDataFrame([(name, metric)], "name string, metric string").coalesce(1) \
        .write.mode("overwrite").json(os.path.join(out_dir, "best_name"))
    return name

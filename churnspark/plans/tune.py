"""Cross-validation and hyper-parameter search.

Folds come from the repeatable fold column (X3); every fit refits the whole
pipeline - feature statistics included - inside the fold, so nothing leaks
from held-out rows.  When the candidates differ only in classifier
parameters, :class:`SharedPrefixPipeline` fits those fold statistics once per
fold and reuses the fold's feature vectors for every candidate; candidates that
:mod:`churnspark.plans.histtrees` grows are grown on all folds at once.  Metrics are the exact distributed ones of
:mod:`churnspark.operators.metrics`.
"""

from __future__ import annotations

import itertools
import math
import random
import statistics
import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasLabelCol, Param, Params, TypeConverters
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.operators import metrics as M
from churnspark.operators import split
from churnspark.plans import learners as L
from churnspark.plans.features import ChurnFeatures
from churnspark.plans.histtrees import FOLD, grower
from churnspark.session import cut_lineage, materialize


class SharedPrefixPipeline(Pipeline):
    """A Pipeline whose ``fitMultiple`` (the call CrossValidator makes per fold)
    fits the stages before the classifier once when every param map only sets
    classifier params, then fits one classifier per map on the persisted
    vectors.  Same models as refitting the whole pipeline per map.

    Every fit first adds the X5 weights of its own rows (``weight``, and ones in
    ``unit_weight``)."""

    def _fit(self, dataset):
        return super()._fit(L.training_columns(dataset))

    def fitMultiple(self, dataset, paramMaps):
        stages = self.getStages()
        last = stages[-1]
        if len(stages) < 2 or any(p.parent != last.uid for pm in paramMaps for p in pm):
            return super().fitMultiple(dataset, paramMaps)
        return _PrefixFits(stages, L.training_columns(dataset), list(paramMaps))


class _PrefixFits:
    """Thread-safe iterator of (index, PipelineModel), as ``fitMultiple`` returns."""

    def __init__(self, stages, dataset, maps):
        self._stages, self._data, self._maps = stages, dataset, maps
        self._lock = threading.Lock()
        self._next = self._done = 0
        self._prefix = self._vectors = None

    def __iter__(self):
        return self

    def __next__(self):
        with self._lock:
            if self._next >= len(self._maps):
                raise StopIteration
            i = self._next
            self._next += 1
            if self._prefix is None:
                self._prefix = Pipeline(stages=self._stages[:-1]).fit(self._data)
                self._vectors = self._prefix.transform(self._data) \
                    .persist(StorageLevel.MEMORY_AND_DISK)
        try:
            clf = self._stages[-1].copy(self._maps[i]).fit(self._vectors)
        finally:
            with self._lock:
                self._done += 1
                if self._done == len(self._maps):
                    self._vectors.unpersist()
        return i, PipelineModel(self._prefix.stages + [clf])


class ExactMetricEvaluator(Evaluator, HasLabelCol):
    """Evaluator running the exact curve/point metrics (AP, not Spark's PR area)."""
    metricName = Param(Params._dummy(), "metricName", "roc_auc, pr_auc, accuracy, f1, brier",
                       typeConverter=TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "probability vector column",
                           typeConverter=TypeConverters.toString)

    def __init__(self, metricName: str = "roc_auc", labelCol: str = "label",
                 probabilityCol: str = "probability"):
        super().__init__()
        self._set(metricName=metricName, labelCol=labelCol, probabilityCol=probabilityCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        # a margin-only learner (SVC) is ranked by its margin
        col = self.getOrDefault("probabilityCol")
        col = col if col in dataset.columns else "rawPrediction"
        s = dataset.select(F.col(self.getLabelCol()).alias("label"), vector_to_array(F.col(col))[1].alias("score"))
        name = self.getOrDefault("metricName")
        s = materialize(s)
        try:
            row = M.metric_table(s).first()
        finally:
            s.unpersist()
        v = None if row is None else row[name]
        if v is None or math.isnan(v):
            raise ValueError(f"{name} is undefined on a fold: it needs rows of both classes")
        return float(v)

    def isLargerBetter(self) -> bool:
        return self.getOrDefault("metricName") != "brier"


def with_folds(df: DataFrame, k: int, seed: int = S.SEED) -> DataFrame:
    """Fold column (X3), persisted: every candidate x fold fit re-reads it."""
    from pyspark import StorageLevel
    return split.range_folds(df, k=k, seed=seed, out=FOLD).persist(StorageLevel.MEMORY_AND_DISK)


def _scored_fold(key: str, df: DataFrame, f: int, overrides=None) -> DataFrame:
    train = df.where(F.col(FOLD) != f)
    held = df.where(F.col(FOLD) == f)
    model = L.fit(key, train, overrides=overrides)
    return L.score(model, held, keep=[S.KEY, "label", FOLD])


def out_of_fold(key: str, df: DataFrame, k: int = 5, overrides=None, parallelism: int = 2,
                folded: bool = False) -> DataFrame:
    """Out-of-fold scores (key, label, fold, score) for one learner."""
    d = df if folded else with_folds(df, k)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        parts = list(ex.map(lambda f: _scored_fold(key, d, f, overrides), range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_metrics(key: str, df: DataFrame, k: int = 5, scoring=("roc_auc", "accuracy", "f1"),
               parallelism: int = 2, overrides=None) -> DataFrame:
    """M9: metric per fold from ONE grouped query over the out-of-fold union,
    then mean and (population) std across folds."""
    folded = with_folds(df, k)
    try:
        oof = materialize(out_of_fold(key, folded, k, overrides, parallelism, folded=True))
    finally:
        folded.unpersist()
    per_fold = M.metric_table(oof, groups=[FOLD])
    long = per_fold.select(FOLD, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in scoring
    ])).alias("r")).select(FOLD, "r.metric", "r.value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"),
                                      F.stddev_pop("value").alias("std"),
                                      F.count(F.lit(1)).alias("folds"))


def cross_validate(key: str, df: DataFrame, k: int = 5, scoring=("roc_auc", "accuracy", "f1"),
                   parallelism: int = 2, overrides=None):
    """M9: the fold metrics, and the pipeline refitted on all rows."""
    return cv_metrics(key, df, k, scoring, parallelism, overrides), L.fit(key, df, overrides=overrides)


def _param_maps(key: str, pipeline, combos: list[dict], n_rows: int | None = None):
    """Original-name parameter combinations -> Spark ParamMaps.

    ``class_weight`` chooses the weight column, a parameter like any other;
    ``n_rows`` are the training rows of a fold, for the SVC's C."""
    kind, base = L.catalogue()[key]
    stages = pipeline.getStages()
    valid = {p.name: p for p in stages[-1].params}
    maps = []
    for combo in combos:
        sp, balanced, ignored = L.to_spark_params(kind, dict(base, **combo))
        if any(name in combo for name in ignored):
            L.log.warning("%s: searching %s has no effect", key, ", ".join(n for n in ignored if n in combo))
        if "C" in sp and n_rows:
            sp["regParam"] = 1.0 / (sp["C"] * n_rows)
        pm = {valid[k]: v for k, v in sp.items() if k in valid}
        if "weightCol" in valid:
            pm[valid["weightCol"]] = "weight" if balanced else "unit_weight"
        if kind == "rbf_svm" and "gamma" in combo:
            pm[stages[-2].gamma] = str(sp["gamma"])
        maps.append(pm)
    return maps


def grid_combos(grid: dict) -> list[dict]:
    names = list(grid)
    return [dict(zip(names, values)) for values in itertools.product(*[grid[n] for n in names])]


def _search(key: str, df: DataFrame, combos: list[dict], k: int, metric: str,
            parallelism: int):
    if L.grown_spec(key):
        return _grown_search(key, df, combos, k, metric), combos
    pipe, _ = L.build_pipeline(key)
    pipe = SharedPrefixPipeline(stages=pipe.getStages())
    kind, _ = L.catalogue()[key]
    n_rows = df.count() * (k - 1) // k if kind == "rbf_svm" else None
    maps = _param_maps(key, pipe, combos, n_rows)
    # points that differ only in what Spark ML has no parameter for are the same fit: done once
    at: dict = {}
    place = [at.setdefault(frozenset(m.items()), len(at)) for m in maps]
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=[dict(m) for m in at],
                        evaluator=ExactMetricEvaluator(metric), foldCol=FOLD, numFolds=k,
                        parallelism=parallelism, collectSubModels=False)
    folded = with_folds(df, k)
    try:
        model = cv.fit(folded)
    finally:
        folded.unpersist()
    model.avgMetrics = [model.avgMetrics[i] for i in place]
    model.stdMetrics = [model.stdMetrics[i] for i in place]
    model._set(estimatorParamMaps=maps)
    return model, combos


@dataclass
class SearchResult:
    """What a search over grown trees returns, by the names of a CrossValidatorModel."""

    bestModel: PipelineModel
    avgMetrics: list
    stdMetrics: list


def fold_views(folded: DataFrame, k: int) -> DataFrame:
    """Key, label, fold, and for each fold f the rows' vectors ``x{f}`` by the feature stage fitted on the other folds;
    cut off from the plan that made them."""
    out, names = folded.select(F.struct(*[F.col(f"`{c}`") for c in folded.columns]).alias("_orig")), []
    with ThreadPoolExecutor(max_workers=k) as ex:          # small jobs, one after another in each fit
        stages = list(ex.map(lambda f: ChurnFeatures().fit(folded.where(F.col(FOLD) != f)), range(k)))
    for f, stage in enumerate(stages):
        rows = stage.transform(out.select("_orig.*", "_orig", *names))
        out = rows.select("_orig", *names, vector_to_array("features").alias(f"x{f}"))
        names.append(f"x{f}")
    return cut_lineage(out.select(*[F.col("_orig")[c].alias(c) for c in (S.KEY, "label", FOLD)], *names))


def _by_bins(key: str, combos: list[dict]) -> dict[int, list[tuple[int, object]]]:
    """Candidates (place, TreeSpec) by their number of bins."""
    out: dict[int, list] = {}
    for i, combo in enumerate(combos):
        spec, bins = L.grown_spec(key, combo)
        out.setdefault(bins, []).append((i, spec))
    return out


def _grown_search(key: str, df: DataFrame, combos: list[dict], k: int, metric: str) -> SearchResult:
    """Every candidate on every fold, all of them grown together; then the best on all rows."""
    folded = with_folds(df, k)
    values: dict[int, dict[int, float]] = {}
    try:
        rows = fold_views(folded, k)
        for bins, mine in _by_bins(key, combos).items():
            place: dict = {}                      # equal candidates are grown once
            for _, spec in mine:
                place.setdefault(spec, len(place))
            grow = grower(rows, k, len(place) * k, bins, max(spec.rounds for spec in place))
            try:
                numbers = {(c, f): grow.add(replace(spec, view=f, held_out=f)) for spec, c in place.items() for f in range(k)}
                grow.run()
                scores = materialize(grow.held_out_scores(df.sparkSession, list(numbers.values())))
            finally:
                grow.release()
            found = {r["model"]: r[metric] for r in M.metric_table(scores, groups=["model"]).select("model", metric).collect()}   # a row for each candidate and fold
            scores.unpersist()
            for i, spec in mine:
                values[i] = {f: found.get(numbers[place[spec], f]) for f in range(k)}
    finally:
        folded.unpersist()
    if any(v is None or math.isnan(v) for fold in values.values() for v in fold.values()):
        raise ValueError(f"{metric} is undefined on a fold: it needs rows of both classes")
    mean = [statistics.fmean(values[i].values()) for i in range(len(combos))]
    std = [statistics.stdev(values[i].values()) if k > 1 else 0.0 for i in range(len(combos))]
    best = (min if metric == "brier" else max)(range(len(combos)), key=mean.__getitem__)
    return SearchResult(L.fit(key, df, overrides=combos[best]), mean, std)


def grid_search(key: str, df: DataFrame, grid: dict, k: int = 5, metric: str = "roc_auc",
                parallelism: int = 2):
    """Every grid point, k-fold CV on the whole pipeline, refit the best."""
    return _search(key, df, grid_combos(grid), k, metric, parallelism)


def random_search(key: str, df: DataFrame, grid: dict, n_iter: int = 10, k: int = 5,
                  metric: str = "roc_auc", seed: int = S.SEED, parallelism: int = 2):
    """``n_iter`` distinct grid points drawn without replacement (seeded)."""
    combos = grid_combos(grid)
    rng = random.Random(seed)
    picked = rng.sample(combos, min(n_iter, len(combos)))
    return _search(key, df, picked, k, metric, parallelism)


def results_table(spark, model, combos, metric: str = "roc_auc") -> DataFrame:
    """One row per candidate with mean/std metric and rank."""
    rows = []
    std = getattr(model, "stdMetrics", None) or [None] * len(combos)
    for i, (c, m, s) in enumerate(zip(combos, model.avgMetrics, std)):
        rows.append((i, {k: str(v) for k, v in c.items()}, float(m),
                     None if s is None else float(s)))
    df = spark.createDataFrame(rows, f"candidate int, params map<string,string>, "
                                     f"mean_{metric} double, std_{metric} double")
    from pyspark.sql import Window
    # one row per candidate: a bounded ordering window
    return df.withColumn("rank", F.rank().over(Window.orderBy(F.col(f"mean_{metric}").desc(),
                                                              "candidate")))


# ---------------------------------------------------------------------------
# Search ranges of the model-based tuner.
# ---------------------------------------------------------------------------
SEARCH_SPACES = {
    "xgb": {"n_estimators": ("int", 150, 400), "max_depth": ("int", 3, 8),
            "learning_rate": ("log", 0.01, 0.2), "subsample": ("float", 0.6, 1.0),
            "colsample_bytree": ("float", 0.5, 1.0)},
    "lgbm": {"n_estimators": ("int", 200, 600), "num_leaves": ("int", 15, 63),
             "learning_rate": ("log", 0.01, 0.2), "subsample": ("float", 0.6, 1.0),
             "colsample_bytree": ("float", 0.6, 1.0)},
}


def sample_space(space: dict, rng: random.Random) -> dict:
    return {name: _at(kind, lo, hi, rng.random()) for name, (kind, lo, hi) in space.items()}


def _at(kind: str, lo: float, hi: float, u: float):
    """The value at ``u`` in [0, 1) of a range."""
    if kind == "int":
        return min(int(hi), int(lo) + int(u * (int(hi) - int(lo) + 1)))
    return math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo))) if kind == "log" else lo + u * (hi - lo)


def _place(kind: str, lo: float, hi: float, value: float) -> float:
    """The inverse of :func:`_at` (the middle of an integer's share)."""
    if kind == "int":
        return (value - lo + 0.5) / (hi - lo + 1)
    return (math.log(value) - math.log(lo)) / (math.log(hi) - math.log(lo)) if kind == "log" else (value - lo) / (hi - lo)


class ParzenSampler:
    """Model-based sampling: a density over the good trials and one over the others; the
    next point takes of each parameter, of ``draws`` values drawn from the first, the one
    where it exceeds the second most.

    The first ``startup`` points are drawn evenly.  A density is, parameter by parameter,
    the mean of a uniform one and of a normal around each trial, cut off at the range's ends.
    """

    def __init__(self, space: dict, seed: int, startup: int = 10, good_share: float = 0.25, draws: int = 24):
        self.space, self.rng, self.startup, self.good_share, self.draws = space, random.Random(seed), startup, good_share, draws
        self.trials: list[tuple[dict, float]] = []

    def tell(self, params: dict, value: float) -> None:
        self.trials.append((params, value))

    def ask(self, model_based: bool = True) -> dict:
        if not model_based or len(self.trials) < 2:
            return sample_space(self.space, self.rng)
        ranked = sorted(self.trials, key=lambda t: -t[1])
        n = max(1, math.ceil(self.good_share * len(ranked)))
        good, rest = ranked[:n], ranked[n:]
        point = {}
        for name, (kind, lo, hi) in self.space.items():
            near = [_place(kind, lo, hi, p[name]) for p, _ in good]
            far = [_place(kind, lo, hi, p[name]) for p, _ in rest]
            drawn = [self._draw(near) for _ in range(self.draws)]
            point[name] = _at(kind, lo, hi, max(drawn, key=lambda u: self._density(near, u) / self._density(far, u)))
        return point

    @staticmethod
    def _widths(points: list[float]) -> list[float]:
        """Of each point's normal: the wider gap to its neighbours (or an end of the range), a share of the range at least."""
        order = sorted(range(len(points)), key=points.__getitem__)
        at = [0.0, *(points[i] for i in order), 1.0]
        out = [0.0] * len(points)
        for k, i in enumerate(order, 1):
            out[i] = max(at[k] - at[k - 1], at[k + 1] - at[k], 1 / min(100, 1 + len(points)))
        return out

    def _draw(self, points: list[float]) -> float:
        i = self.rng.randrange(len(points) + 1)
        if i == len(points):
            return self.rng.random()
        width = self._widths(points)[i]
        while True:
            u = self.rng.gauss(points[i], width)
            if 0 <= u < 1:
                return u

    def _density(self, points: list[float], u: float) -> float:
        total = 1.0
        for p, w in zip(points, self._widths(points)):
            normal = statistics.NormalDist(p, w)
            total += normal.pdf(u) / (normal.cdf(1) - normal.cdf(0))
        return total / (len(points) + 1)


def model_search(key: str, df: DataFrame, n_trials: int = 6, cv_splits: int = 5,
                 seed: int = S.SEED, space: dict | None = None, at_once: int = 10):
    """Model-based search over ranges; objective = average precision of the pooled
    out-of-fold scores with max(3, cv // 2) folds.  Returns (best params, trials).

    Up to ``at_once`` trials grow side by side.  The first are drawn evenly; one that
    starts later is drawn by what the finished ones found, once there are half as many."""
    space = space or SEARCH_SPACES.get(key)
    if space is None:
        return {}, []
    k = max(3, cv_splits // 2)
    folded = with_folds(df, k)
    sampler = ParzenSampler(space, seed)
    trials: list[tuple[dict, float]] = []
    spec, bins = L.grown_spec(key)
    rounds = space["n_estimators"][2] if "n_estimators" in space else spec.rounds
    grow = None
    try:
        grow = grower(fold_views(folded, k), k, min(at_once, n_trials) * k, bins, rounds)
        running: dict[int, tuple[dict, set]] = {}
        started = 0
        while len(trials) < n_trials:
            while started < n_trials and len(running) < at_once and (started < at_once or 2 * len(trials) >= at_once):
                params = sampler.ask(started >= at_once)
                spec, _ = L.grown_spec(key, params)
                running[started] = (params, {grow.add(replace(spec, view=f, held_out=f)) for f in range(k)})
                started += 1
            ended = grow.step()
            done = [t for t, (_, numbers) in running.items() if ended and all(grow.models[i].done for i in numbers)]
            if done:
                trial_of = {i: t for t in done for i in running[t][1]}
                for t, ap in _pooled_precision(grow, df.sparkSession, trial_of).items():
                    params, numbers = running.pop(t)
                    grow.forget(numbers)
                    sampler.tell(params, ap)
                    trials.append((params, ap))
    finally:
        folded.unpersist()
        if grow is not None:
            grow.release()
    best = max(trials, key=lambda t: t[1])
    return best[0], trials


def _pooled_precision(grow, spark, trial_of: dict[int, int]) -> dict[int, float]:
    """Average precision of each trial over the rows of all its folds."""
    place = F.create_map(*[F.lit(x) for pair in trial_of.items() for x in pair])
    scores = materialize(grow.held_out_scores(spark, list(trial_of)).select(place[F.col("model")].alias("trial"), "label", "score"))
    try:
        found = {r["trial"]: r["pr_auc"] for r in M.curve_summary(scores, groups=["trial"]).select("trial", "pr_auc").collect()}
    finally:
        scores.unpersist()
    if any(v is None or math.isnan(v) for v in found.values()):
        raise ValueError("average precision is undefined: no positive rows")
    return dict(sorted(found.items()))

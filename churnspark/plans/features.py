"""Spark ML stages for the feature matrix.

* :func:`fit_yeo_johnson` (G7) - maximum-likelihood lambda per column, by Newton steps
  on ``-n/2 * ln var(T(x, l)) + (l - 1) * sum(sign(x) * log1p(|x|))``; a scan takes the
  moments of T and its two derivatives at a few lambdas for all columns in ONE aggregate.
* :class:`ChurnFeatures` / :class:`ChurnFeaturesModel` (G13) - the composite
  builder: cleaning, derived features, optional power transform, categorical
  and numeric imputation, drop-first one-hot and vector assembly (G12).  All
  fit-time statistics are learnt once and stored as JSON in a Param, so the
  model persists with the default ML writers and scores any batch the same way.
"""

from __future__ import annotations

import json
import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param.shared import HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.functions import clean, features
from churnspark.operators import encode, impute


def fit_yeo_johnson(df: DataFrame, cols, scans: int = 4, lo: float = -2.0, hi: float = 4.0) -> dict:
    """Lambda maximising the Yeo-Johnson log-likelihood of each column.

    The first scan looks at every half from ``lo`` to ``hi``; the others at the Newton
    point and one to each side of it.  An optimum outside the range takes a scan more
    for each half step.  A column without two different values has lambda 1.
    """
    cols = list(cols)
    if not cols:
        return {}
    from pyspark import StorageLevel
    base = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).na.drop() \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit_yj(base, cols, scans, lo, hi)
    finally:
        base.unpersist()


def _likelihoods(base: DataFrame, cols, points: dict) -> dict:
    """For every (column, lambda): the log-likelihood and its first and second derivative.

    Each row is exploded into one cell per (column, lambda) and reduced with a grouped
    aggregate: at most |cols| x |points| rows leave a task, and the expression code does
    not depend on the lambdas, so every scan reuses the same compiled stage.
    """
    cells = F.array(*[F.struct(F.lit(ci).alias("c"), F.lit(float(lam)).alias("lam")) for ci, c in enumerate(cols) for lam in points[c]])
    long = base.select(F.array(*[F.col(c) for c in cols]).alias("v"), F.explode(cells).alias("g"))
    x = F.element_at("v", F.col("g.c") + 1)
    t, t1, t2 = features.yeo_johnson_slopes(x, F.col("g.lam"))
    moved = long.select("g.c", "g.lam", t.alias("t"), t1.alias("t1"), t2.alias("t2"), (F.signum(x) * F.log1p(F.abs(x))).alias("s"))
    out = {}
    for r in moved.groupBy("c", "lam").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"), F.var_pop("t").alias("v"), F.covar_pop("t", "t1").alias("tt1"),
                                           F.var_pop("t1").alias("v1"), F.covar_pop("t", "t2").alias("tt2")).collect():
        if not r["v"] or not math.isfinite(r["v"]) or r["v"] <= 0:
            continue
        d1, d2 = 2 * r["tt1"] / r["v"], 2 * (r["v1"] + r["tt2"]) / r["v"]
        out.setdefault(cols[r["c"]], []).append((-r["n"] / 2 * math.log(r["v"]) + (r["lam"] - 1) * r["s"], r["lam"], -r["n"] / 2 * d1 + r["s"], -r["n"] / 2 * (d2 - d1 * d1)))
    return out


def _fit_yj(base, cols, scans, lo, hi) -> dict:
    half = 0.5
    points = {c: [lo + half * i for i in range(round((hi - lo) / half) + 1)] for c in cols}
    best = dict.fromkeys(cols, 1.0)
    left, far = scans, 0
    while points and left > 0:
        found, points, outside = _likelihoods(base, list(points), points), {}, False
        for c, rows in found.items():
            _, lam, slope, bend = max(rows, key=lambda r: (r[0], -abs(r[1] - 1.0)))
            step = -slope / bend if bend < 0 else math.copysign(half, slope)
            step = max(-half, min(half, step))
            outside |= abs(step) == half
            best[c] = lam + step
            near = max(abs(step) / 8, 1e-4)
            points[c] = [best[c], best[c] - near, best[c] + near]
        far += outside
        left -= not outside or far > 40
    return best


class _FeatureParams(Params):
    mode = Param(Params._dummy(), "mode", "lenient (config-driven) or strict (app) cleaning",
                 typeConverter=TypeConverters.toString)
    powerTransform = Param(Params._dummy(), "powerTransform", "apply Yeo-Johnson",
                           typeConverter=TypeConverters.toBoolean)
    powerFeatures = Param(Params._dummy(), "powerFeatures", "columns to power-transform",
                          typeConverter=TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "one-hot columns",
                            typeConverter=TypeConverters.toListString)
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns",
                        typeConverter=TypeConverters.toListString)
    booleanCols = Param(Params._dummy(), "booleanCols", "0/1 columns",
                        typeConverter=TypeConverters.toListString)
    imputeCategorical = Param(Params._dummy(), "imputeCategorical",
                              "most_frequent or none", typeConverter=TypeConverters.toString)
    imputeNumeric = Param(Params._dummy(), "imputeNumeric", "none, mean, median or most_frequent",
                          typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(mode="lenient", powerTransform=False, powerFeatures=S.POWER_FEATURES,
                         categoricalCols=S.CATEGORICAL, numericCols=S.NUMERIC + S.EXTRA_NUMERIC,
                         booleanCols=S.APP_BOOL, imputeCategorical="most_frequent",
                         imputeNumeric="none", outputCol="features")

    def _prepare(self, df: DataFrame, stats: dict) -> DataFrame:
        """Cleaning + derived features (+ power transform) with fitted stats."""
        if self.getOrDefault("mode") == "strict":
            out = features.engineer_app(clean.clean_strict(df, stats))
        else:
            out = features.engineer_lenient(clean.clean_lenient(df, stats))
            if "tenure" in out.columns:
                out = out.withColumn("LessThan6Months", features.less_than_6_months())
        lambdas = stats.get("yj", {})
        if lambdas:
            out = out.withColumns({c: features.yeo_johnson(F.col(c), lam)
                                   for c, lam in lambdas.items() if c in out.columns})
        return out


class ChurnFeatures(Estimator, _FeatureParams, HasOutputCol, DefaultParamsReadable,
                    DefaultParamsWritable):
    """Fit all feature statistics on the training rows, once."""

    @keyword_only
    def __init__(self, *, mode="lenient", powerTransform=False, powerFeatures=None,
                 categoricalCols=None, numericCols=None, booleanCols=None,
                 imputeCategorical="most_frequent", imputeNumeric="none", outputCol="features"):
        super().__init__()
        kwargs = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**kwargs)

    def _fit(self, df: DataFrame) -> "ChurnFeaturesModel":
        stats: dict = {}
        if self.getOrDefault("mode") == "strict":
            norm = clean.normalize_service_text(df, S.REPLACE_COLS)
            stats.update(clean.fit_lenient(df))
            stats["strict_flags"] = clean.strict_flag_columns(norm, S.BOOLEAN_COLS)
        else:
            stats.update(clean.fit_lenient(df))
        prepared = self._prepare(df, stats)
        if self.getOrDefault("powerTransform"):
            cols = [c for c in self.getOrDefault("powerFeatures") if c in prepared.columns]
            stats["yj"] = fit_yeo_johnson(prepared, cols)
            prepared = self._prepare(df, stats)
        cats = [c for c in self.getOrDefault("categoricalCols") if c in prepared.columns]
        nums = [c for c in self.getOrDefault("numericCols") if c in prepared.columns]
        if self.getOrDefault("imputeCategorical") == "most_frequent" and cats:
            stats["cat_fill"] = impute.fit_impute(prepared, cats, "most_frequent")
        num_strategy = self.getOrDefault("imputeNumeric")
        if num_strategy and num_strategy != "none" and nums:
            stats["num_fill"] = impute.fit_impute(prepared, nums, num_strategy)
        stats["levels"] = encode.category_levels(prepared, cats)
        model = ChurnFeaturesModel(statsJson=json.dumps(stats))
        return self._copyValues(model)


class ChurnFeaturesModel(Model, _FeatureParams, HasOutputCol, DefaultParamsReadable,
                         DefaultParamsWritable):
    statsJson = Param(Params._dummy(), "statsJson", "fitted statistics as JSON",
                      typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, statsJson="{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def stats(self) -> dict:
        return json.loads(self.getOrDefault("statsJson"))

    def feature_names(self) -> list[str]:
        st = self.stats
        cats = [c for c in self.getOrDefault("categoricalCols") if c in st.get("levels", {})]
        return encode.feature_names(cats, st["levels"], self.getOrDefault("numericCols"),
                                    self.getOrDefault("booleanCols"))

    def expand(self, df: DataFrame) -> DataFrame:
        """Prepared columns plus one-hot columns (no vector yet)."""
        st = self.stats
        out = self._prepare(df, st)
        if st.get("cat_fill"):
            out = impute.apply_impute(out, {k: v for k, v in st["cat_fill"].items()
                                            if k in out.columns})
        if st.get("num_fill"):
            out = impute.apply_impute(out, {k: v for k, v in st["num_fill"].items()
                                            if k in out.columns})
        cats = [c for c in self.getOrDefault("categoricalCols") if c in st.get("levels", {})]
        return encode.one_hot_drop_first(out, cats, st["levels"], keep_input=True)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.expand(df)
        names = [n for n in self.feature_names() if n in out.columns]
        cast = out.withColumns({n: F.col(n).cast("double") for n in names})
        assembler = VectorAssembler(inputCols=names, outputCol=self.getOutputCol(),
                                    handleInvalid="error")
        return assembler.transform(cast)

"""Evaluation operators (E1-E16) - all aggregates over (label, score).

Conventions: ``label`` is an int 0/1 column, ``score`` a double P(churn),
``groups`` optional grouping columns (model, split, ...).  Per-row work is
always a map-side partial aggregate; curves group by distinct score first and
use :func:`churnspark.operators.rank.running_sums`, so no ordered window ever
runs over all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.operators.rank import ranged_sums, running_sums

_G = "_g"


def _groups(df: DataFrame, groups):
    """Grouping columns, adding a constant one when none are given so joins keep keys."""
    groups = list(groups or [])
    if groups:
        return df, groups
    return df.withColumn(_G, F.lit(0)), [_G]


def _drop_g(df: DataFrame) -> DataFrame:
    return df.drop(_G) if _G in df.columns else df


def _div0(num: Column, den: Column) -> Column:
    """num / den, and 0 when den == 0 (zero_division = 0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


# ----------------------------------------------------------------- E1, E2, E5

def confusion_aggs(label: str, pred: Column) -> list[Column]:
    y = F.col(label)
    return [
        F.count_if((y == 0) & (pred == 0)).alias("tn"),
        F.count_if((y == 0) & (pred == 1)).alias("fp"),
        F.count_if((y == 1) & (pred == 0)).alias("fn"),
        F.count_if((y == 1) & (pred == 1)).alias("tp"),
    ]


def predicted(score: str, threshold: float | Column = S.DEFAULT_THRESHOLD) -> Column:
    """V3: label = score >= threshold (inclusive)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (F.col(score) >= t).cast("int")


def confusion(df: DataFrame, label: str = "label", score: str = "score",
              threshold: float = S.DEFAULT_THRESHOLD, groups=()) -> DataFrame:
    """The four cells (always present) per group."""
    return df.groupBy(*groups).agg(*confusion_aggs(label, predicted(score, threshold)))


def rate_columns() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return {
        "accuracy": _div0(tp + tn, n),
        "precision": _div0(tp, tp + fp),
        "recall": _div0(tp, tp + fn),
        "f1": _div0(2 * tp, 2 * tp + fp + fn),
    }


def basic_metrics(df: DataFrame, label: str = "label", score: str = "score",
                  threshold: float = S.DEFAULT_THRESHOLD, groups=()) -> DataFrame:
    """Accuracy, precision, recall, F1 (zero division -> 0) with the cells."""
    return confusion(df, label, score, threshold, groups).withColumns(rate_columns())


def brier(df: DataFrame, label: str = "label", score: str = "score", groups=()) -> DataFrame:
    """E5: mean squared difference between score and label."""
    d = F.col(score) - F.col(label)
    return df.groupBy(*groups).agg(F.avg(d * d).alias("brier"))


# ---------------------------------------------------------- curves: E3, E4, E6, E7

def score_levels(df: DataFrame, label: str = "label", score: str = "score", groups=()):
    """One row per (group, distinct score): positives ``tp_s`` and negatives ``fp_s``,
    with inclusive running counts from the highest score down (``tp_cum``,
    ``fp_cum``) and the group totals ``P``/``N``.  Returns (frame, group cols).
    ``df`` is read once, when this is called."""
    d, gc = _groups(df, groups)
    cum = ranged_sums(_levels(d, label, score, gc), "threshold", ["tp_s", "fp_s"], gc)
    return cum.withColumnsRenamed({"tp_s_cum": "tp_cum", "fp_s_cum": "fp_cum", "tp_s_all": "P", "fp_s_all": "N"}), gc


def _levels(df: DataFrame, label: str, score: str, gc) -> DataFrame:
    y = F.col(label).cast("long")
    return df.groupBy(*gc, F.col(score).alias("threshold")).agg(
        F.sum(y).alias("tp_s"), F.sum(1 - y).alias("fp_s"))


def _levels_cum(df: DataFrame, label: str, score: str, gc):
    """Distinct-score levels with running counts (no totals attached)."""
    cum = running_sums(_levels(df, label, score, gc), "threshold", ["tp_s", "fp_s"], gc, descending=True)
    return cum.withColumnRenamed("tp_s_cum", "tp_cum").withColumnRenamed("fp_s_cum", "fp_cum")


def curve_summary(df: DataFrame, label: str = "label", score: str = "score", groups=()):
    """E3 + E4 per group (see :func:`_curve_summary`)."""
    return _drop_g(_curve_summary(df, label, score, groups))


def _curve_summary(df: DataFrame, label: str = "label", score: str = "score", groups=()):
    """E3 + E4: ROC AUC (ties averaged, trapezoid) and average precision per group.

    AUC = sum_s fp_s * (tp_above_s + tp_s / 2) / (P * N); NULL unless both classes occur.
    AP  = sum_s (tp_s / P) * precision_s; NULL without positives.
    """
    d, gc = _groups(df, groups)
    lv = _levels_cum(d, label, score, gc)
    # totals come from the same aggregate: no join
    out = lv.groupBy(*gc).agg(
        F.sum("tp_s").alias("P"), F.sum("fp_s").alias("N"),
        F.sum(F.col("fp_s") * (F.col("tp_cum") - F.col("tp_s") / 2.0)).alias("_auc"),
        F.sum(F.col("tp_s") * (F.col("tp_cum") / (F.col("tp_cum") + F.col("fp_cum")))).alias("_ap"),
    )
    out = out.select(
        *gc,
        F.when((F.col("P") > 0) & (F.col("N") > 0),
               F.col("_auc") / (F.col("P") * F.col("N"))).alias("roc_auc"),
        F.when(F.col("P") > 0, F.col("_ap") / F.col("P")).alias("pr_auc"),
    )
    return out


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", groups=()) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, plus the origin with NULL threshold."""
    lv, gc = score_levels(df, label, score, groups)
    pts = lv.select(*gc, F.col("threshold"),
                    _div0(F.col("fp_cum"), F.col("N")).alias("fpr"),
                    _div0(F.col("tp_cum"), F.col("P")).alias("tpr"))
    origin = lv.select(*gc).distinct().select(
        *gc, F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return _drop_g(pts.unionByName(origin))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score", groups=()) -> DataFrame:
    """(threshold, precision, recall) per distinct score, plus (NULL, 1, 0).

    Recall is 1 everywhere when there are no positives.
    """
    lv, gc = score_levels(df, label, score, groups)
    pts = lv.select(
        *gc, F.col("threshold"),
        (F.col("tp_cum") / (F.col("tp_cum") + F.col("fp_cum"))).alias("precision"),
        F.when(F.col("P") == 0, F.lit(1.0))
        .otherwise(F.col("tp_cum") / F.col("P")).alias("recall"))
    end = lv.select(*gc).distinct().select(
        *gc, F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return _drop_g(pts.unionByName(end))


def best_pr_threshold(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Threshold maximising 2PR/(P+R+1e-8) on the PR curve; lowest on ties;
    0.5 when the curve is empty."""
    curve = pr_curve(df, label, score).where(F.col("threshold").isNotNull())
    f1 = (2 * F.col("precision") * F.col("recall")) / \
        (F.col("precision") + F.col("recall") + F.lit(S.PR_F1_EPS))
    best = curve.select("threshold", f1.alias("f1")) \
        .orderBy(F.col("f1").desc(), F.col("threshold").asc()).limit(1)
    fallback = df.sparkSession.range(1).select(
        F.lit(S.DEFAULT_THRESHOLD).alias("threshold"), F.lit(0.0).alias("f1"))
    return _first_or(best, fallback)


def _first_or(best: DataFrame, fallback: DataFrame) -> DataFrame:
    """``best`` if it has a row, else ``fallback`` (both one-row frames)."""
    tagged = best.withColumn("_o", F.lit(0)).unionByName(fallback.withColumn("_o", F.lit(1)))
    return tagged.orderBy("_o").limit(1).drop("_o")


# ------------------------------------------------------------ sweeps: E8, E10

def sweep_threshold(i: Column, points: int = S.SWEEP_POINTS) -> Column:
    """Threshold i of linspace(0, 1, points): i * (1/(points-1)), the last exactly 1."""
    step = 1.0 / (points - 1)
    return F.when(i == points - 1, F.lit(1.0)).otherwise(i.cast("double") * F.lit(step))


def sweep_bucket(score: Column, points: int = S.SWEEP_POINTS) -> Column:
    """Largest i with threshold_i <= score (-1 below 0, points-1 at/above 1)."""
    top = points - 1
    s = score.cast("double")
    raw = F.floor(s * F.lit(float(top))).cast("int")
    i = F.greatest(F.least(raw, F.lit(top)), F.lit(-1))
    # correct the float estimate against the exact thresholds
    i = F.when((i >= 0) & (s < sweep_threshold(i, points)), i - 1).otherwise(i)
    i = F.when((i < top) & (s >= sweep_threshold(i + 1, points)), i + 1).otherwise(i)
    return i


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score",
                    points: int = S.SWEEP_POINTS) -> DataFrame:
    """E10 (+ F1 of E8): tp/fp/tn/fn and F1 at every threshold of linspace(0, 1, points).

    One pass builds a (bucket, label) histogram; counts at threshold i are the
    sums over buckets >= i - a running sum over ``points`` rows, not points x N.
    """
    y = F.col(label).cast("long")
    hist = df.groupBy(sweep_bucket(F.col(score), points).alias("b")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    # bucket -1 holds scores below 0: they only ever count as predicted negatives
    grid = df.sparkSession.range(-1, points).select(F.col("id").cast("int").alias("i"))
    # hist has at most points + 1 rows: the broadcast and the whole-table windows are bounded
    per_i = grid.join(F.broadcast(hist), F.col("b") == F.col("i"), "left") \
        .select("i", F.coalesce("pos", F.lit(0)).alias("pos"),
                F.coalesce("neg", F.lit(0)).alias("neg"))
    w = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    out = per_i.select("i", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                       F.sum("pos").over(whole).alias("P"), F.sum("neg").over(whole).alias("N")) \
        .where(F.col("i") >= 0)
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("P") - tp
    tn = F.col("N") - fp
    return out.select(
        "i", sweep_threshold(F.col("i"), points).alias("threshold"),
        tp.cast("long").alias("tp"), fp.cast("long").alias("fp"),
        tn.cast("long").alias("tn"), fn.cast("long").alias("fn"),
        _div0(2 * tp, 2 * tp + fp + fn).alias("f1"))


def best_f1(df: DataFrame, label: str = "label", score: str = "score",
            points: int = S.SWEEP_POINTS) -> DataFrame:
    """First threshold with the maximal F1."""
    return threshold_sweep(df, label, score, points) \
        .orderBy(F.col("f1").desc(), F.col("i").asc()).limit(1) \
        .select(F.col("threshold").alias("best_f1_threshold"), F.col("f1").alias("best_f1_score"))


# ---------------------------------------------------------------------- E11

def class_report(df: DataFrame, label: str = "label", score: str = "score",
                 threshold: float = S.DEFAULT_THRESHOLD) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages."""
    cm = confusion(df, label, score, threshold)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def cls(name, t_p, f_p, f_n, support):
        return F.struct(
            F.lit(name).alias("class"),
            _div0(t_p, t_p + f_p).alias("precision"),
            _div0(t_p, t_p + f_n).alias("recall"),
            _div0(2 * t_p, 2 * t_p + f_p + f_n).alias("f1"),
            support.cast("long").alias("support"))

    rows = cm.select(F.explode(F.array(
        cls("0", tn, fn, fp, tn + fp),
        cls("1", tp, fp, fn, tp + fn),
    )).alias("r"), n.alias("n")).select("r.*", "n")
    avg = rows.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.first("n")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.first("n")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.first("n")).alias("wf"),
        F.first("n").alias("n"))
    acc = cm.select(
        F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        _div0(tp + tn, n).alias("f1"), n.cast("long").alias("support"))
    macro = avg.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"),
                       F.col("n").cast("long").alias("support"))
    weighted = avg.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"),
                          F.col("n").cast("long").alias("support"))
    return rows.drop("n").unionByName(acc).unionByName(macro).unionByName(weighted)


# -------------------------------------------------------------- E12, E13

def histogram(df: DataFrame, value: str, group: str, bins: int,
              density: bool) -> DataFrame:
    """numpy-style equal-width histogram of ``value`` per ``group``.

    Range = the group's [min, max] (widened by 0.5 when constant); the last bin
    is closed.  Per-group ranges come from one aggregate (bounded by the number
    of groups); rows are binned with the same float steps numpy uses; every
    bin of every group is returned, empty ones with count 0.
    """
    stats = df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.min(value).alias("lo0"), F.max(value).alias("hi0"), F.count(F.lit(1)).alias("total"))
    stats = stats.select(
        group, "total",
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"))
    stats = stats.withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(float(bins)))

    def edge(j: Column) -> Column:
        return F.when(j >= bins, F.col("hi")).otherwise(j.cast("double") * F.col("step") + F.col("lo"))

    x = F.col(value).cast("double")
    j = ((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins))).cast("long")
    j = F.when(j == bins, j - 1).otherwise(j)
    j = F.when(x < edge(j), j - 1).otherwise(j)
    j = F.when((x >= edge(j + 1)) & (j != bins - 1), j + 1).otherwise(j)
    # stats has one row per group (bounded), so the broadcast is size-safe
    binned = df.where(F.col(value).isNotNull()).join(F.broadcast(stats), on=group) \
        .select(group, j.cast("int").alias("bin"))
    counts = binned.groupBy(group, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = stats.select(group, "lo", "hi", "step", "total",
                        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, on=[group, "bin"], how="left").select(
        group, "bin",
        edge(F.col("bin")).alias("bin_left"),
        edge(F.col("bin") + 1).alias("bin_right"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
        "total")
    if density:
        width = F.col("bin_right") - F.col("bin_left")
        out = out.withColumn("density", F.col("count") / width / F.col("total"))
    return out.drop("total")


def histogram_by_class(df: DataFrame, label: str = "label", score: str = "score",
                       bins: int = S.CLASS_HIST_BINS) -> DataFrame:
    """Density histogram of scores per actual class."""
    return histogram(df.select(F.col(label).alias("label"), F.col(score).alias("score")),
                     "score", "label", bins, density=True)


def outcome(label: str, score: str, threshold: float | Column) -> Column:
    pred = predicted(score, threshold)
    y = F.col(label)
    return (F.when((y == 1) & (pred == 1), "TP").when((y == 0) & (pred == 0), "TN")
            .when((y == 0) & (pred == 1), "FP").otherwise("FN"))


def histogram_by_outcome(df: DataFrame, label: str = "label", score: str = "score",
                         threshold: float | None = None,
                         bins: int = S.OUTCOME_HIST_BINS) -> DataFrame:
    """Count histogram per outcome (TP/TN/FP/FN) at the best-F1 threshold."""
    if threshold is None:
        threshold = best_f1(df, label, score).first()["best_f1_threshold"]
    d = df.select(outcome(label, score, threshold).alias("outcome"), F.col(score).alias("score"))
    return histogram(d, "score", "outcome", bins, density=False)


# ------------------------------------------------------------ E14, E15, E16

METRIC_COLUMNS = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier"]


def metric_table(df: DataFrame, label: str = "label", score: str = "score", groups=(),
                 threshold: float = S.DEFAULT_THRESHOLD) -> DataFrame:
    """All summary metrics per group: one row-level aggregate plus one curve aggregate."""
    d, gc = _groups(df, groups)
    y = F.col(label)
    diff = F.col(score) - y
    point = d.groupBy(*gc).agg(
        *confusion_aggs(label, predicted(score, threshold)),
        F.avg(diff * diff).alias("brier"),
    ).withColumns(rate_columns())
    curves = _curve_summary(d, label, score, gc)
    if gc == [_G]:
        # ungrouped: both sides are single rows; carry the curve values as literals
        c = curves.first()
        out = point.withColumns({"roc_auc": F.lit(c["roc_auc"] if c else None).cast("double"),
                                 "pr_auc": F.lit(c["pr_auc"] if c else None).cast("double")})
    else:
        # both sides have one row per group: a small equi-join on the group keys
        out = point.join(curves, on=gc, how="left")
    return _drop_g(out.select(*gc, "tn", "fp", "fn", "tp", *METRIC_COLUMNS))


def compare_models(scored: DataFrame, label: str = "label", score: str = "score",
                   model: str = "model", sort_by: str = "pr_auc") -> DataFrame:
    """Metric table per model, best ``sort_by`` first."""
    return metric_table(scored, label, score, [model]) \
        .orderBy(F.col(sort_by).desc_nulls_last(), F.col(model))


def pick_best(table: DataFrame, metric: str = "pr_auc", name: str = "model",
              position: str | None = None) -> DataFrame:
    """First row with the maximal ``metric``; rows without it are ignored."""
    order = [F.col(metric).desc()]
    order.append(F.col(position).asc() if position else F.col(name).asc())
    best = table.where(F.col(metric).isNotNull() & ~F.isnan(metric)).orderBy(*order).limit(1)
    return best.select(name, metric)

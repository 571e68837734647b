"""Model explanations that need a fitted model.

* H1 :func:`tree_shap` - exact path-dependent TreeSHAP (Lundberg et al.,
  2018) for Spark decision trees, random forests and boosted trees.  The tree
  table (bounded by trees x 2^depth nodes) is read from the saved model and
  shipped to the tasks; ``mapInPandas`` explains a batch of rows at once, leaf
  path by leaf path.
  Output space: P(churn) for trees/forests, the margin for boosted trees.
* H2 :func:`sampling_shapley` - Monte-Carlo Shapley values (Strumbelj &
  Kononenko, 2014): rows x draws are expanded as a DataFrame, tasks build the mixed
  vectors of a batch of draws, and trees are evaluated there; other classifiers
  score the vectors in one pass.
* H3 :func:`permutation_importance` - rows are dealt out once by a hash; a task
  permutes each feature, repeat by repeat, inside blocks of its rows, the vectors are
  scored where they come to be, and the metric drop is averaged.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassificationModel, GBTClassificationModel,
                                       RandomForestClassificationModel)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.operators import metrics as M
from churnspark.plans.histtrees import HistTreesModel
from churnspark.session import default_buckets, ensure_checkpoint_dir

# ---------------------------------------------------------------- tree table


def tree_table(clf) -> tuple[list[dict], list[float], str]:
    """Trees as numpy node arrays, tree weights and the output space."""
    if isinstance(clf, HistTreesModel):
        forest = clf.forest
        trees = [dict(left=np.array(t["left"]), right=np.array(t["right"]), feat=np.array(t["feature"]), thr=np.array(t["threshold"]), cats=[None] * len(t["left"]),
                      value=np.array(t["value"]), cover=np.array(t["cover"])) for t in forest["trees"]]
        if forest["space"] == "margin":           # the prior is a tree of one leaf
            trees.append(dict(left=np.array([-1]), right=np.array([-1]), feat=np.array([-1]), thr=np.zeros(1), cats=[None], value=np.array([forest["base"]]), cover=np.ones(1)))
            return trees, [1.0] * len(trees), "margin"
        return trees, [1.0 / len(trees)] * len(trees), "probability"
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"trees-{uuid.uuid4().hex}")
    clf.write().overwrite().save(path)
    data = spark.read.parquet(os.path.join(path, "data"))
    if "treeID" in data.columns:
        rows = data.select("treeID", "nodeData.*").collect()
    else:
        rows = data.select(F.lit(0).alias("treeID"), "*").collect()
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], []).append(r)
    is_gbt = isinstance(clf, GBTClassificationModel)
    trees = []
    for tid in sorted(by_tree):
        nodes = sorted(by_tree[tid], key=lambda r: r["id"])
        n = len(nodes)
        left = np.full(n, -1)
        right = np.full(n, -1)
        feat = np.full(n, -1)
        thr = np.zeros(n)
        cats: list = [None] * n
        value = np.zeros(n)
        cover = np.zeros(n)
        for r in nodes:
            i = r["id"]
            left[i], right[i] = r["leftChild"], r["rightChild"]
            stats = list(r["impurityStats"])
            if is_gbt:
                value[i] = r["prediction"]
                cover[i] = stats[0] if stats else r["rawCount"]
            else:
                tot = sum(stats)
                value[i] = (stats[1] / tot) if tot > 0 and len(stats) > 1 else 0.0
                cover[i] = tot
            if left[i] >= 0:
                sp = r["split"]
                feat[i] = sp["featureIndex"]
                if sp["numCategories"] >= 0:
                    cats[i] = set(sp["leftCategoriesOrThreshold"])
                else:
                    thr[i] = sp["leftCategoriesOrThreshold"][0]
        trees.append(dict(left=left, right=right, feat=feat, thr=thr, cats=cats, value=value,
                          cover=cover))
    if isinstance(clf, RandomForestClassificationModel):
        weights = [1.0 / len(trees)] * len(trees)
        space = "probability"
    elif is_gbt:
        weights = list(clf.treeWeights)
        space = "margin"
    elif isinstance(clf, DecisionTreeClassificationModel):
        weights = [1.0]
        space = "probability"
    else:
        raise TypeError(f"TreeSHAP needs a tree model, got {type(clf).__name__}")
    return trees, weights, space


# ---------------------------------------------------------------- TreeSHAP core

def path_shares(z: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf with value 1, for rows of 0/1 ``o``: the game pays the
    product of o over the features present and of z over those absent.

    A value is (o_i - z_i) times the integral over t from 0 to 1 of the product of the other
    features' z + (o - z) t (the multilinear extension along its diagonal), a polynomial of
    degree m - 1: m / 2 Gauss-Legendre points, rounded up, give it exactly."""
    n, m = o.shape
    t, weight = np.polynomial.legendre.leggauss((m + 1) // 2)
    gain = o - z
    factor = z[:, None, None] + gain.T[:, :, None] * ((t + 1) / 2)      # feature, row, point
    after = np.ones((m, *factor.shape[1:]))
    for j in range(m - 1, 0, -1):
        after[j - 1] = after[j] * factor[j]
    out, before = np.empty((n, m)), np.ones(factor.shape[1:])
    for j in range(m):
        out[:, j] = gain[:, j] * ((before * after[j]) @ (weight / 2))
        before = before * factor[j]
    return out


def shap_batch(trees, weights, x: np.ndarray) -> np.ndarray:
    """Path-dependent TreeSHAP of all rows at once, leaf path by leaf path.

    On the way to a leaf every row has a code: bit j is set where the row passes all
    tests of the path's j-th feature.  Rows of the same code get the same shares."""
    phi = np.zeros(x.shape[::-1])
    columns = np.ascontiguousarray(x.T)
    for t, w in zip(trees, weights):
        todo = [(0, {}, np.zeros(len(x), np.int64))]
        while todo:
            node, held, code = todo.pop()
            if t["left"][node] < 0:
                if held:
                    _add_leaf(phi, held, code, w * t["value"][node])
                continue
            f, cover = int(t["feat"][node]), t["cover"][node]
            to_left = np.isin(columns[f], list(t["cats"][node])) if t["cats"][node] is not None else columns[f] <= t["thr"][node]
            j, z = held.get(f, (len(held), 1.0))
            for child, passed in ((t["left"][node], to_left), (t["right"][node], ~to_left)):
                ratio = t["cover"][child] / cover if cover > 0 else 0.0
                bit = passed.astype(np.int64) << j
                todo.append((child, {**held, f: (j, z * ratio)}, code & (bit | ~(1 << j)) if f in held else code | bit))
    return phi.T


def _add_leaf(phi: np.ndarray, held: dict, code: np.ndarray, value: float) -> None:
    """Add a leaf's shares to (feature, row) ``phi``; held: feature -> (its bit, cover ratio)."""
    m = len(held)
    if 2**m > len(code):
        patterns, code = np.unique(code, return_inverse=True)
    else:
        patterns = np.arange(2**m)
    shares = value * path_shares(np.array([z for _, z in held.values()]), ((patterns[:, None] >> np.arange(m)) & 1).astype(float)).T
    for f, (j, _) in held.items():
        phi[f] += shares[j][code]


def expected_value(t) -> float:
    leaves = t["left"] < 0
    return float((t["value"][leaves] * t["cover"][leaves]).sum() / t["cover"][leaves].sum())


def tree_shap(model: PipelineModel, df: DataFrame, key: str = S.KEY,
              features: str = "features") -> tuple[DataFrame, float, str]:
    """H1: (key, phi array<double>, output, x) for every row; returns (frame, base value, space)."""
    clf = model.stages[-1]
    trees, weights, space = tree_table(clf)
    base = float(sum(w * expected_value(t) for t, w in zip(trees, weights)))
    scored = model.transform(df)
    out_col = vector_to_array("probability")[1] if space == "probability" else \
        vector_to_array("rawPrediction")[1]
    rows = scored.select(key, vector_to_array(features).alias("_x"), out_col.alias("output"))
    # explanation is CPU-heavy per row: make sure every core gets a share
    par = default_buckets(df.sparkSession, factor=1, floor=1)
    if rows.rdd.getNumPartitions() < par:
        rows = rows.repartition(par)

    def explain(batches):
        for pdf in batches:
            if len(pdf):
                phi = shap_batch(trees, weights, np.stack(pdf["_x"].to_numpy()))
                yield pd.DataFrame({key: pdf[key], "phi": phi.tolist(), "output": pdf["output"], "x": pdf["_x"]})

    res = rows.mapInPandas(explain, f"`{key}` string, phi array<double>, output double, x array<double>")
    return res, base, space


def shap_long(phi_df: DataFrame, names, key: str = S.KEY) -> DataFrame:
    """Wide phi and x arrays -> (key, feature, feature_value, contribution)."""
    nm = F.array(*[F.lit(n) for n in names])
    return phi_df.select(key, "x", F.posexplode("phi").alias("i", "contribution")) \
        .select(key, F.element_at(nm, F.col("i") + 1).alias("feature"), F.get("x", F.col("i")).alias("feature_value"), "contribution")


# ---------------------------------------------------------------- H2

#: Background rows at most; every task has them.
MAX_BACKGROUND = 10_000
#: Draws whose vectors a task holds at once.
DRAWS_AT_ONCE = 1_000


def sampling_shapley(model: PipelineModel, rows: DataFrame, background: DataFrame,
                     draws: int = 100, seed: int = S.SEED, key: str = S.KEY,
                     features: str = "features") -> DataFrame:
    """H2: (key, feature index i, phi) by permutation sampling against a background set.

    Each draw of a row takes one background row and one order of the features, and
    walks from the background to the row feature by feature: p + 1 evaluations, whose
    differences are the contributions.  They sum to f(x) minus the mean output over
    the row's own draws.  ``background`` is a capped sample (the feature's own limit).

    A task walks a batch of draws at once.  Trees that give probabilities are evaluated there
    and a row's draws are summed; the vectors of any other classifier go to its ``transform``.
    """
    import pyarrow as pa
    feat_model = PipelineModel(model.stages[:-1])
    clf = model.stages[-1]
    x = feat_model.transform(rows).select(key, vector_to_array(features).alias("x"))
    bg = feat_model.transform(background).select(vector_to_array(features).alias("z")).orderBy(F.xxhash64("z")).limit(MAX_BACKGROUND + 1)
    z = np.array([r["z"] for r in bg.collect()], float)      # MAX_BACKGROUND rows at most
    if len(z) > MAX_BACKGROUND:
        raise ValueError(f"more than {MAX_BACKGROUND} background rows, see capped_sample")
    if not len(z):
        raise ValueError("no background rows")
    nbg, p = z.shape
    table = _probability_trees(clf)
    # a row's draws are many: every core gets a share of the rows
    x = x.repartition(max(x.rdd.getNumPartitions(), default_buckets(rows.sparkSession)), key)
    e = x.select(F.col(key).cast("string").alias("k"), "x", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("s")) \
        .withColumn("b", F.pmod(F.xxhash64(F.lit(seed), F.col("k"), F.col("s")), F.lit(nbg)))
    order = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.xxhash64(F.lit(seed + 1), F.col("k"), F.col("s"), i))
    e = e.select("k", "x", "b", order.alias("h"))

    def walks(batches):
        """Keys, orders, and the vectors (draw, step, feature) of some draws."""
        for whole in batches:
            for at in range(0, whole.num_rows, DRAWS_AT_ONCE):
                batch = whole.slice(at, DRAWS_AT_ONCE)
                n = batch.num_rows
                mine, h = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, p) for c in (1, 3))
                order = np.argsort(h, axis=1, kind="stable")
                place = np.argsort(order, axis=1)
                steps = np.where(place[:, None, :] < np.arange(p + 1)[None, :, None], mine[:, None, :], z[batch.column(2).to_numpy()][:, None, :])
                yield batch.column(0), order, steps

    def summed(batches):
        for keys, order, steps in walks(batches):
            v = table_output(*table, steps.reshape(-1, p)).reshape(len(order), p + 1)
            phi = np.empty((len(order), p))
            np.put_along_axis(phi, order, np.diff(v, axis=1), 1)
            names = keys.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))    # a row's draws lie together
            yield pa.RecordBatch.from_arrays([pa.array(names[first], pa.string()), _lists(np.add.reduceat(phi, first, axis=0))], [key, "phi"])

    def laid_out(batches):
        for keys, order, steps in walks(batches):
            none = np.full((len(order), 1), -1)
            now, after = np.concatenate([none, order], axis=1), np.concatenate([order, none], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys.to_numpy(zero_copy_only=False), p + 1), pa.string()), pa.array(now.ravel().astype(np.int32)),
                                              pa.array(after.ravel().astype(np.int32)), _lists(steps.reshape(-1, p))], [key, "now", "next", "x"])

    if table is not None:
        parts = e.mapInArrow(summed, f"`{key}` string, phi array<double>").select(key, F.posexplode("phi").alias("i", "v"))
    else:
        steps = e.mapInArrow(laid_out, f"`{key}` string, now int, next int, x array<double>")
        scored = clf.transform(steps.select(key, "now", "next", array_to_vector("x").alias(features)))
        out = vector_to_array("probability")[1] if "probability" in scored.columns else \
            vector_to_array("rawPrediction")[1]
        # the output with the feature just added, less that before the next one
        parts = scored.select(key, F.explode(F.array(
            F.struct(F.col("now").alias("i"), out.alias("v")),
            F.struct(F.col("next").alias("i"), (-out).alias("v")))).alias("d")).select(key, "d.i", "d.v").where(F.col("i") >= 0)
    return parts.groupBy(key, "i").agg((F.sum("v") / F.lit(float(draws))).alias("phi"))


def _lists(values: np.ndarray):
    """The rows of a matrix as an Arrow list array."""
    import pyarrow as pa
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel()))


def _probability_trees(clf):
    """Trees and weights of a classifier whose probability is the weighted sum of its trees; None for any other."""
    if not isinstance(clf, (HistTreesModel, DecisionTreeClassificationModel, RandomForestClassificationModel)):
        return None
    trees, weights, space = tree_table(clf)
    return (trees, weights) if space == "probability" else None


def table_output(trees, weights, x: np.ndarray) -> np.ndarray:
    """The weighted sum of the trees' values for the rows of ``x``."""
    out, flat, start = np.zeros(len(x)), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    for t, w in zip(trees, weights):
        inner, own, n = t["left"] >= 0, np.arange(len(t["left"])), len(t["left"])
        look = np.where(inner, t["feat"], 0)
        child = np.concatenate([np.where(inner, t["right"], own), np.where(inner, t["left"], own)])
        sets = [i for i in own.tolist() if t["cats"][i] is not None]
        node = np.zeros(len(x), np.int64)
        while inner[node].any():
            value = flat[start + look[node]]
            to_left = value <= t["thr"][node]
            for i in sets:
                here = node == i
                to_left[here] = np.isin(value[here], list(t["cats"][i]))
            node = child[to_left * n + node]
        out += w * t["value"][node]
    return out


# ---------------------------------------------------------------- H3

def permuted_rows(x: DataFrame, p: int, repeats: int, seed: int, key: str, block_rows: int) -> DataFrame:
    """label, j, r and x: every row for each feature j and repeat r, with the feature's values permuted.

    ``x`` has the key, label and x.  Rows are dealt out once, by a hash of key and vector, and a
    task permutes inside blocks of ``block_rows`` to twice as many (one block, if there
    are fewer), so that the many copies of a row come to be where they are scored.
    """
    import pyarrow as pa
    parts = max(1, min(x.count() // block_rows, 10_000))     # by the rows alone: the same on any cluster
    mixed = F.xxhash64(F.lit(seed), F.col(key), F.col("x"))
    dealt = x.select("label", "x", mixed.alias("h"), F.col(key).alias("k")).repartition(parts, "h").sortWithinPartitions("h", "k", "x")

    def blocks(batches):
        """Labels and vectors, a block held back so that the last one is not too small."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p), batch.column(2).to_numpy()
            held = now if held is None else tuple(np.concatenate(z) for z in zip(held, now))
            while len(held[0]) >= 3 * block_rows:
                yield tuple(z[:block_rows] for z in held)
                held = tuple(z[block_rows:] for z in held)
        if held is not None:
            yield held

    def run(batches):
        for label, values, h in blocks(batches):
            for j in range(p):
                for r in range(repeats):
                    out = values.copy()
                    # the block's first hash is its name
                    out[:, j] = values[np.random.default_rng((seed, int(h[0]) % 2**63, j, r)).permutation(len(label)), j]
                    yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(np.full(len(label), j, np.int32)), pa.array(np.full(len(label), r, np.int32)),
                                                      pa.ListArray.from_arrays(np.arange(0, out.size + 1, p, dtype=np.int32), pa.array(out.ravel()))], ["label", "j", "r", "x"])

    return dealt.select(F.col("label").cast("int"), "x", "h").mapInArrow(run, "label int, j int, r int, x array<double>")


def permutation_importance(model: PipelineModel, rows: DataFrame, repeats: int = 10,
                           metric: str = "roc_auc", seed: int = S.SEED, key: str = S.KEY,
                           features: str = "features", bucket_rows: int = 1024) -> DataFrame:
    """H3: (i, importance_mean, importance_std) = metric(original) - metric(permuted)."""
    feat_model = PipelineModel(model.stages[:-1])
    clf = model.stages[-1]
    x = feat_model.transform(rows).select(key, "label", vector_to_array(features).alias("x"))
    p = len(x.first()["x"])
    perm = permuted_rows(x, p, repeats, seed, key, bucket_rows)
    scored = clf.transform(perm.select("label", "j", "r", array_to_vector("x").alias(features)))
    s = scored.select("label", "j", "r", vector_to_array("probability")[1].alias("score"))
    per = M.metric_table(s, groups=["j", "r"]).select("j", "r", F.col(metric).alias("m"))
    base = clf.transform(x.select("label", array_to_vector("x").alias(features))) \
        .select("label", vector_to_array("probability")[1].alias("score"))
    base_m = M.metric_table(base).first()[metric]
    return per.groupBy("j").agg((F.lit(base_m) - F.avg("m")).alias("importance_mean"),
                                F.stddev_pop("m").alias("importance_std")) \
        .withColumnRenamed("j", "i")


# ---------------------------------------------------------------- H7, H10

def reduce_classes(long: DataFrame, class_col: str = "class") -> DataFrame:
    """H7: keep class 1 for binary output, else the class with the largest mean |phi|."""
    classes = long.select(class_col).distinct()
    if classes.count() <= 2:
        return long.where(F.col(class_col) == 1).drop(class_col)
    best = long.groupBy(class_col).agg(F.avg(F.abs("contribution")).alias("m")) \
        .agg(F.max_by(class_col, "m").alias(class_col))
    return long.join(F.broadcast(best), class_col, "left_semi").drop(class_col)


def model_importances(model: PipelineModel, names) -> DataFrame:
    """The learner's own feature importances, named."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = __import__("pyspark").sql.SparkSession.getActiveSession()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)],
                                 "feature string, importance double")

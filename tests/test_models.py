"""Model-side invariants: TreeSHAP additivity, SMOTE geometry, calibration
monotonicity, voting bounds, save/load equality, sinks."""
import os
import tempfile

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from churnspark.operators import resample
from churnspark.plans import ensemble as EN
from churnspark.plans import explain as X
from churnspark.plans import learners as L
from churnspark.plans import modeling as MD
from churnspark.plans.features import ChurnFeatures, fit_yeo_johnson
from churnspark.sources import io


@pytest.fixture(scope="module")
def parts(spark, small_dir):
    return MD._parts(spark, small_dir)


@pytest.mark.parametrize("key,over", [("dt", None), ("rf", {"n_estimators": 5}),
                                      ("gb", {"n_estimators": 5})])
def test_tree_shap_additivity(spark, parts, key, over):
    train, test = parts
    model = L.fit(key, train, overrides=over)
    phi, base, space = X.tree_shap(model, test)
    for r in phi.collect():
        assert abs(base + sum(r.phi) - r.output) < 1e-9


def test_feature_model_save_load(spark, parts):
    train, test = parts
    model = L.fit("dt", train)
    d = tempfile.mkdtemp(prefix="cs-model-")
    io.save_model(model, d)
    again = io.load_model(d)
    a = L.score(model, test, keep=["customerID"]).collect()
    b = L.score(again, test, keep=["customerID"]).collect()
    assert sorted(a) == sorted(b)


def test_smote_balances_and_interpolates(spark, parts):
    train, _ = parts
    enc = ChurnFeatures().fit(train).transform(train).select("customerID", "label", "features")
    out = resample.smote(enc, k=3)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[0] == counts[1]
    mins = np.array([r.x for r in enc.where("label = 1").select(vector_to_array("features").alias("x")).collect()])
    syn = np.array([r.x for r in out.where(F.col("customerID").startswith("syn-"))
                    .select(vector_to_array("features").alias("x")).collect()])
    lo, hi = mins.min(axis=0) - 1e-9, mins.max(axis=0) + 1e-9
    assert ((syn >= lo) & (syn <= hi)).all()


def test_knn_exact(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(300, 4)).round(1)
    df = spark.createDataFrame([(i, pts[i].tolist()) for i in range(300)], "id long, x array<double>")
    vals = resample.distinct_values(df.withColumn("label", F.lit(1)), "x", "label")
    knn = resample.knn_values(vals.select("vid", "x"), vals.select("vid", "x", "n"), 5, "x", 1)
    got = {}
    for r in knn.collect():
        got.setdefault(r.qid, []).append(r.d2)
    xs = {r.vid: np.array(r.x) for r in vals.collect()}
    ns = {r.vid: r.n for r in vals.collect()}
    for q, xq in list(xs.items())[:50]:
        d = sorted([((xq - xr) ** 2).sum()] * (ns[v] - (1 if v == q else 0))
                   for v, xr in xs.items())
        flat = sorted(x for lst in d for x in lst)[:5]
        assert abs(max(got[q]) - flat[-1]) < 1e-9


def test_calibration_monotone_and_voting_bounds(spark, parts):
    train, test = parts
    cal = EN.fit_calibrated("dt", train, cv=3)
    for base, iso in cal.parts:
        b = iso.boundaries.toArray()
        p = iso.predictions.toArray()
        assert np.all(np.diff(b) >= 0) and np.all(np.diff(p) >= -1e-12)
    vote = EN.VotingModel({"dt": L.fit("dt", train), "logreg": L.fit("logreg", train)})
    s = vote.member_scores(test).withColumn("v", (F.col("p_dt") + F.col("p_logreg")) / 2)
    for r in s.collect():
        assert min(r.p_dt, r.p_logreg) - 1e-12 <= r.v <= max(r.p_dt, r.p_logreg) + 1e-12


def test_yeo_johnson_fit_is_likelihood_max(spark):
    rng = np.random.default_rng(1)
    x = rng.lognormal(size=2000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = fit_yeo_johnson(df, ["x"])["x"]

    def ll(l):
        t = np.log1p(x) if abs(l) < 1e-12 else ((x + 1) ** l - 1) / l
        return -len(x) / 2 * np.log(t.var()) + (l - 1) * np.log1p(x).sum()
    lo, hi = -2.0, 2.0
    for _ in range(200):                          # golden section
        a, b = hi - (hi - lo) * 0.6180339887498949, lo + (hi - lo) * 0.6180339887498949
        lo, hi = (a, hi) if ll(a) < ll(b) else (lo, b)
    assert abs(lam - (lo + hi) / 2) < 1e-5


def test_yeo_johnson_slopes_and_scans(spark, monkeypatch):
    from churnspark.functions import features as FF
    from churnspark.plans import features as PF
    xs, lams = [-30.0, -2.5, -1e-3, 0.0, 1e-3, 0.7, 40.0], [-1.0, -1e-4, 0.0, 0.3, 1.0, 1.9999, 2.0, 3.0]
    df = spark.createDataFrame([(x, l) for x in xs for l in lams], "x double, l double")
    t, t1, t2 = FF.yeo_johnson_slopes(F.col("x"), F.col("l"))

    def plain(x, l):
        u, a = (np.log1p(x), l) if x >= 0 else (np.log1p(-x), 2 - l)
        s = np.linspace(0, u, 20001)
        w = np.exp(a * s)
        g, g1, g2 = (np.trapezoid(w * s**k, s) for k in range(3))
        return (g, g1, g2) if x >= 0 else (-g, g1, -g2)

    for r in df.select("x", "l", t.alias("t"), t1.alias("t1"), t2.alias("t2")).collect():
        assert np.allclose((r.t, r.t1, r.t2), plain(r.x, r.l), rtol=1e-6, atol=1e-12)
    calls, real = [], PF._likelihoods
    monkeypatch.setattr(PF, "_likelihoods", lambda *args: calls.append(1) or real(*args))
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(3, 2, 1500), rng.lognormal(1, 0.5, 500)])
    four = fit_yeo_johnson(spark.createDataFrame([(float(v), 5.0) for v in x], "x double, same double"), ["x", "same"])
    assert len(calls) == 4 and four["same"] == 1.0
    eight = fit_yeo_johnson(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"], scans=8)
    assert abs(four["x"] - eight["x"]) < 1e-6


def test_registry_and_csv(spark):
    d = tempfile.mkdtemp(prefix="cs-io-")
    reg = os.path.join(d, "registry")
    io.registry_append(spark, reg, "a", {"pr_auc": 0.5}, {}, now=1.0)
    io.registry_append(spark, reg, "b", {"roc_auc": 0.9}, {}, now=2.0)
    io.registry_append(spark, reg, "c", {"pr_auc": 0.5}, {}, now=3.0)
    best = io.registry_latest_best(io.read_registry(spark, reg)).first()
    assert best.name == "c"
    csv = os.path.join(d, "c.csv")
    with open(csv, "w") as f:
        f.write("customerID,gender,SeniorCitizen,Partner,Dependents,tenure,PhoneService,MultipleLines,"
                "InternetService,OnlineSecurity,OnlineBackup,DeviceProtection,TechSupport,StreamingTV,"
                "StreamingMovies,Contract,PaperlessBilling,PaymentMethod,MonthlyCharges,TotalCharges,Churn\n")
        f.write("X1,Male,0,Yes,No,1,Yes,No,DSL,No,No,No,No,No,No,One year,Yes,NA,20.5, ,No\n")
    r = io.read_customers(spark, csv).first()
    assert r.PaymentMethod is None and r.TotalCharges == " " and r.MonthlyCharges == 20.5


def test_streaming_scoring(spark, parts):
    from churnspark.plans import catalog as C
    from churnspark.streaming.scoring import score_stream
    train, _ = parts
    model = L.fit("dt", train)
    d = tempfile.mkdtemp(prefix="cs-stream-")
    src, sink, ck = (os.path.join(d, x) for x in ("src", "sink", "ck"))
    C.raw(spark, "/root/testdata/sf0.001").drop("score").write.parquet(src)
    q = score_stream(spark, model, src, sink, ck)
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == 150 and set(out.columns) >= {"customerID", "prediction", "probability"}
    # the same rows as CSV, columns in another order: named by the header
    raw, csv, again, ck2 = C.raw(spark, "/root/testdata/sf0.001").drop("score"), *(os.path.join(d, x) for x in ("csv", "again", "ck2"))
    raw.select(*sorted(raw.columns)).coalesce(1).write.option("header", True).csv(csv)
    score_stream(spark, model, csv, again, ck2, fmt="csv").awaitTermination(120)
    same = out.select("customerID", "prediction", "probability")
    assert spark.read.parquet(again).select(*same.columns).exceptAll(same).count() == 0 and spark.read.parquet(again).count() == 150
    os.makedirs(os.path.join(d, "empty"))
    score_stream(spark, model, os.path.join(d, "empty"), os.path.join(d, "none"), os.path.join(d, "ck4"), fmt="csv").awaitTermination(120)
    # files whose orders differ stop the query
    raw.select(*sorted(raw.columns, reverse=True)).coalesce(1).write.mode("append").option("header", True).csv(csv)
    with pytest.raises(Exception, match="header"):
        score_stream(spark, model, csv, os.path.join(d, "third"), os.path.join(d, "ck3"), fmt="csv").awaitTermination(120)


def test_promote_best_saves_ensemble(spark, parts):
    from churnspark.plans.flow import promote_best
    from churnspark.operators import metrics as M
    train, test = parts
    models = {"dt": L.fit("dt", train)}
    models["vote"] = EN.VotingModel({"dt": models["dt"], "logreg": L.fit("logreg", train)})
    scored = [L.score(models["dt"], test).select(F.lit("dt").alias("model"), "label", "score"),
              models["vote"].transform(test).select(F.lit("vote").alias("model"), "label", "score")]
    table = M.metric_table(scored[0].unionByName(scored[1]), groups=["model"])
    d = tempfile.mkdtemp(prefix="cs-best-")
    name = promote_best(models, table, d)
    back = EN.load_any(os.path.join(d, "best"))
    a = sorted(r.score for r in (back.transform(test) if name == "vote" else L.score(back, test)).collect())
    b = sorted(r.score for r in (models[name].transform(test) if name == "vote"
                                 else L.score(models[name], test)).collect())
    assert a == b


def test_roles(spark):
    from churnspark.operators.encode import select_roles
    df = spark.createDataFrame([("k", "a", 1, 2.0, "Yes")], "customerID string, g string, i int, d double, Churn string")
    assert select_roles(df) == {"categorical": ["g"], "numerical": ["i", "d"]}
    assert select_roles(df, ["g", "zz"], ["d"]) == {"categorical": ["g"], "numerical": ["d"]}


def test_shared_prefix_search_equals_full_refits(spark, parts):
    # fitting the feature stage once per fold must give the same CV metrics as
    # refitting the whole pipeline for every candidate
    from pyspark.ml import Pipeline
    from pyspark.ml.tuning import CrossValidator
    from churnspark.plans import tune as T
    train, _ = parts
    combos = T.grid_combos({"max_depth": [2, 4], "class_weight": [None]})
    pipe, _ = L.build_pipeline("dt")
    folded = T.with_folds(L.training_columns(train), 3)
    got = []
    for p in (Pipeline(stages=pipe.getStages()), T.SharedPrefixPipeline(stages=pipe.getStages())):
        cv = CrossValidator(estimator=p, estimatorParamMaps=T._param_maps("dt", p, combos),
                            evaluator=T.ExactMetricEvaluator("roc_auc"), foldCol=T.FOLD,
                            numFolds=3, parallelism=2)
        got.append(cv.fit(folded).avgMetrics)
    folded.unpersist()
    assert np.allclose(got[0], got[1], rtol=0, atol=1e-12)


def test_search_queries_call_the_operators_in_full(spark, parts, small_dir, monkeypatch):
    from churnspark.plans import flow
    from churnspark.plans import tune as T
    seen = {}

    class Stop(Exception):
        pass

    def taken(name):
        def call(*args, **kwargs):
            seen[name] = (args, kwargs)
            raise Stop
        return call

    monkeypatch.setattr(T, "_search", taken("search"))
    monkeypatch.setattr(T, "model_search", taken("model"))
    monkeypatch.setattr(flow, "train_flow", taken("flow"))

    def called(query, name):
        with pytest.raises(Stop):
            MD.MODEL_QUERIES[query](spark, small_dir)
        return seen[name]

    assert len(called("grid_search", "search")[0][2]) == 144
    assert len({tuple(c.items()) for c in called("random_search", "search")[0][2]}) == 50
    args, kwargs = called("model_search", "model")
    assert args[0] == "xgb" and kwargs["n_trials"] == 20
    plan = called("advanced_flow", "flow")[0][2]
    assert {*flow.FlowPlan().learners, "logreg", "xgb"} <= set(plan.learners) and plan.search_trials == 20
    assert {*plan.ensembles} == {"voting", "stacking"}


def test_equal_candidates_are_fitted_once_and_all_reported(spark, parts, monkeypatch):
    from churnspark.plans import tune as T
    train, _ = parts
    fits = []
    real = T.CrossValidator

    def counted(**kwargs):
        fits.append(len(kwargs["estimatorParamMaps"]))
        return real(**kwargs)

    monkeypatch.setattr(T, "CrossValidator", counted)
    model, combos = T.grid_search("dt", train, {"max_depth": [1, 4], "min_samples_split": [10, 50]}, k=2)
    assert fits == [2] and len(combos) == len(model.stdMetrics) == 4
    shallow, same, deep, last = model.avgMetrics
    assert shallow == same != deep == last
    assert T.results_table(spark, model, combos).count() == 4


@pytest.mark.parametrize("key,name", [("rf", "forest_shap_additivity"), ("gb", "boost_shap_additivity")])
def test_additivity_checks_see_a_wrong_base_value(spark, parts, small_dir, monkeypatch, key, name):
    from churnspark.plans.checks import CHECK_QUERIES
    model, real = L.fit(key, parts[0], overrides={"n_estimators": 3}), X.tree_shap
    monkeypatch.setattr(MD, "fitted", lambda spark, d, asked: {key: model}[asked])
    assert CHECK_QUERIES[name](spark, small_dir).first()["n_bad"] == 0
    monkeypatch.setattr(X, "tree_shap", lambda *args: (lambda phi, base, space: (phi, base + 0.01, space))(*real(*args)))
    r = CHECK_QUERIES[name](spark, small_dir).first()
    assert r["n_bad"] == r["n_rows"] > 0


@pytest.mark.parametrize("piece,pivots", [(2048, 64), (40, 10)])
def test_knn_by_pivots_equals_brute_force(spark, monkeypatch, piece, pivots):
    """Clusters, copies, ties on a grid, fewer rows than k."""
    monkeypatch.setattr(resample, "PIECE", piece)
    monkeypatch.setattr(resample, "VALUES_PER_PIVOT", pivots)
    rng = np.random.default_rng(7)
    clustered = rng.normal(size=(12, 6))[rng.integers(0, 12, 900)] * 8 + rng.normal(size=(900, 6)) * 0.2
    grid = rng.integers(0, 4, size=(300, 3)).astype(float)
    for pts, k in ((clustered, 5), (grid, 4), (rng.normal(size=(3, 2)), 5)):
        df = spark.createDataFrame([(pts[i].tolist(), 1) for i in range(len(pts))], "x array<double>, label int").repartition(5)
        vals = resample.distinct_values(df, "x", "label")
        knn = resample.knn_values(vals.select("vid", "x"), vals.select("vid", "x", "n"), k).collect()
        xs = {r.vid: (np.array(r.x), r.n) for r in vals.collect()}
        got = {}
        for r in knn:
            got.setdefault(r.qid, []).append((round(r.d2, 9), r.rid, r["take"]))
        for q, (xq, _) in xs.items():
            near = sorted((round(float(((xq - xr) ** 2).sum()), 9), v, n - (v == q)) for v, (xr, n) in xs.items())
            want, left = [], k
            for d, v, n in near:
                if n > 0 and left > 0:
                    want.append((d, v, min(n, left)))
                    left -= min(n, left)
            assert [w[0] for w in want] == [g[0] for g in sorted(got.get(q, []))]
            assert sum(w[2] for w in want) == sum(g[2] for g in got.get(q, []))


def test_smote_rows_lie_on_segments_to_neighbours(spark):
    rng = np.random.default_rng(9)
    pts = rng.normal(size=(80, 3)).round(2)
    rows = [(f"m{i}", 1, pts[i].tolist()) for i in range(30)] + [(f"n{i}", 0, pts[30 + i].tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "customerID string, label int, x array<double>")
    out = resample.smote(df.select("customerID", "label", array_to_vector("x").alias("features")), k=4)
    minority = pts[:30]
    d = ((minority[:, None] - minority[None]) ** 2).sum(axis=2) + np.diag(np.full(30, np.inf))
    near = np.argsort(d, axis=1)[:, :4]
    made = [np.array(r.features.toArray()) for r in out.where("customerID LIKE 'syn-%'").collect()]
    assert len(made) == 20
    for p in made:
        assert any(np.linalg.norm(np.cross(p - minority[i], minority[j] - minority[i])) < 1e-8
                   and -1e-9 <= (p - minority[i]) @ (minority[j] - minority[i]) <= d[i, j] + 1e-9 for i in range(30) for j in near[i])

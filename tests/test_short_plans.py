"""Classifiers read rows that are cut off from the plan that encoded them, and a stacking's
fold is encoded once for all its members."""
import pytest

from churnspark.plans import ensemble as EN
from churnspark.plans import learners as L
from churnspark.plans import modeling as MD
from churnspark.plans.features import ChurnFeatures


@pytest.fixture(scope="module")
def parts(spark, small_dir):
    return MD._parts(spark, small_dir)


def _plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_labeled_rows_carry_no_plan(spark, small_dir):
    plan = _plan(MD.labeled_cached(spark, small_dir))
    assert "Join" not in plan and "Relation" not in plan


def test_a_fitted_model_does_not_carry_its_feature_stage(parts):
    train, _ = parts
    model = L.fit("logreg", train, overrides={"max_iter": 2})
    assert "tenure" not in _plan(model.stages[-1].summary.predictions)


def test_stacking_encodes_a_fold_once(parts, monkeypatch):
    train, test = parts
    fits, plain = [], ChurnFeatures._fit
    monkeypatch.setattr(ChurnFeatures, "_fit", lambda self, df: fits.append(1) or plain(self, df))
    over = {"logreg": {"max_iter": 2}}
    model = EN.fit_stacking(["dt", "logreg"], train, k=2, overrides=over)
    assert len(fits) == 3
    alone = {k: L.score(L.fit(k, train, overrides=over.get(k)), test, keep=["customerID"]).collect() for k in ("dt", "logreg")}
    scored = EN.VotingModel(model.members).member_scores(test)
    for k, rows in alone.items():
        assert dict(scored.select("customerID", f"p_{k}").collect()) == pytest.approx(dict(rows), abs=1e-12)


def test_a_flow_encodes_its_test_rows_once(parts, monkeypatch):
    from churnspark.plans.features import ChurnFeaturesModel
    from churnspark.plans.flow import FlowPlan, train_flow
    train, test = parts
    runs, plain = [], ChurnFeaturesModel._transform
    monkeypatch.setattr(ChurnFeaturesModel, "_transform", lambda self, df: runs.append(1) or plain(self, df))
    found = train_flow(train, test, FlowPlan(learners=("dt",), ensembles=(), calibration_folds=2))
    assert len(runs) == 2                 # training rows, test rows
    assert {r.model for r in found.comparison.collect()} == {"dt", "dt_calibrated"}


def test_fold_views_carry_no_plan(parts):
    from churnspark.plans import tune as T
    train, _ = parts
    assert "tenure" not in _plan(T.fold_views(T.with_folds(train, 2), 2))


def test_a_flow_fits_a_member_on_the_same_rows_once(parts, monkeypatch):
    """The stacking takes the members that the flow has fitted; fits of few rows have few tasks."""
    from churnspark.plans import learners as L
    from churnspark.plans.flow import FlowPlan, train_flow
    train, test = parts
    fits, fit = [], L.fit_vectors
    monkeypatch.setattr(L, "fit_vectors", lambda key, features, vectors, overrides=None: fits.append((key, vectors.rdd.getNumPartitions())) or fit(key, features, vectors, overrides))
    over = {"logreg": dict(max_iter=3), "dt": dict(max_depth=2), "gb": dict(n_estimators=3)}
    found = train_flow(train, test, FlowPlan(learners=("dt", "gb", "logreg"), ensembles=("stacking",), folds=2, calibration_folds=0, overrides=over))
    assert sorted(key for key, _ in fits) == ["dt"] * 3 + ["logreg"] * 3      # all rows, and without each of two folds
    assert {n for _, n in fits} == {1}
    assert list(found.models) == ["dt", "gb", "logreg", "stacking"] and found.comparison.count() == 4
    assert all(found.models["stacking"].members[key] is found.models[key] for key in ("dt", "gb", "logreg"))

"""The landmark map against the exact kernel."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from churnspark.plans import learners as L
from churnspark.plans import modeling as MD
from churnspark.sources import io


def mapped(spark, x, m, gamma="0.05"):
    df = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x.tolist())], ["i", "features"])
    model = L.LandmarkKernelMap(numLandmarks=m, gamma=gamma).fit(df)
    return model, np.array([r.kernel_map.toArray() for r in model.transform(df).orderBy("i").collect()])


def test_closer_to_the_kernel_than_random_cosines(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 8)) + 3 * r.integers(0, 2, size=(400, 1))
    exact = L.rbf_kernel(x, x, 0.05)
    _, z = mapped(spark, x, 100)
    w, b = r.normal(0, np.sqrt(2 * 0.05), size=(200, 8)), r.uniform(0, 2 * np.pi, 200)
    cosines = np.sqrt(2 / 200) * np.cos(x @ w.T + b)
    assert np.abs(z @ z.T - exact).mean() < 0.3 * np.abs(cosines @ cosines.T - exact).mean()


def test_exact_with_all_rows_as_landmarks_copies_and_saving(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(60, 5))
    x = np.concatenate([x, x[:30]])               # copies are one landmark
    model, z = mapped(spark, x, 200)
    assert np.allclose(z @ z.T, L.rbf_kernel(x, x, 0.05), atol=1e-6)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = L.LandmarkKernelModel.load(str(tmp_path / "m"))
    df = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x[:3].tolist())], ["i", "features"])
    assert [r.kernel_map for r in again.transform(df).collect()] == [r.kernel_map for r in model.transform(df).collect()]


def test_scale_gamma(spark):
    x = np.random.default_rng(5).normal(size=(50, 4)) * 3
    model, _ = mapped(spark, x, 20, "scale")
    assert model.getOrDefault("gamma") == pytest.approx(1 / (4 * x.var()))


def test_svc_learner(spark, small_dir, tmp_path):
    train, test = MD._parts(spark, small_dir)
    model = L.fit("svc", train)
    scores = [r.score for r in L.score(model, test, keep=["customerID"]).collect()]
    assert scores and all(0 <= s <= 1 for s in scores) and len(set(scores)) > 5
    io.save_model(model, str(tmp_path / "svc"))
    assert sorted(r.score for r in L.score(io.load_model(str(tmp_path / "svc")), test, keep=["customerID"]).collect()) == sorted(scores)

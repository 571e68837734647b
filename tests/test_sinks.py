"""What the sinks write reads back; frames of explanations; catalogue subsets; CV with the refitted pipeline."""
import json

import pytest
from pyspark.ml.linalg import Vectors

from churnspark.operators import explain as OE
from churnspark.plans import explain as X
from churnspark.plans import learners as L
from churnspark.plans import modeling as MD
from churnspark.plans import tune as T
from churnspark.sources import io


def lines(folder):
    return [json.loads(x) for f in sorted(folder.glob("part-*")) for x in f.read_text().splitlines()]


def test_processed_rows_and_feature_names(spark, tmp_path):
    train, test = (spark.createDataFrame([(i, float(i))], "id int, v double") for i in (1, 2))
    io.save_processed(train, test, ["v"], str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "processed"))
    assert sorted(map(tuple, back.select("id", "v", "split").collect())) == [(1, 1.0, "train"), (2, 2.0, "test")]
    assert lines(tmp_path / "feature_names") == [{"idx": 0, "name": "v"}]


def test_predictions_and_segments(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.75, "High"), ("b", 0, 0.25, "Low"), ("c", 1, 0.9, "High")], "customerID string, prediction int, score double, risk_segment string")
    io.write_predictions(df, str(tmp_path / "p"))
    back = spark.read.option("header", True).csv(str(tmp_path / "p"))
    assert back.columns == ["customerID", "prediction", "probability"]
    assert sorted(map(tuple, back.collect())) == [("a", "1", "0.75"), ("b", "0", "0.25"), ("c", "1", "0.9")]
    io.export_segments(df, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("risk_segment=*")) == ["risk_segment=High", "risk_segment=Low"]
    assert spark.read.option("header", True).csv(str(tmp_path / "s" / "risk_segment=High")).count() == 2


def test_metrics_tuning_and_run_log(spark, tmp_path):
    io.write_metrics(io.metrics_long(spark, "dt", {"f1": 0.5, "none": None}), str(tmp_path / "m"))
    assert lines(tmp_path / "m") == [{"model": "dt", "split": "test", "metric": "f1", "value": 0.5}]
    io.write_tuning(spark.createDataFrame([(0, 0.7)], "candidate int, mean double"), str(tmp_path / "t"))
    assert lines(tmp_path / "t") == [{"candidate": 0, "mean": 0.7}]
    first = io.log_run(spark, str(tmp_path / "r"), "exp", {"auc": 0.8}, {"k": 5}, {"by": "me"})
    second = io.log_run(spark, str(tmp_path / "r"), "exp", {"auc": 0.9})
    log = spark.read.parquet(str(tmp_path / "r"))
    assert first != second and log.count() == 4
    assert sorted(tuple(r)[1:5] for r in log.collect()) == [("exp", "metric", "auc", "0.8"), ("exp", "metric", "auc", "0.9"), ("exp", "param", "k", "5"), ("exp", "tag", "by", "me")]


def test_frames_of_explanations(spark):
    df = spark.createDataFrame([("a", Vectors.dense(1.0, 2.0)), ("b", Vectors.sparse(2, [1], [3.0]))], ["customerID", "phi"])
    named = OE.to_named_frame(df, "phi", ["x", "y"], keep=("customerID",))
    assert named.columns == ["customerID", "x", "y"] and sorted(map(tuple, named.collect())) == [("a", 1.0, 2.0), ("b", 0.0, 3.0)]
    assert OE.to_named_frame(df, "phi").columns == ["f0", "f1"]
    long = spark.createDataFrame([("a", c, f, v) for c, f, v in ((0, "x", 1.0), (1, "x", -1.0), (2, "x", 5.0), (2, "y", -4.0))], "customerID string, class int, feature string, contribution double")
    assert X.reduce_classes(long).select("contribution").count() == 2
    assert [r.contribution for r in X.reduce_classes(long.where("class < 2")).collect()] == [-1.0]
    rows = spark.createDataFrame([(k, f, v) for k in "abc" for f, v in (("x", 3.0), ("y", -2.0), ("z", 0.1))], "customerID string, feature string, contribution double")
    some = OE.beeswarm_rows(rows, rows.where("customerID <> 'c'").select("customerID"), top_n=2)
    assert sorted((r.customerID, r.feature) for r in some.collect()) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]


def test_subset_of_the_catalogue():
    assert list(L.subset(["dt", "svc"])) == ["dt", "svc"] and len(L.catalogue()) == 20
    with pytest.raises(KeyError):
        L.subset(["dt", "nothing"])


def test_cross_validation_returns_the_refitted_pipeline(spark, small_dir):
    train, test = MD._parts(spark, small_dir)
    table, model = T.cross_validate("decision_tree_entropy", train, k=3)
    rows = {r.metric: r for r in table.collect()}
    assert set(rows) == {"roc_auc", "accuracy", "f1"} and all(r.folds == 3 for r in rows.values())
    again = L.fit("decision_tree_entropy", train)
    scores = [sorted(r.score for r in L.score(m, test, keep=["customerID"]).collect()) for m in (model, again)]
    assert scores[0] == scores[1]

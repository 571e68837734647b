import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnspark.operators import encode


def _rows(spark):
    return spark.createDataFrame(
        [(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, None, "z"), (5, "b", ""), (7, "b", None)], "id int, p string, q string")


def test_sparse_one_hot_equals_the_columns(spark, tmp_path):
    df, cols = _rows(spark), ["p", "q"]
    levels = encode.category_levels(df, cols)
    names = encode.one_hot_names(cols, levels)
    model = encode.fit_sparse_one_hot(df, cols)
    model.write().save(str(tmp_path / "hot"))
    unseen = df.union(spark.createDataFrame([(6, "new", "y")], df.schema))
    wide = {r["id"]: [r[n] for n in names] for r in encode.one_hot_drop_first(unseen, cols, levels).collect()}
    for m in (model, PipelineModel.load(str(tmp_path / "hot"))):
        got = {r["id"]: r["v"] for r in m.transform(unseen).select("id", vector_to_array("onehot").alias("v")).collect()}
        assert got == wide and m.transform(unseen).columns == ["id", "p", "q", "onehot"]
    assert wide[6] == [0.0, 0.0, 0.0, 1.0, 0.0] and wide[4] == [0.0, 0.0, 0.0, 0.0, 1.0]


def test_columns_of_one_level_have_no_components(spark):
    df = _rows(spark).withColumn("same", F.lit("k"))
    row = encode.fit_sparse_one_hot(df, ["same", "q"]).transform(df).orderBy("id").first()
    assert row["onehot"].size == 3
    with pytest.raises(ValueError):
        encode.fit_sparse_one_hot(df, ["same"])


def test_many_levels_do_not_widen_the_plan(spark):
    df = spark.range(20_000).select(F.concat(F.lit("v"), "id").alias("p"))
    got = encode.fit_sparse_one_hot(df, ["p"]).transform(df)
    assert len(got._jdf.queryExecution().executedPlan().toString()) < 5000
    row = got.filter("p = 'v7'").first()["onehot"]
    assert row.size == 19_999 and len(row.indices) == 1


def test_level_limit_raises(spark):
    df = _rows(spark)
    assert encode.category_levels(df, ["p", "q"], max_levels=4)["p"] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="'p'"):
        encode.category_levels(df.withColumn("q", F.lit("k")), ["p", "q"], max_levels=2)

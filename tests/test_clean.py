"""Edge rows of FIXTURES.md §4 for cleaning and feature expressions."""
from pyspark.sql import functions as F

from churnspark.functions import clean, features
from churnspark.plans import catalog


def test_total_charges_parse_and_median(spark):
    df = spark.createDataFrame([("a", " "), ("b", "abc"), ("c", None), ("d", "10.5"), ("e", "1.0d"),
                                ("f", "NaN"), ("g", " 20 ")], "customerID string, TotalCharges string")
    fitted = clean.fit_lenient(df)
    assert fitted["TotalCharges_median"] == 15.25
    out = {r.customerID: r.TotalCharges for r in clean.clean_lenient(df, fitted).collect()}
    assert out == {"a": 15.25, "b": 15.25, "c": 15.25, "d": 10.5, "e": 15.25, "f": 15.25, "g": 20.0}


def test_lenient_flag_coercion(spark):
    df = spark.createDataFrame([("TRUE",), ("no",), ("2.7",), (None,), ("No internet service",),
                                ("-2.7",)], "Partner string")
    got = [r[0] for r in df.select(clean.coerce_flag(df, "Partner")).collect()]
    assert got == [1, 0, 2, 0, 0, -2]
    b = spark.createDataFrame([(True,), (False,), (None,)], "Partner boolean")
    assert [r[0] for r in b.select(clean.coerce_flag(b, "Partner")).collect()] == [1, 0, 0]


def test_strict_flags_need_whole_column(spark):
    df = spark.createDataFrame([("Yes", "Yes"), ("No", "Maybe")], "Partner string, Dependents string")
    assert clean.strict_flag_columns(df, ["Partner", "Dependents"]) == ["Partner"]


def test_contract_lenient_and_strict(spark):
    df = spark.createDataFrame([("Three year",), ("One year",)], "Contract string")
    c = F.col("Contract")
    assert [r[0] for r in df.select(clean.contract_ordinal(c, True)).collect()] == [0, 2]
    assert [r[0] for r in df.select(clean.contract_ordinal(c, False)).collect()] == [None, 2]


def test_tenure_bins(spark):
    vals = [12, 13, 24, 25, 48, 49, 60, 61, None]
    df = spark.createDataFrame([(v,) for v in vals], "tenure int")
    got = [r[0] for r in df.select(features.tenure_group(df)).collect()]
    assert got == ["0-12 Months", "13-24 Months", "13-24 Months", "25-48 Months", "25-48 Months",
                   "49-60 Months", "49-60 Months", "61-72 Months", "61-72 Months"]
    s = spark.createDataFrame([("x",), ("12",), (None,)], "tenure string")
    assert [r[0] for r in s.select(features.tenure_group(s)).collect()] == \
        ["Unknown", "0-12 Months", "Unknown"]


def test_avg_charge_zero_services(spark):
    df = spark.createDataFrame([(0, 30.0), (3, 30.0)], "NumServices int, MonthlyCharges double")
    assert [r[0] for r in df.select(features.avg_charge()).collect()] == [30.0, 10.0]


def test_fixture_view_equals_sql(spark, small_dir):
    """The DataFrame version of the customer view equals the SQL text."""
    from churnspark.sources.fixtures import TELCO_RAW_SQL
    for t in ("customer", "orders"):
        spark.read.parquet(f"{small_dir}/{t}.parquet").createOrReplaceTempView(t)
    a = catalog.raw(spark, small_dir)
    b = spark.sql(TELCO_RAW_SQL)
    assert a.count() == b.count() == 150
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0

"""Worked examples with every value written out: the SQL of the other checks takes these
values from the library's own constants, so a wrong one would be wrong on both sides."""
from pyspark.sql import functions as F

from churnspark.functions import clean, features
from churnspark.operators import metrics, risk


def test_tenure_values(spark):
    df = spark.createDataFrame([(t,) for t in (0, 5, 6, 12, 13, 24, 25, 48, 49, 60, 61, 72)], "tenure int")
    got = [tuple(r) for r in df.select("tenure", features.tenure_group(df), features.long_term(), features.less_than_6_months()).collect()]
    assert got == [
        (0, "0-12 Months", 0, 1), (5, "0-12 Months", 0, 1), (6, "0-12 Months", 0, 0), (12, "0-12 Months", 0, 0),
        (13, "13-24 Months", 0, 0), (24, "13-24 Months", 0, 0), (25, "25-48 Months", 1, 0), (48, "25-48 Months", 1, 0),
        (49, "49-60 Months", 1, 0), (60, "49-60 Months", 1, 0), (61, "61-72 Months", 1, 0), (72, "61-72 Months", 1, 0)]


def test_services_counted_and_average_charge(spark):
    flags = ["PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"]
    one = spark.createDataFrame([("DSL", 70.0, *[1] * 8), ("Fiber optic", 70.0, *[0] * 4, 1, *[0] * 3), ("No", 20.0, *[0] * 8)],
                                "InternetService string, MonthlyCharges double, " + ", ".join(f"{f} int" for f in flags))
    df = one.withColumn("AvailingInternetService", features.availing_internet())
    df = df.withColumn("NumServices", features.num_services(df)).withColumn("AvgCharge", features.avg_charge())
    # DeviceProtection is not counted; with no service the average is the charge
    assert [(r.AvailingInternetService, r.NumServices, r.AvgCharge) for r in df.collect()] == [(1, 8, 8.75), (1, 1, 70.0), (0, 0, 20.0)]


def test_cleaning_values(spark):
    texts = ["29.85", " 1e3 ", "+7", ".5", "-2.", "", " ", "abc", "1,000", "NaN", "Infinity", "1d", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.orderBy("i").select(clean.text_to_double(F.col("t")).alias("v")).collect()]
    assert got == [29.85, 1000.0, 7.0, 0.5, -2.0, *[None] * 8]
    words = spark.createDataFrame([("Month-to-month", "No internet service"), ("One year", "No phone service"), ("Two year", "Yes")], "c string, s string")
    got = [tuple(r) for r in words.select(clean.contract_ordinal(F.col("c")), clean.replace_sentinels(F.col("s"))).collect()]
    assert got == [(1, "No"), (2, "No"), (3, "Yes")]


def test_bands_and_actions(spark):
    df = spark.createDataFrame([(s,) for s in (1.0, 0.9, 0.89, 0.7, 0.69, 0.4, 0.39, 0.0)], "score double")
    got = risk.add_interventions(risk.segment_by_band(df)).orderBy(F.desc("score"))
    assert [r.risk_segment for r in got.collect()] == [
        "Very High Risk", "Very High Risk", "High Risk", "High Risk", "Medium Risk", "Medium Risk", "Low Risk", "Low Risk"]
    rows = {r.risk_segment: {v for v in r.asDict().values() if isinstance(v, str)} - {r.risk_segment} for r in got.collect()}
    assert rows == {
        "Very High Risk": {"30% retention offer", "Immediate manager call", "Critical"},
        "High Risk": {"20% loyalty discount", "Personalized email campaign", "High"},
        "Medium Risk": {"10% upgrade offer", "Automated engagement", "Normal"},
        "Low Risk": {"No discount", "Periodic newsletter", "Low"}}


def test_thresholds(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.499)], "label int, score double")
    assert [r.p for r in df.select(metrics.predicted("score").alias("p")).collect()] == [1, 0]
    sweep = [r.threshold for r in metrics.threshold_sweep(df).orderBy("i").collect()]
    assert len(sweep) == 100 and sweep[0] == 0.0 and sweep[-1] == 1.0 and abs(sweep[1] - 1 / 99) < 1e-12

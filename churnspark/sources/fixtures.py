"""The Telco-style customer table derived from the driver's `customer` + `orders`.

Same rows as the SQL view in FIXTURES.md §3, written with the DataFrame API so
Catalyst prunes both scans to the few columns used and aggregates `orders`
map-side before the one shuffle on the customer key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def _flag(cond: Column) -> Column:
    return F.when(cond, "Yes").otherwise("No")


def telco_raw(spark: SparkSession, sf_dir: str, with_score: bool = True) -> DataFrame:
    """Raw customer table (string flags, text TotalCharges) plus a stand-in `score`."""
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")

    o = orders.groupBy("o_custkey").agg(
        _count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urg"),
        _count_if(F.col("o_orderpriority") == "2-HIGH").alias("n_high"),
        _count_if(F.col("o_orderpriority") == "3-MEDIUM").alias("n_med"),
        _count_if(F.col("o_orderstatus") == "F").alias("n_f"),
        _count_if(F.col("o_orderstatus") == "P").alias("n_p"),
    )
    k = F.col("c_custkey")
    nk = F.col("c_nationkey")
    bal = F.col("c_acctbal")
    seg = F.col("c_mktsegment")
    b = (
        customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
        .join(o, o["o_custkey"] == k, "left")
        .withColumn("ten", ((k * 37) % 73).cast("int"))
        .withColumn("cents", F.lit(1825) + ((k * 7919) % 1000) * 10)
    )
    ten = F.col("ten")
    pts = (
        F.when(bal < 5000, 40).when(bal < 7500, 12).otherwise(4)
        + F.when(seg.isin("MACHINERY", "AUTOMOBILE"), 15).otherwise(0)
        - F.when(ten > 48, 20).when(ten > 24, 10).otherwise(0)
    )
    b = b.withColumn("pts", pts)
    no_inet = seg == "BUILDING"

    def inet_flag(cond: Column) -> Column:
        return F.when(no_inet, "No internet service").when(cond, "Yes").otherwise("No")

    cols = [
        F.concat(F.lit("C"), F.lpad(k.cast("string"), 9, "0")).alias("customerID"),
        F.when(k % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.when(k % 6 == 0, 1).otherwise(0).alias("SeniorCitizen"),
        _flag(nk % 2 == 0).alias("Partner"),
        _flag(nk % 3 == 0).alias("Dependents"),
        ten.alias("tenure"),
        F.when(k % 10 == 0, "No").otherwise("Yes").alias("PhoneService"),
        F.when(k % 10 == 0, "No phone service")
        .when(F.col("n_urg") >= 2, "Yes").otherwise("No").alias("MultipleLines"),
        F.when(seg == "BUILDING", "No")
        .when(seg.isin("MACHINERY", "AUTOMOBILE"), "Fiber optic")
        .otherwise("DSL").alias("InternetService"),
        inet_flag(F.col("n_high") >= 2).alias("OnlineSecurity"),
        inet_flag(F.col("n_med") >= 2).alias("OnlineBackup"),
        inet_flag(F.col("n_f") >= 4).alias("DeviceProtection"),
        inet_flag(F.col("n_p") >= 4).alias("TechSupport"),
        inet_flag(nk % 4 < 2).alias("StreamingTV"),
        inet_flag(nk % 5 < 2).alias("StreamingMovies"),
        F.when(bal < 5000, "Month-to-month").when(bal < 7500, "One year")
        .otherwise("Two year").alias("Contract"),
        _flag(k % 5 < 3).alias("PaperlessBilling"),
        F.when(k % 4 == 0, "Electronic check").when(k % 4 == 1, "Mailed check")
        .when(k % 4 == 2, "Bank transfer (automatic)")
        .otherwise("Credit card (automatic)").alias("PaymentMethod"),
        (F.col("cents").cast("double") / 100).alias("MonthlyCharges"),
        F.when(ten == 0, " ").otherwise(
            ((F.col("cents") * ten).cast("double") / 100).cast("decimal(12,2)").cast("string")
        ).alias("TotalCharges"),
        F.when(F.col("pts") > (k * 104729) % 100, "Yes").otherwise("No").alias("Churn"),
    ]
    if with_score:
        cols.append(
            ((F.col("pts") + 20 + (k * 31) % 25).cast("double") / 100).alias("score")
        )
    return b.select(*cols)


# The same view as SQL text (identical in Spark SQL and DuckDB); used by the
# oracle strings and by tests that cross-check the DataFrame version above.
TELCO_RAW_SQL = """
WITH o AS (
  SELECT o_custkey,
         SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS n_urg,
         SUM(CASE WHEN o_orderpriority = '2-HIGH'   THEN 1 ELSE 0 END) AS n_high,
         SUM(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS n_med,
         SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_f,
         SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS n_p
  FROM orders GROUP BY o_custkey),
b AS (
  SELECT c.*, o.*,
         CAST((c_custkey * 37) % 73 AS INTEGER) AS ten,
         1825 + ((c_custkey * 7919) % 1000) * 10 AS cents
  FROM customer c LEFT JOIN o ON o.o_custkey = c.c_custkey),
p AS (
  SELECT b.*,
         (CASE WHEN c_acctbal < 5000 THEN 40 WHEN c_acctbal < 7500 THEN 12 ELSE 4 END)
       + (CASE WHEN c_mktsegment IN ('MACHINERY','AUTOMOBILE') THEN 15 ELSE 0 END)
       - (CASE WHEN ten > 48 THEN 20 WHEN ten > 24 THEN 10 ELSE 0 END) AS pts
  FROM b)
SELECT CONCAT('C', LPAD(CAST(c_custkey AS VARCHAR(10)), 9, '0')) AS customerID,
 CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
 CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS SeniorCitizen,
 CASE WHEN c_nationkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS Partner,
 CASE WHEN c_nationkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS Dependents,
 ten AS tenure,
 CASE WHEN c_custkey % 10 = 0 THEN 'No' ELSE 'Yes' END AS PhoneService,
 CASE WHEN c_custkey % 10 = 0 THEN 'No phone service' WHEN n_urg >= 2 THEN 'Yes' ELSE 'No' END AS MultipleLines,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'No' WHEN 'MACHINERY' THEN 'Fiber optic' WHEN 'AUTOMOBILE' THEN 'Fiber optic' ELSE 'DSL' END AS InternetService,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'No internet service' WHEN n_high >= 2 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'No internet service' WHEN n_med >= 2 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'No internet service' WHEN n_f >= 4 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'No internet service' WHEN n_p >= 4 THEN 'Yes' ELSE 'No' END AS TechSupport,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'No internet service' WHEN c_nationkey % 4 < 2 THEN 'Yes' ELSE 'No' END AS StreamingTV,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'No internet service' WHEN c_nationkey % 5 < 2 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
 CASE WHEN c_acctbal < 5000 THEN 'Month-to-month' WHEN c_acctbal < 7500 THEN 'One year' ELSE 'Two year' END AS Contract,
 CASE WHEN c_custkey % 5 < 3 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
 CASE c_custkey % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check' WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS PaymentMethod,
 CAST(cents AS DOUBLE) / 100 AS MonthlyCharges,
 CASE WHEN ten = 0 THEN ' ' ELSE CAST(CAST(CAST(cents * ten AS DOUBLE) / 100 AS DECIMAL(12,2)) AS VARCHAR(20)) END AS TotalCharges,
 CASE WHEN pts > (c_custkey * 104729) % 100 THEN 'Yes' ELSE 'No' END AS Churn,
 CAST(pts + 20 + (c_custkey * 31) % 25 AS DOUBLE) / 100 AS score
FROM p
"""

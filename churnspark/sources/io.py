"""Sources and sinks (S1-S8, S10).  All reads/writes are Spark readers/writers;
tables are Parquet (or CSV where the file format is the feature)."""

from __future__ import annotations

import time
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark import schema as S

NA_STRINGS = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None"]

REGISTRY_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("created_at", T.DoubleType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("notes", T.StringType()),
    T.StructField("model_path", T.StringType()),
])

RUN_LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("experiment", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("ts", T.DoubleType()),
])


# ------------------------------------------------------------------ S1

def read_customers(spark: SparkSession, path: str, fmt: str = "csv",
                   schema: T.StructType = S.RAW_SCHEMA) -> DataFrame:
    """Customer table, its columns named by the file's header (no inference pass).

    CSV: the columns of ``schema`` come first, in its order and types, whatever
    their order in the file; those the file lacks stay absent, others follow as
    text.  The usual NA spellings become NULL, text that is no number becomes
    NULL in a numeric column, and a blank ``' '`` stays text so the numeric
    parse (F2) decides.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    df = spark.read.option("header", True).option("inferSchema", False) \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False) \
        .csv(path)
    return typed_customers(df, schema)


def typed_customers(df: DataFrame, schema: T.StructType = S.RAW_SCHEMA) -> DataFrame:
    """The text columns of a customer CSV by name, in the order and types of ``schema``, others after them."""
    known = [f for f in schema.fields if f.name in df.columns]
    rest = [c for c in df.columns if c not in schema.fieldNames()]

    def text(c):
        return F.when(F.col(f"`{c}`").isin(*NA_STRINGS), F.lit(None)).otherwise(F.col(f"`{c}`"))

    return df.select(*[(text(f.name) if isinstance(f.dataType, T.StringType)
                        else F.trim(text(f.name)).try_cast(f.dataType)).alias(f.name) for f in known],
                     *[text(c).alias(c) for c in rest])


# ------------------------------------------------------------------ S2

def save_processed(train: DataFrame, test: DataFrame, feature_names, out_dir: str) -> None:
    """Processed rows partitioned by split, plus the feature-name list."""
    both = train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test")))
    both.write.mode("overwrite").partitionBy("split").parquet(f"{out_dir}/processed")
    spark = train.sparkSession
    spark.createDataFrame([(i, n) for i, n in enumerate(feature_names)], "idx int, name string") \
        .coalesce(1).write.mode("overwrite").json(f"{out_dir}/feature_names")


# ------------------------------------------------------------------ S3, S10

def write_predictions(scored: DataFrame, path: str, key: str = S.KEY,
                      score: str = "score", prediction: str = "prediction") -> None:
    """S3: key, prediction, probability as CSV with a header (the key is kept)."""
    scored.select(key, F.col(prediction).alias("prediction"), F.col(score).alias("probability")) \
        .write.mode("overwrite").option("header", True).csv(path)


def export_segments(segmented: DataFrame, path: str, segment: str = "risk_segment") -> None:
    """One CSV folder per risk segment."""
    segmented.write.mode("overwrite").partitionBy(segment).option("header", True).csv(path)


# ------------------------------------------------------------------ S4, S6

def metrics_long(spark: SparkSession, model: str, metrics: dict, split: str = "test") -> DataFrame:
    return spark.createDataFrame(
        [(model, split, k, float(v)) for k, v in metrics.items() if v is not None],
        "model string, split string, metric string, value double")


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric rows (long or wide) as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_tuning(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


# ------------------------------------------------------------------ S5

def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ------------------------------------------------------------------ S7

def registry_append(spark: SparkSession, registry_path: str, name: str, metrics: dict,
                    params: dict, notes: str | None = None, model_path: str | None = None,
                    now: float | None = None) -> dict:
    """Append one model version to the Parquet registry table."""
    now = time.time() if now is None else now
    version = time.strftime("%Y%m%d_%H%M%S", time.gmtime(now))
    row = (name, version, float(now), {k: float(v) for k, v in metrics.items() if v is not None},
           {k: str(v) for k, v in params.items()}, notes, model_path)
    spark.createDataFrame([row], REGISTRY_SCHEMA).write.mode("append").parquet(registry_path)
    return dict(zip(REGISTRY_SCHEMA.names, row))


def read_registry(spark: SparkSession, registry_path: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(registry_path)


def registry_latest_best(registry: DataFrame, metric: str = "pr_auc") -> DataFrame:
    """Best model = max metric (missing counts as 0), newest first on ties."""
    return registry.orderBy(F.coalesce(F.col("metrics")[metric], F.lit(0.0)).desc(),
                            F.col("created_at").desc()).limit(1)


def registry_rows_from_metrics(table: DataFrame, name_col: str = "model",
                               created_base: float = 0.0,
                               metric_cols=("accuracy", "precision", "recall", "f1",
                                            "roc_auc", "pr_auc", "brier")) -> DataFrame:
    """Registry rows for a metric table (one version per model, in name order).

    The table has one row per model, so the ordering window is bounded.
    """
    kv = []
    for m in metric_cols:
        kv += [F.lit(m), F.col(m).cast("double")]
    pos = F.row_number().over(Window.orderBy(F.col(name_col)))
    return table.select(
        F.col(name_col).alias("name"),
        F.concat(F.lit("v"), pos.cast("string")).alias("version"),
        (F.lit(float(created_base)) + pos.cast("double")).alias("created_at"),
        F.map_filter(F.create_map(*kv), lambda k, v: v.isNotNull()).alias("metrics"),
        F.create_map().cast("map<string,string>").alias("params"),
        F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("string").alias("model_path"))


# ------------------------------------------------------------------ S8

def log_run(spark: SparkSession, path: str, experiment: str, metrics: dict | None = None,
            params: dict | None = None, tags: dict | None = None) -> str:
    """Append a run's params/metrics/tags to a long Parquet run log."""
    run_id = uuid.uuid4().hex
    ts = time.time()
    rows = []
    for kind, items in (("param", params), ("metric", metrics), ("tag", tags)):
        for k, v in (items or {}).items():
            rows.append((run_id, experiment, kind, str(k), str(v), ts))
    if rows:
        spark.createDataFrame(rows, RUN_LOG_SCHEMA).write.mode("append").parquet(path)
    return run_id

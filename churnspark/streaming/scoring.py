"""Structured Streaming scoring (V4 on a stream).

A fitted model is stateless per row, so the same ``PipelineModel`` scores a
``readStream`` source; ``foreachBatch`` writes each micro-batch to its own folder
``batch_id=<id>`` of the Parquet sink and overwrites it when the batch is retried,
so no row is written twice.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from churnspark import schema as S
from churnspark.plans import learners as L
from churnspark.sources.io import typed_customers


def score_stream(spark: SparkSession, model: PipelineModel, source_dir: str,
                 sink_dir: str, checkpoint_dir: str, threshold: float = S.DEFAULT_THRESHOLD,
                 schema=S.RAW_SCHEMA, fmt: str = "parquet", key: str = S.KEY, bounds=None):
    """Start a streaming query scoring every new file under ``source_dir``.

    A margin-only model (SVC) needs ``bounds``, the smallest and largest margin on
    its training rows: scores must not depend on what else is in a micro-batch.
    CSV columns are named by the header of the files that are there at the start (by
    ``schema`` if there is none); a file with another header stops the query."""
    if bounds is None and not hasattr(model.stages[-1], "setProbabilityCol"):
        raise ValueError("a margin-only model is scaled by its training margins: give bounds")
    if fmt == "csv":
        empty = spark.read.format("binaryFile").load(source_dir).select("path").isEmpty()
        names = schema.fieldNames() if empty else spark.read.option("header", True).csv(source_dir).columns
        text = T.StructType([T.StructField(n, T.StringType()) for n in names])
        # the header is compared with these names, and columns are not taken by their place
        src = spark.readStream.schema(text).option("header", True).option("enforceSchema", False).csv(source_dir)
    else:
        src = spark.readStream.schema(schema).format(fmt).load(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if fmt == "csv":
            batch = typed_customers(batch, schema)
        out = L.predict_batch(model, batch, threshold, key, bounds)
        out.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    return (src.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())

"""Session helpers: local sessions for tests/bench, checkpoint folder policy."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "churnspark", driver_memory: str = "16g") -> SparkSession:
    """A local session for tests and the benchmark (never used by the library)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``; we only pick our own
    (a fresh temp folder) when the session leaves it unset, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not str(sc.master).startswith("local") or str(sc.master).startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="churnspark-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def default_buckets(spark: SparkSession, factor: int = 4, floor: int = 8,
                    cap: int = 65536) -> int:
    """Bucket count for two-level ranks/cumulative sums: a few per core."""
    try:
        par = int(spark.sparkContext.defaultParallelism)
    except Exception:  # pragma: no cover - Connect sessions have no SparkContext
        par = int(os.cpu_count() or 8)
    return max(floor, min(cap, par * factor))


def materialize(df: DataFrame) -> DataFrame:
    """Persist (memory, spilling to disk) and compute once.

    Used before several passes over a frame whose plan is expensive to plan or
    recompute (model scores, out-of-fold unions); lost blocks are recomputed
    from lineage.  Callers ``unpersist`` when done.
    """
    from pyspark import StorageLevel
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out

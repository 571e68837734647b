"""Exact global ranks and running sums without a one-task window.

An ordered window with no (or a tiny) partition key runs in a single task.
Both helpers here split the order into buckets that are monotone in the
order key, count per (group, bucket) - a table bounded by the bucket count,
so it is safe to broadcast - turn those counts into offsets with a window over
that small table, and finish with a window partitioned by (group, bucket).
The result equals the plain window exactly, with the work spread over all
buckets.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnspark.session import cut_lineage, default_buckets


def _join_offsets(df: DataFrame, offsets: DataFrame, on) -> DataFrame:
    """Broadcast join that treats NULL keys as equal, so no row is lost."""
    other = offsets.withColumnsRenamed({c: f"_o_{c}" for c in on})
    cond = None
    for c in on:
        eq = F.col(c).eqNullSafe(F.col(f"_o_{c}"))
        cond = eq if cond is None else cond & eq
    return df.join(F.broadcast(other), cond, "inner")


def hash_key(key: Column, seed: int | str) -> Column:
    """md5 of 'seed:key' as lowercase hex - identical in Spark SQL and DuckDB."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hashed_rank(df: DataFrame, key: str, seed: int | str, partition_cols=(),
                out: str = "rank", prefix_hex: int = 4) -> DataFrame:
    """1-based ``row_number`` within ``partition_cols`` ordered by (md5(seed:key), key).

    Buckets are the first ``prefix_hex`` hex digits of the hash (16**prefix_hex
    of them), which are monotone in the hash order.  The per-bucket count table
    holds at most |groups| * 16**prefix_hex rows.  A NULL key or group is a value
    like any other: its rows are ranked too (NULL keys first).
    """
    pc = list(partition_cols)
    h = hash_key(F.col(key), seed)
    d = df.withColumn("_h", h).withColumn(
        "_b", F.conv(F.substring("_h", 1, prefix_hex), 16, 10).cast("int"))
    counts = d.groupBy(*pc, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*pc).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*pc, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    joined = _join_offsets(d, offsets, [*pc, "_b"])
    w2 = Window.partitionBy(*pc, "_b").orderBy("_h", key)
    return joined.withColumn(out, (F.row_number().over(w2) + F.col("_off")).cast("long")) \
        .select(*df.columns, out)


def value_buckets(df: DataFrame, order_col: str, n_buckets: int | None = None,
                  rel_error: float = 1e-4) -> Bucketizer | None:
    """A Bucketizer whose splits are approximate quantiles of ``order_col``.

    The splits (at most ``n_buckets`` + 1 numbers) come from one aggregate.
    Returns None when a single bucket suffices.
    """
    n_buckets = n_buckets or default_buckets(df.sparkSession)
    if n_buckets <= 1:
        return None
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = df.approxQuantile(order_col, probs, rel_error)
    cuts = sorted({float(q) for q in qs if q is not None})
    if not cuts:
        return None
    splits = [float("-inf")] + cuts + [float("inf")]
    return Bucketizer(splits=splits, inputCol=order_col, outputCol="_b",
                      handleInvalid="keep")


def running_sums(df: DataFrame, order_col: str, sum_cols, partition_cols=(),
                 descending: bool = True, n_buckets: int | None = None,
                 suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``sum_cols`` over ``order_col`` within groups.

    ``df`` should already hold one row per distinct (group, order value) - e.g.
    a ``groupBy(score)`` - so ties never split across rows.  Adds
    ``<c><suffix>`` for every sum column.
    """
    pc = list(partition_cols)
    sums = list(sum_cols)
    bz = value_buckets(df, order_col, n_buckets)
    d = bz.transform(df) if bz is not None else df.withColumn("_b", F.lit(0.0))
    d = d.withColumn("_b", F.col("_b").cast("int"))
    bt = d.groupBy(*pc, "_b").agg(*[F.sum(c).alias(f"_bt_{c}") for c in sums])
    border = F.col("_b").desc() if descending else F.col("_b").asc()
    wb = Window.partitionBy(*pc).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    offsets = bt.select(*pc, "_b", *[
        F.coalesce(F.sum(f"_bt_{c}").over(wb), F.lit(0)).alias(f"_off_{c}") for c in sums
    ])
    joined = _join_offsets(d, offsets, [*pc, "_b"])
    oorder = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w = Window.partitionBy(*pc, "_b").orderBy(oorder) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumns({
        f"{c}{suffix}": F.sum(c).over(w) + F.col(f"_off_{c}") for c in sums
    }).select(*df.columns, *[f"{c}{suffix}" for c in sums])


def ranged_sums(df: DataFrame, order_col: str, sum_cols, partition_cols=(),
                descending: bool = True, n_buckets: int | None = None) -> DataFrame:
    """``<c>_cum`` (inclusive running sum) and ``<c>_all`` (the group's total) of every sum column.

    ``df`` is computed once: its rows are dealt by range of ``order_col``, written with
    the number of their range, and everything else reads that.  As in
    :func:`running_sums`, ``df`` holds one row per (group, order value).  NULL order
    values come last in descending order, first in ascending.
    """
    pc, sums = list(partition_cols), list(sum_cols)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    n = n_buckets or default_buckets(df.sparkSession)
    # later ranges have greater numbers, whatever the direction
    d = cut_lineage(df.repartitionByRange(n, order).withColumn("_b", F.spark_partition_id()))
    before = Window.partitionBy(*pc).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*pc)
    totals = d.groupBy(*pc, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = totals.select(*pc, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums],
                            *[F.sum(f"_t_{c}").over(whole).alias(f"{c}_all") for c in sums])
    upto = Window.partitionBy(*pc, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row for each group and range: bounded like the offsets above
    return _join_offsets(d, offsets, [*pc, "_b"]).withColumns({f"{c}_cum": F.sum(c).over(upto) + F.col(f"_off_{c}") for c in sums}) \
        .select(*df.columns, *[f"{c}_cum" for c in sums], *[f"{c}_all" for c in sums])

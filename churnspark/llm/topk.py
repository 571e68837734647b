"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query of a block, in dense products.  The
k-th best score of each query is located by refining histograms: tasks count
their scores by bin, the counts are summed, the bin with the k-th score is divided
again until it holds one score.  Then rows above it are emitted, and as many of
those that tie as are wanted, smallest id first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnspark.llm.common import settle

#: Bins of one histogram, and queries of one block.
BINS, BLOCK = 2048, 2048


def matrices(batch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(scale * vectors)) of an Arrow batch, for each length of vector; invalid vectors are left out."""
    import pyarrow as pa
    import pyarrow.compute as pc
    column = batch.column(1)
    batch = batch.filter(pc.and_(pc.is_valid(column), pc.is_valid(batch.column(0))))
    if not batch.num_rows:
        return
    ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes nan
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        block = values[(starts[rows][:, None] + np.arange(length)[None, :])] if length else np.zeros((len(rows), 0))
        good = np.isfinite(block).all(axis=1)
        yield ids[rows[good]], np.floor(scale * block[good])


def scorer(queries: np.ndarray, largest: float):
    """Integer inner products: by floating point where that is exact, else in 64-bit integers."""
    dims = queries.shape[1]
    if dims * float(np.abs(queries).max(initial=0)) * largest < 2.0**52:
        return lambda block: (block @ queries.T).astype(np.int64)
    whole = queries.astype(np.int64).T
    return lambda block: block.astype(np.int64) @ whole


def search_block(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, scale: float, largest: float) -> DataFrame:
    """The k best of each query of a block; the queries all have the same length."""
    import pyarrow as pa
    spark = vectors.sparkSession
    dims, n = queries.shape[1], len(ids)
    shared = spark.sparkContext.broadcast((ids, queries))  # BLOCK vectors at most
    reach = np.abs(queries).sum(axis=1).astype(np.int64) * int(largest)
    low, width = -reach, np.maximum(1, -(-(2 * reach + 1) // BINS))
    high = reach + 1
    above, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    every = np.zeros(n, bool)  # fewer candidates than k: take all

    def scored(batches: Iterator):
        q_ids, q = shared.value
        score = scorer(q, largest)
        for batch in batches:
            for c_ids, block in matrices(batch, scale):
                if block.shape[1] == dims:
                    for at in range(0, len(c_ids), 1024):
                        part = c_ids[at : at + 1024]
                        yield part, score(block[at : at + 1024]), part[:, None] == q_ids[None, :]

    def histogram(low, high, width, open_):
        def run(batches: Iterator):
            counts = np.zeros((n, BINS), np.int64)
            for _, scores, own in scored(batches):
                bins = (scores - low[None, :]) // width[None, :]
                ok = (scores >= low[None, :]) & (scores < high[None, :]) & ~own & open_[None, :]
                at = np.nonzero(ok)
                counts += np.bincount(at[1] * BINS + bins[at], minlength=n * BINS).reshape(n, BINS)
            # below the bin where this task alone has k scores nothing can be the k-th
            from_top = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
            needed = (from_top - counts) < k
            q, b = np.nonzero((counts > 0) & needed)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[q, b], pa.int64())], ["q", "bin", "n"])
        return run

    while open_.any():
        rows = vectors.mapInArrow(histogram(low.copy(), high.copy(), width.copy(), open_.copy()), "q int, bin int, n long")
        summed = rows.groupBy("q", "bin").agg(F.sum("n").alias("n"))
        running = Window.partitionBy("q").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        crossing = (summed.join(F.broadcast(spark.createDataFrame(list(zip(range(n), (k - above).tolist(), strict=True)), "q int, want long")), "q")
                    .withColumn("upto", F.sum("n").over(running)).filter(F.col("upto") >= F.col("want"))
                    .groupBy("q").agg(F.max(F.struct("bin", "n", "upto")).alias("b")))
        found = {r["q"]: r["b"] for r in crossing.collect()}  # a row for each query of the block
        for q in np.flatnonzero(open_):
            if q not in found:
                every[q], open_[q] = True, False
                continue
            b, m, upto = found[q]
            above[q] += upto - m
            low[q] += b * width[q]
            high[q] = min(high[q], low[q] + width[q])
            open_[q] = width[q] > 1
            width[q] = max(1, -(-width[q] // BINS))
    kth = np.where(every, np.iinfo(np.int64).min, low)
    ties = np.where(every, 0, k - above)

    def select(batches: Iterator):
        q_ids, _ = shared.value
        held: list[list] = [[] for _ in range(n)]  # smallest ids of those that tie, `ties` of them at most

        def out(q, ids, scores):
            return pa.RecordBatch.from_arrays([pa.array(q_ids[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

        for c_ids, scores, own in scored(batches):
            r, q = np.nonzero((scores > kth[None, :]) & ~own)
            if len(r):
                yield out(q, c_ids[r], scores[r, q])
            r, q = np.nonzero((scores == kth[None, :]) & ~own & ~every[None, :])
            for j in np.unique(q):
                held[j] = sorted([*held[j], *c_ids[r[q == j]].tolist()])[: ties[j]]
        q = np.array([j for j in range(n) for _ in held[j]], int)
        if len(q):
            yield out(q, [i for h in held for i in h], kth[q])

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (vectors.mapInArrow(select, "query_id long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def exact_top_k(table: DataFrame, queries: DataFrame, k: int = 10, *, vec_id: str = "vec_id", vector: str = "embedding",
                scale: float = 1024.0) -> DataFrame:
    """The ``k`` rows of ``table`` with the highest inner products for each row of ``queries``.

    Components are floor(scale * x).  A row is no candidate of a query with its own
    id; ties go to the smaller id.  Vectors that are null or hold a null or
    non-finite component take no part, nor do null ids; vectors of another length
    than the query's are not scored with it.  A query id that repeats is asked once,
    with one of its rows; candidates that repeat an id count each.  Blocks of about
    BLOCK queries run one after the other.  Returns query_id, rank, vec_id, score; no
    rows for an empty table.
    """
    spark = table.sparkSession
    vectors = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = settle(queries.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
                   .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).dropDuplicates(["vec_id"]))
    size = F.floor(F.lit(scale) * F.array_max(F.transform("vector", F.abs)))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    largest = float(vectors.filter(finite).agg(F.max(size)).first()[0] or 0) + 1  # floor of a negative is one more in size
    blocks = -(-asked.count() // BLOCK)
    parts = []
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        rows = mine.collect()  # a block of about BLOCK vectors
        by_length: dict[int, list] = {}
        for r in rows:
            v = r["vector"]
            if all(x is not None and np.isfinite(x) for x in v):
                by_length.setdefault(len(v), []).append((r["vec_id"], np.floor(scale * np.asarray(v, float))))
        parts += [search_block(vectors, np.array([i for i, _ in g], np.int64), np.stack([v for _, v in g]), k, scale, largest) for g in by_length.values()]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, parts)

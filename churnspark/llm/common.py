"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnspark.session import cut_lineage, ensure_checkpoint_dir

#: Keys that hold at least 1 / HEAVY_PARTS of all rows count as heavy, so there are at most HEAVY_PARTS of them.
HEAVY_PARTS = 4096
#: `bytes.split()` and this set agree with the class [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"
#: Java pattern of the white space between words.
SPACE_RE = "[\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared checkpoint folder; survives lost executors."""
    return cut_lineage(df)


def settle_snug(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """:func:`settle`, then read by as many tasks as ``rows`` each take: a small table that comes in many partitions is not shuffled from all of them again."""
    df = settle(df)
    return df.coalesce(max(1, -(-df.count() // rows)))


def own_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def texts(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgets all when it holds ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def heavy_light_join(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join on ``key`` where ``right`` has one row per key and ``count`` is the key's number of rows in ``left``.

    Keys with 1 / HEAVY_PARTS of the rows or more are broadcast (there cannot be
    more than HEAVY_PARTS); every other key is shuffled and is small.  ``right``
    should be settled, as it is read several times.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    is_heavy = F.col(count) * F.lit(HEAVY_PARTS) >= F.lit(total)
    heavy, light = right.filter(is_heavy), right.filter(~is_heavy)
    hot = left.join(F.broadcast(heavy), key)
    cold = left.join(F.broadcast(heavy), key, "left_anti").join(light, key)
    return hot.unionByName(cold)


def row_key(*columns: Column) -> Column:
    """A 64-bit name of a row's contents."""
    return F.xxhash64(*columns)


def without(df: DataFrame, key: str, gone: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of ``df`` whose 64-bit ``key`` is not in ``gone``; a null key stays.

    ``gone`` is settled and counted: up to ``most_broadcast`` keys go to every task, so
    that ``df`` is only filtered; more are joined by a shuffle.
    """
    gone = settle(gone.select(key).distinct())
    return df.join(F.broadcast(gone) if gone.count() <= most_broadcast else gone, key, "left_anti")


def rank_within(df: DataFrame, key: str, bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Add the row's 0-based rank among the rows of its ``key``, by (bucket, order).

    Counts by (key, bucket) give each bucket's offset, so that a window only ever
    holds one bucket of one key: a key with a third of all rows is spread over all
    its buckets.  ``df`` should be settled, as it is read twice.
    """
    b, n, off = own_name(df, "rank_bucket"), own_name(df, "rank_n"), own_name(df, "rank_off")
    rows = df.withColumn(b, bucket)
    before = Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(key, b).agg(F.count(F.lit(1)).alias(n))
               .withColumn(off, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n))
    inside = rows.withColumn(out, F.row_number().over(Window.partitionBy(key, b).orderBy(*order)).cast("long") - 1)
    return (inside.join(offsets.hint("shuffle_merge"), [key, b])
            .withColumn(out, F.col(out) + F.col(off)).drop(b, off))


class BestOf:
    """The ``k`` best rows of each of ``n`` keys, highest score first and then smallest id, out of as many rows as come.

    ``bound`` is, by key, the score below which a row cannot be one of them.
    """

    def __init__(self, n: int, k: int, bound):
        self.k, self.bound = k, np.broadcast_to(np.asarray(bound, np.int64), n).copy()
        self.rows = [np.zeros(0, np.int64)] * 3
        self.parts, self.size, self.least = [], 0, 1 << 16

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((key, score, ids))
        self.size += len(key)
        if self.size > max(self.least, 2 * len(self.rows[0])):
            self.trim()

    def trim(self) -> list[np.ndarray]:
        """key, score and id of the best so far, in order."""
        key, score, ids = (np.concatenate(z) for z in zip(self.rows, *self.parts, strict=True))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        rank = np.arange(len(key)) - np.repeat(begins, np.diff([*begins, len(key)]))
        full = rank == self.k - 1
        self.bound[key[full]] = np.maximum(self.bound[key[full]], score[full])
        keep = rank < self.k
        self.rows, self.parts, self.size = [key[keep], score[keep], ids[keep]], [], 0
        return self.rows


def best_of_tasks(rows: DataFrame, key: list[str], k: int, score: str, row_id: str, out: str = "rank") -> DataFrame:
    """Of each key's rows, ``k`` at most from each task, the ``k`` best and their rank: by groups of tasks first, so that a key is never whole in one place."""
    part = own_name(rows, "task_group")
    order = [F.col(score).desc(), F.col(row_id)]
    rows = rows.withColumn(part, F.pmod(F.spark_partition_id(), F.lit(64)))
    first = rows.withColumn(out, F.row_number().over(Window.partitionBy(*key, part).orderBy(*order))).filter(F.col(out) <= k)
    return first.drop(part).withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(out) <= k)


def one_by_one(spark: SparkSession, frames: Iterable[DataFrame], several: bool) -> DataFrame | None:
    """The union of ``frames``: if there are several, each is written to the shared folder before the next one is made."""
    folder = f"{ensure_checkpoint_dir(spark)}/blocks-{uuid.uuid4().hex}"
    made = False
    for frame in frames:
        if not several:
            return frame
        frame.write.mode("append").parquet(folder)
        made = True
    return spark.read.parquet(folder) if made else None


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote, wherever the cluster keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

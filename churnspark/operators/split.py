"""Repeatable splits, folds, samples and class weights.

Row order inside each class comes from md5('<seed>:<key>') - stable under any
repartitioning or input order and identical in other SQL engines.  A split only
needs to know where the quota ends: the hash of each class's last test row is
found by counts, and the wide rows are compared with it where they are; folds by
range need k - 1 such hashes a class.  Folds by rank take ranks from the two-level
helper, never from one window per class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.operators.rank import hash_key, hashed_rank


def class_counts(df: DataFrame, label: str = "label") -> dict:
    """Rows per class (one tiny aggregate; the class domain is bounded)."""
    counts = {r[label]: int(r["n"]) for r in
              df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if None in counts:
        raise ValueError(f"{counts[None]} rows have a NULL {label!r}; a class is needed for every row")
    return counts


def test_quotas(counts: dict, test_frac: float) -> dict:
    """Test rows per class: floor(n_c * n_test / n), leftovers to the largest
    remainders (ties -> smaller label); n_test = ceil(n * test_frac)."""
    n = sum(counts.values())
    if n == 0:
        return {}
    n_test = int(math.ceil(test_frac * n))
    exact = {c: counts[c] * n_test / n for c in counts}
    quota = {c: int(math.floor(v)) for c, v in exact.items()}
    left = n_test - sum(quota.values())
    for c in sorted(counts, key=lambda c: (-(exact[c] - quota[c]), c))[:left]:
        quota[c] += 1
    return quota


def _lookup(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        cond = col == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def _cutoffs(df: DataFrame, key: str, seed: int, quota: dict, label: str | None) -> dict:
    """Per class the (hash, key) of its ``quota``-th row in hash order; None for a quota of 0.

    Counts by hash prefix find the prefix that holds the row; only that prefix's
    rows (1 in 65536 of the class) are put in order.
    """
    wanted = {c: q for c, q in quota.items() if q > 0}
    if not wanted:
        return {}
    group = F.col(label) if label else F.lit(0)
    q = _lookup(F.col("_c"), wanted, None)
    rows = df.select(group.alias("_c"), hash_key(F.col(key), seed).alias("_h"), F.col(key).cast("string").alias("_k")) \
        .withColumns({"_p": F.substring("_h", 1, 4), "_q": q}).where(F.col("_q").isNotNull())
    upto = Window.partitionBy("_c").orderBy(F.col("_p").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.groupBy("_c", "_q", "_p").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_upto", F.sum("_n").over(upto)).where(F.col("_upto") >= F.col("_q")) \
        .groupBy("_c").agg(F.min(F.struct("_upto", "_n", F.col("_p").alias("p"))).alias("_e")) \
        .select(F.col("_c").alias("_ec"), F.col("_e.p").alias("_ep"), (F.col("_e._upto") - F.col("_e._n")).alias("_before"))
    inside = Window.partitionBy("_c").orderBy(F.col("_h").asc_nulls_first(), F.col("_k").asc_nulls_first())
    last = rows.join(F.broadcast(edge), (F.col("_c") == F.col("_ec")) & F.col("_p").eqNullSafe(F.col("_ep"))) \
        .withColumn("_r", F.row_number().over(inside) + F.col("_before")).where(F.col("_r") == F.col("_q"))
    return {r["_c"]: (r["_h"], r["_k"]) for r in last.select("_c", "_h", "_k").collect()}   # a row per class


def _up_to(df: DataFrame, key: str, seed: int, quota: dict, label: str | None) -> Column:
    """True for the first ``quota`` rows of each class in hash order: a comparison with literals."""
    h, k = hash_key(F.col(key), seed), F.col(key).cast("string")
    out = F.lit(False)
    for c, (hc, kc) in _cutoffs(df, key, seed, quota, label).items():
        if hc is None:             # the last row has a NULL key: only such rows come before it
            before = h.isNull()
        else:
            before = h.isNull() | (h < F.lit(hc)) | ((h == F.lit(hc)) & (k <= F.lit(kc)))
        mine = before if label is None else (F.col(label) == F.lit(c)) & before
        out = out | mine
    return out


def stratified_split(df: DataFrame, label: str = "label", key: str = S.KEY,
                     test_frac: float = 0.2, seed: int = S.SEED,
                     out: str = "split") -> DataFrame:
    """Adds ``split`` = 'test' for the first quota rows of each class, else 'train'."""
    quota = test_quotas(class_counts(df, label), test_frac)
    return df.withColumn(out, F.when(_up_to(df, key, seed, quota, label), "test").otherwise("train"))


def plain_split(df: DataFrame, key: str = S.KEY, test_frac: float = 0.2,
                seed: int = S.SEED, out: str = "split") -> DataFrame:
    """Unstratified: the first ceil(n * test_frac) rows in hash order are test."""
    n = df.count()
    n_test = int(math.ceil(test_frac * n))
    return df.withColumn(out, F.when(_up_to(df, key, seed, {0: n_test}, None), "test").otherwise("train"))


def stratified_folds(df: DataFrame, k: int = 5, label: str = "label", key: str = S.KEY,
                     seed: int = S.SEED, out: str = "fold") -> DataFrame:
    """fold = (rank within class - 1) mod k, an int column usable as ``foldCol``.

    Rows with a NULL label form a class of their own: none is lost."""
    ranked = hashed_rank(df, key, seed, [label], out="_rank")
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def _range_ends(df: DataFrame, key: str, seed: int, ends: dict, label: str) -> dict:
    """Per class the (hash, key) of its rows at the ranks ``ends``, in order of rank.

    As in :func:`_cutoffs`, only the prefixes that hold such a row are put in order."""
    if not ends:
        return {}
    wanted = None
    for c, ranks in ends.items():
        mine, ranks = F.col("_c").eqNullSafe(F.lit(c)), F.array(*[F.lit(r).cast("long") for r in ranks])
        wanted = F.when(mine, ranks) if wanted is None else wanted.when(mine, ranks)
    rows = df.select(F.col(label).alias("_c"), hash_key(F.col(key), seed).alias("_h"), F.col(key).cast("string").alias("_k")) \
        .withColumn("_p", F.substring("_h", 1, 4))
    upto = Window.partitionBy("_c").orderBy(F.col("_p").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = rows.groupBy("_c", "_p").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumns({"_upto": F.sum("_n").over(upto), "_ranks": wanted}) \
        .withColumn("_ranks", F.filter("_ranks", lambda r: (r > F.col("_upto") - F.col("_n")) & (r <= F.col("_upto")))) \
        .where(F.size("_ranks") > 0) \
        .select(F.col("_c").alias("_ec"), F.col("_p").alias("_ep"), "_ranks", (F.col("_upto") - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_c", "_p").orderBy(F.col("_h").asc_nulls_first(), F.col("_k").asc_nulls_first())
    # a row for each class and end at most, so the edges are small
    found = rows.join(F.broadcast(edges), F.col("_c").eqNullSafe(F.col("_ec")) & F.col("_p").eqNullSafe(F.col("_ep"))) \
        .withColumn("_r", F.row_number().over(inside) + F.col("_before")).where(F.array_contains("_ranks", F.col("_r")))
    out = {c: [] for c in ends}
    for r in sorted(found.select("_c", "_h", "_k", "_r").collect(), key=lambda r: r["_r"]):   # a row for each end
        out[r["_c"]].append((r["_h"], r["_k"]))
    return out


def range_folds(df: DataFrame, k: int = 5, label: str = "label", key: str = S.KEY,
                seed: int = S.SEED, out: str = "fold") -> DataFrame:
    """X3 without moving rows: each class in hash order is cut into ``k`` runs of as near
    equal length as can be, the longer ones first, and a run is a fold.

    The folds are as large as those of :func:`stratified_folds`.  Only the hashes at the
    ends of the runs are looked for, and the wide rows are compared with them where
    they are.  Rows with a NULL label form a class of their own.  Rows of a class that
    repeat a key share a fold, that of the run in which the first of them falls.
    """
    ends = {}
    for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect():    # a row per class
        small, more = divmod(int(r["n"]), k)
        upto = [f * small + min(f, more) for f in range(1, k)]
        ends[r[label]] = sorted({int(u) for u in upto if u > 0})
    h, key_text = hash_key(F.col(key), seed), F.col(key).cast("string")
    fold = F.lit(0)
    for c, cuts in _range_ends(df, key, seed, {c: e or [0] for c, e in ends.items()}, label).items():
        past = [F.lit(0)]
        for hc, kc in cuts:
            if hc is None:         # the run ends among the rows with a NULL key
                past.append(h.isNotNull().cast("int"))
            else:
                past.append((h.isNotNull() & ((h > F.lit(hc)) | ((h == F.lit(hc)) & (key_text > F.lit(kc))))).cast("int"))
        while len(past) > 1:       # in pairs: a sum of many terms must not nest deeply
            past = [x + y for x, y in zip(past[::2], past[1::2])] + past[len(past) // 2 * 2:]
        fold = F.when(F.col(label).eqNullSafe(F.lit(c)), past[0]).otherwise(fold)
    return df.withColumn(out, fold.cast("int"))


def capped_sample(df: DataFrame, n: int = 1000, key: str = S.KEY, seed: int = S.SEED) -> DataFrame:
    """A repeatable sample of at most ``n`` rows (top-n by hash: no full sort)."""
    return df.orderBy(hash_key(F.col(key), seed), F.col(key)).limit(n)


def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """X5: 'balanced' weights n / (n_classes * n_c) as a row column (for ``weightCol``)."""
    counts = class_counts(df, label)
    n, k = sum(counts.values()), len(counts)
    w = {c: n / (k * nc) for c, nc in counts.items()}
    return df.withColumn(out, _lookup(F.col(label), w, None).cast("double"))


def stratified_sample(df: DataFrame, fraction: float, label: str = "label",
                      key: str = S.KEY, seed: int = S.SEED) -> DataFrame:
    """Stratified subsample with the X1 quotas (deterministic)."""
    return stratified_split(df, label, key, fraction, seed, out="_part") \
        .where(F.col("_part") == "test").drop("_part")

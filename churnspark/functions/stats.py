"""Fit-time statistics computed as distributed aggregates.

* :func:`exact_quantiles` - exact, linearly interpolated quantiles by
  distributed selection: an ``approx_percentile`` pass brackets every target
  rank, one count pass checks the brackets, and only the rows inside a bracket
  (a constant bound, independent of table size) reach the driver.  Brackets
  that are still too wide are narrowed again on the bracket rows alone.  The
  interpolation is ``lo + (hi - lo) * frac`` at ``h = (n - 1) * p`` — the
  continuous-quantile definition used by numpy/pandas.
* :func:`modes` - most frequent value per column (ties -> smallest value)
  from one grouped count over all columns, never a value map per task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_APPROX_ACCURACY = 10000
_MAX_CANDIDATES = 20000
_WIDTHS = 4            # nested bracket widths 2/acc * 4**j


def _valid(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def exact_quantiles(df: DataFrame, col: str, probs, *,
                    accuracy: int = _APPROX_ACCURACY,
                    max_candidates: int = _MAX_CANDIDATES) -> list:
    """Exact ``quantile_cont`` values of ``col`` (NULL/NaN ignored).

    Returns ``None`` for every prob when the column has no valid value.  The
    one-column input is persisted for the few passes and released at the end.
    """
    from pyspark import StorageLevel
    probs = [float(p) for p in probs]
    x = F.col(col).cast("double")
    base = df.select(x.alias("_x")).where(_valid(F.col("_x"))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # pass 1: size, range and nested approximate brackets around every prob
        widths = [2.0 / accuracy * (4 ** j) for j in range(_WIDTHS)]
        qs = []
        for p in probs:
            for w in widths:
                qs.extend([max(0.0, p - w), min(1.0, p + w)])
        first = base.agg(
            F.count(F.lit(1)).alias("n"), F.min("_x").alias("mn"), F.max("_x").alias("mx"),
            F.percentile_approx("_x", qs, accuracy).alias("q"),
        ).first()
        n = int(first["n"])
        if n == 0:
            return [None] * len(probs)
        targets = []
        for p in probs:
            h = (n - 1) * p
            k = int(math.floor(h))
            k1 = min(int(math.ceil(h)), n - 1)
            targets.append((k, k1, h - k))
        hint = {}
        for i, (k, k1, _) in enumerate(targets):
            cands = [(first["q"][2 * (i * _WIDTHS + j)], first["q"][2 * (i * _WIDTHS + j) + 1])
                     for j in range(_WIDTHS)]
            hint[k] = hint.get(k, []) + cands
            hint[k1] = hint.get(k1, []) + cands
        ranks = sorted(hint)
        values = _select_ranks(base, ranks, n, first["mn"], first["mx"], 0, 2.0 / accuracy,
                               accuracy, max_candidates, hint=hint)
    finally:
        base.unpersist()
    out = []
    for k, k1, frac in targets:
        lo, hi = values[k], values[k1]
        out.append(lo if k1 == k else lo + (hi - lo) * frac)
    return out


def _select_ranks(base: DataFrame, ranks, n, mn, mx, offset, eps, accuracy,
                  max_candidates, depth: int = 0, hint: dict | None = None) -> dict:
    """Values at 0-based global ``ranks``; ``base`` holds ranks [offset, offset+n).

    ``hint`` maps a rank to candidate (lo, hi) brackets, narrowest first.
    """
    if hint is None:
        # bracket each wanted rank with approximate quantiles of this subset
        qs = []
        for r in ranks:
            q = (r - offset) / max(n - 1, 1)
            for j in range(_WIDTHS):
                w = eps * (4 ** j)
                qs.extend([max(0.0, q - w), min(1.0, q + w)])
        approx = base.agg(F.percentile_approx("_x", qs, accuracy).alias("q")).first()["q"]
        hint = {r: [(approx[2 * (i * _WIDTHS + j)], approx[2 * (i * _WIDTHS + j) + 1])
                    for j in range(_WIDTHS)] for i, r in enumerate(ranks)}
    # one pass: rows below lo and rows up to hi, for every candidate bracket
    brackets = sorted({b for r in ranks for b in hint[r]})
    aggs = []
    for i, (lo, hi) in enumerate(brackets):
        aggs.append(F.count_if(F.col("_x") < F.lit(lo)).alias(f"lt{i}"))
        aggs.append(F.count_if(F.col("_x") <= F.lit(hi)).alias(f"le{i}"))
    cnt = base.agg(*aggs).first()
    counts = {b: (offset + cnt[f"lt{i}"], offset + cnt[f"le{i}"]) for i, b in enumerate(brackets)}
    small, large = [], []
    for r in ranks:
        valid = [(counts[b][1] - counts[b][0], b) for b in hint[r]
                 if counts[b][0] <= r < counts[b][1]]
        if valid:
            _, (lo, hi) = min(valid)
            lt, le = counts[(lo, hi)]
        else:                           # approximation missed: widen to the subset
            lo, hi, lt, le = mn, mx, offset, offset + n
        (small if le - lt <= max_candidates else large).append((r, lo, hi, lt, le))
    out = {}
    if small:
        # one job fetches the rows of all narrow brackets (bounded by max_candidates each)
        cond = None
        for _, lo, hi, _, _ in small:
            c = (F.col("_x") >= F.lit(lo)) & (F.col("_x") <= F.lit(hi))
            cond = c if cond is None else (cond | c)
        vals = sorted(row["_x"] for row in base.where(cond).collect())
        for r, lo, hi, lt, _ in small:
            inside = [v for v in vals if lo <= v <= hi]
            out[r] = inside[r - lt]
    for r, lo, hi, lt, le in large:
        sub = base.where((F.col("_x") >= F.lit(lo)) & (F.col("_x") <= F.lit(hi)))
        if le - lt >= n and depth > 0 or depth > 8:
            # no progress (massive ties): bisect the value range with counts only
            out[r] = _bisect_rank(sub, r - lt, lo, hi)
            continue
        out.update(_select_ranks(sub, [r], le - lt, lo, hi, lt, eps, accuracy,
                                 max_candidates, depth + 1))
    return out


def _bisect_rank(sub: DataFrame, k: int, lo: float, hi: float) -> float:
    """Value of 0-based rank ``k`` among ``sub``'s ``_x`` values in [lo, hi].

    Each step counts the rows at or below the midpoint and keeps the half that
    holds rank ``k``; once the range holds one distinct value it is the answer.
    Only counts reach the driver, whatever the number of tied rows.
    """
    below = 0                        # rows of sub strictly below lo
    for _ in range(200):
        if lo == hi:
            return lo
        mid = lo + (hi - lo) / 2.0
        if mid <= lo or mid >= hi:   # adjacent doubles: the answer is one of the two
            c = sub.where(F.col("_x") <= F.lit(lo)).count()
            return lo if k < c else hi
        row = sub.agg(
            F.count_if(F.col("_x") <= F.lit(mid)).alias("le"),
            F.max(F.when(F.col("_x") <= F.lit(mid), F.col("_x"))).alias("a"),
            F.min(F.when(F.col("_x") > F.lit(mid), F.col("_x"))).alias("b"),
        ).first()
        if k < row["le"]:
            hi = row["a"]
        else:
            below = row["le"]
            lo = row["b"]
            sub = sub.where(F.col("_x") > F.lit(mid))
            k -= below
    return lo


def exact_median(df: DataFrame, col: str) -> float | None:
    return exact_quantiles(df, col, [0.5])[0]


def column_means(df: DataFrame, cols) -> dict:
    """Mean of each column (NULL/NaN ignored) in one aggregate."""
    if not cols:
        return {}
    row = df.agg(*[
        F.avg(F.when(_valid(F.col(c).cast("double")), F.col(c).cast("double"))).alias(c)
        for c in cols
    ]).first()
    return {c: row[c] for c in cols}


def modes(df: DataFrame, cols) -> dict:
    """Most frequent non-NULL value of each column; ties resolve to the smallest.

    One job for all columns: rows are unpivoted to (column, value) pairs, counted
    with a map-side partial aggregate, then reduced per column with
    ``min(struct(-count, value))``.  Numeric and string columns are kept in
    separate typed slots so "smallest" follows each column's own ordering.
    """
    cols = list(cols)
    if not cols:
        return {}
    numeric = {c for c in cols
               if df.schema[c].dataType.typeName() not in ("string", "boolean")}
    pairs = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("col"),
            (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("d"),
            (F.lit(None).cast("string") if c in numeric else F.col(c).cast("string")).alias("s"),
        )
        for c in cols
    ])).alias("p")
    long = df.select(pairs).select("p.col", "p.d", "p.s") \
        .where(F.col("d").isNotNull() | F.col("s").isNotNull()) \
        .where(F.col("d").isNull() | ~F.isnan("d"))
    counted = long.groupBy("col", "d", "s").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("col").agg(
        F.min(F.struct((-F.col("n")).alias("negn"), F.col("d"), F.col("s"))).alias("b")
    ).collect()
    out = {c: None for c in cols}
    for r in best:
        b = r["b"]
        out[r["col"]] = b["d"] if r["col"] in numeric else b["s"]
    for c in numeric:
        if out[c] is not None and df.schema[c].dataType.typeName() in ("integer", "long", "short", "byte"):
            out[c] = int(out[c])
    return out

"""table-level validation of cleaned customer rows.

Each rule is a Column predicate that is true when the row violates it (NULL in
a required field is a violation).  Rows get an ``array<string>`` of reasons;
the counts of every rule come from one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S


def rules(df: DataFrame) -> list[tuple[str, Column]]:
    out: list[tuple[str, Column]] = []

    def enum(c, values):
        return F.col(c).isNull() | ~F.col(c).isin(*values)

    out.append(("gender", enum("gender", S.GENDERS)))
    for c in S.UNIT_RANGE_COLS:
        out.append((c, F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > 1)))
    out.append(("InternetService", enum("InternetService", S.INTERNET_SERVICES)))
    out.append(("Contract", enum("Contract", S.CONTRACTS)))
    out.append(("PaymentMethod", F.col("PaymentMethod").isNull()))
    for c in S.NON_NEGATIVE_COLS:
        out.append((c, F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.col(c) < 0)))
    return [(name, F.coalesce(cond, F.lit(True))) for name, cond in out if name in df.columns]


def with_reasons(df: DataFrame, out: str = "reasons") -> DataFrame:
    rs = rules(df)
    arr = F.array(*[F.when(cond, F.lit(name)) for name, cond in rs])
    return df.withColumn(out, F.array_compact(arr))


def split_valid(df: DataFrame, key: str = S.KEY):
    """(valid rows, rejects(key, reasons)) - two filters over one projection."""
    tagged = with_reasons(df)
    valid = tagged.where(F.size("reasons") == 0).drop("reasons")
    rejects = tagged.where(F.size("reasons") > 0).select(key, "reasons")
    return valid, rejects


def violation_counts(df: DataFrame) -> DataFrame:
    """Per rule violation count plus total and valid row counts (long form)."""
    rs = rules(df)
    any_bad = F.lit(False)
    for _, cond in rs:
        any_bad = any_bad | cond
    aggs = [F.count_if(cond).alias(name) for name, cond in rs]
    aggs += [F.count(F.lit(1)).alias("rows_total"), F.count_if(~any_bad).alias("rows_valid")]
    names = [name for name, _ in rs] + ["rows_total", "rows_valid"]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("n")) for n in names
    ])).alias("r")).select("r.rule", "r.n")

"""Cleaning expressions (F1-F12).  Everything is a Column expression decided
from the schema on the driver; no Python runs per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.functions import stats

# A plain decimal/scientific number with optional sign and surrounding blanks.
# Guards try_cast, which would also accept 'NaN', 'Infinity' and Java suffixes.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def text_to_double(c: Column) -> Column:
    """text -> double; anything that is not a plain number becomes NULL."""
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def to_double(df: DataFrame, col: str) -> Column:
    c = F.col(col)
    if S.is_string(df, col):
        return text_to_double(c)
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def replace_sentinels(c: Column) -> Column:
    """'No internet service' / 'No phone service' -> 'No'."""
    out = c
    for src, dst in S.SERVICE_SENTINELS.items():
        out = F.when(out == src, F.lit(dst)).otherwise(out)
    return out


def normalize_service_text(df: DataFrame, cols) -> DataFrame:
    todo = [c for c in S.present(df, cols) if S.is_string(df, c)]
    return df.withColumns({c: replace_sentinels(F.col(c)) for c in todo}) if todo else df


def coerce_flag(df: DataFrame, col: str) -> Column:
    """lenient 0/1 coercion.

    strings: sentinels -> 'No', then yes/true -> 1, no/false -> 0, else the
    numeric value truncated toward zero; booleans -> 0/1; NULL/unparsable -> 0.
    """
    c = F.col(col)
    if S.is_string(df, col):
        low = F.lower(replace_sentinels(c))
        num = text_to_double(c).try_cast("int")
        v = F.when(low.isin(*S.TRUE_WORDS), F.lit(1)) \
             .when(low.isin(*S.FALSE_WORDS), F.lit(0)) \
             .otherwise(num)
    elif S.is_boolean(df, col):
        v = c.cast("int")
    else:
        d = c.cast("double")
        v = F.when(~F.isnan(d), d).try_cast("int")
    return F.coalesce(v, F.lit(0)).cast("int")


def coerce_flags(df: DataFrame, cols) -> DataFrame:
    todo = S.present(df, cols)
    return df.withColumns({c: coerce_flag(df, c) for c in todo}) if todo else df


def label_column(df: DataFrame, col: str = S.TARGET, out: str | None = None) -> DataFrame:
    """string label Yes -> 1, anything else (incl. NULL) -> 0; numeric labels untouched."""
    out = out or col
    if S.is_string(df, col):
        return df.withColumn(out, F.when(F.col(col) == "Yes", 1).otherwise(0))
    return df.withColumn(out, F.col(col).cast("int"))


def contract_ordinal(c: Column, lenient: bool = True) -> Column:
    """Contract -> 1/2/3; unmapped -> 0 (lenient) or NULL (strict)."""
    expr = None
    for name, code in S.CONTRACT_ORDER.items():
        expr = (F.when(c == name, F.lit(code)) if expr is None
                else expr.when(c == name, F.lit(code)))
    return expr.otherwise(F.lit(0) if lenient else F.lit(None).cast("int"))


def parse_total_charges(df: DataFrame, col: str = "TotalCharges") -> DataFrame:
    return df.withColumn(col, to_double(df, col)) if col in df.columns else df


def fit_lenient(df: DataFrame) -> dict:
    """Fit-time statistics for :func:`clean_lenient`: the TotalCharges median."""
    if "TotalCharges" not in df.columns:
        return {"TotalCharges_median": None}
    parsed = parse_total_charges(df)
    return {"TotalCharges_median": stats.exact_median(parsed, "TotalCharges")}


def clean_lenient(df: DataFrame, fitted: dict | None = None,
                  encode_contract: bool = True) -> DataFrame:
    """F1-F3, F6, F7, F9, F10 (config-driven CLI behaviour).

    The id column stays as the row key; it is excluded from feature lists.
    Statistics are learnt by :func:`fit_lenient` (on this batch if not given).
    """
    fitted = fitted if fitted is not None else fit_lenient(df)
    out = parse_total_charges(df)
    med = fitted.get("TotalCharges_median")
    if "TotalCharges" in out.columns and med is not None:
        out = out.withColumn("TotalCharges", F.coalesce(F.col("TotalCharges"), F.lit(float(med))))
    out = normalize_service_text(out, S.REPLACE_COLS + S.SERVICE_COLS)
    out = coerce_flags(out, S.BOOLEAN_COLS + S.SERVICE_COLS)
    if encode_contract and "Contract" in out.columns and S.is_string(out, "Contract"):
        out = out.withColumn("Contract", contract_ordinal(F.col("Contract"), lenient=True))
    return out


def strict_flag_columns(df: DataFrame, cols) -> list[str]:
    """F8: columns whose *every* value (NULL included) lies in {Yes, No}; one aggregate."""
    cand = [c for c in S.present(df, cols) if S.is_string(df, c)]
    if not cand:
        return []
    row = df.agg(*[
        F.bool_and(F.coalesce(F.col(c).isin("Yes", "No"), F.lit(False))).alias(c)
        for c in cand
    ]).first()
    return [c for c in cand if row[c] is None or row[c]]


def clean_strict(df: DataFrame, fitted: dict | None = None) -> DataFrame:
    """G14 first half (app preprocessing): strict encodings.

    Flags are mapped only when the whole column is Yes/No; unmapped Contract
    values become NULL.  ``fitted`` carries the median and the flag list.
    """
    if fitted is None:
        normalized = normalize_service_text(df, S.REPLACE_COLS)
        fitted = fit_lenient(df)
        fitted["strict_flags"] = strict_flag_columns(normalized, S.BOOLEAN_COLS)
    out = parse_total_charges(df)
    med = fitted.get("TotalCharges_median")
    if "TotalCharges" in out.columns and med is not None:
        out = out.withColumn("TotalCharges", F.coalesce(F.col("TotalCharges"), F.lit(float(med))))
    out = normalize_service_text(out, S.REPLACE_COLS)
    flags = fitted.get("strict_flags", [])
    if flags:
        out = out.withColumns({
            c: F.when(F.col(c) == "Yes", 1).when(F.col(c) == "No", 0).cast("int")
            for c in flags
        })
    if "Contract" in out.columns and S.is_string(out, "Contract"):
        out = out.withColumn("Contract", contract_ordinal(F.col("Contract"), lenient=False))
    return out


def drop_nulls(df: DataFrame, subset=None) -> DataFrame:
    """drop rows holding a NULL (or NaN) in any (subset) column."""
    return df.na.drop(how="any", subset=subset)

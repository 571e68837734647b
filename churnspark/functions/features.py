"""Scalar feature derivations (G1-G6, G8) as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.functions.clean import text_to_double


def tenure_group(df: DataFrame, col: str = "tenure") -> Column:
    """G1: tenure bins; NULL/NaN fall to the last bin, unparsable text -> 'Unknown'."""
    if S.is_string(df, col):
        t = text_to_double(F.col(col))
    else:
        t = F.col(col).cast("double")
    expr = None
    for upper, label in S.TENURE_BINS:
        cond = t <= F.lit(float(upper))
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    expr = expr.otherwise(S.LAST_TENURE_BIN)
    if S.is_string(df, col):
        expr = F.when(t.isNull(), F.lit(S.UNKNOWN_TENURE_BIN)).otherwise(expr)
    return expr


def long_term(col: str = "tenure") -> Column:
    """Tenure > 24 as 0/1 (NULL -> 0)."""
    return F.coalesce((F.col(col) > S.LONG_TERM_MONTHS).cast("int"), F.lit(0))


def less_than_6_months(col: str = "tenure") -> Column:
    """Tenure < 6 as 0/1 (NULL -> 0)."""
    return F.coalesce((F.col(col) < S.SHORT_TENURE_MONTHS).cast("int"), F.lit(0))


def availing_internet(col: str = "InternetService") -> Column:
    """0 if the internet service is 'No', else 1 (NULL -> 1)."""
    return F.when(F.col(col) == "No", 0).otherwise(1)


def num_services(df: DataFrame) -> Column:
    """Sum of the service flags that exist (DeviceProtection is not counted)."""
    cols = S.present(df, S.SERVICE_COLS)
    if not cols:
        return F.lit(0)
    return reduce(lambda a, b: a + b,
                  [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in cols])


def avg_charge(charges: str = "MonthlyCharges", n: str = "NumServices") -> Column:
    """MonthlyCharges / NumServices, and MonthlyCharges itself when there are none."""
    d = F.col(n)
    return F.col(charges) / F.when(d == 0, F.lit(1)).otherwise(d)


def yeo_johnson(c: Column, lam: float) -> Column:
    """Yeo-Johnson transform with a fixed lambda (no standardising)."""
    x = c.cast("double")
    tiny = 2.220446049250313e-16          # machine epsilon: the lambda == 0 / 2 test
    if abs(lam) < tiny:
        pos = F.log1p(x)
    else:
        pos = (F.pow(x + 1.0, F.lit(lam)) - 1.0) / F.lit(lam)
    if abs(lam - 2.0) > tiny:
        neg = -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / F.lit(2.0 - lam)
    else:
        neg = -F.log1p(-x)
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson_slopes(c: Column, lam: Column) -> tuple[Column, Column, Column]:
    """The transform of :func:`yeo_johnson` with lambda from a column, and its first and second derivative by lambda.

    With u = log1p|x| and a = lambda (2 - lambda below zero) they are the integrals over
    [0, u] of exp(a s), s exp(a s) and s^2 exp(a s), by series where a * u is small.
    """
    x = c.cast("double")
    below = x < 0
    u, a = F.log1p(F.abs(x)), F.when(below, 2.0 - lam).otherwise(lam)
    t = a * u
    e = F.exp(t)

    def either(series: list[float], power: int, closed: Column) -> Column:
        total = F.lit(0.0)
        for k in reversed(series):
            total = total * t + F.lit(1.0 / k)
        return F.when(F.abs(t) < 0.05, F.pow(u, F.lit(power)) * total).otherwise(closed)

    g = either([1, 2, 6, 24, 120], 1, (e - 1) / a)
    g1 = either([2, 3, 8, 30, 144], 2, (e * (t - 1) + 1) / (a * a))
    g2 = either([3, 4, 10, 36, 168], 3, (e * (t * t - 2 * t + 2) - 2) / (a * a * a))
    return F.when(below, -g).otherwise(g), g1, F.when(below, -g2).otherwise(g2)


def engineer_lenient(df: DataFrame) -> DataFrame:
    """Derived features of the config-driven builder (on cleaned, coerced data)."""
    out = df
    if "tenure" in out.columns:
        out = out.withColumns({"tenure_group": tenure_group(out), "LongTerm": long_term()})
    if "InternetService" in out.columns:
        out = out.withColumn("AvailingInternetService", availing_internet())
    if S.present(out, S.SERVICE_COLS):
        out = out.withColumn("NumServices", num_services(out))
    if "MonthlyCharges" in out.columns and "NumServices" in out.columns:
        out = out.withColumn("AvgCharge", avg_charge())
    return out


def engineer_app(df: DataFrame) -> DataFrame:
    """G14 second half: the app's feature set (adds LessThan6Months)."""
    S.require_columns(df, ["tenure", "InternetService", "MonthlyCharges"])
    out = df.withColumns({
        "tenure_group": tenure_group(df),
        "LongTerm": long_term(),
        "AvailingInternetService": availing_internet(),
    })
    out = out.withColumn("NumServices", num_services(out))
    return out.withColumns({
        "AvgCharge": avg_charge(),
        "LessThan6Months": less_than_6_months(),
    })

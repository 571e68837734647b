"""Column groups, fixed value lists and schema helpers.

Everything under "Fixed values" must equal the behaviour being matched
(same names, same order); they are stated plainly and kept together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay identical for matching results)
# ---------------------------------------------------------------------------

KEY = "customerID"
TARGET = "Churn"
SEED = 42

RAW_SCHEMA = T.StructType([
    T.StructField("customerID", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("SeniorCitizen", T.IntegerType()),
    T.StructField("Partner", T.StringType()),
    T.StructField("Dependents", T.StringType()),
    T.StructField("tenure", T.IntegerType()),
    T.StructField("PhoneService", T.StringType()),
    T.StructField("MultipleLines", T.StringType()),
    T.StructField("InternetService", T.StringType()),
    T.StructField("OnlineSecurity", T.StringType()),
    T.StructField("OnlineBackup", T.StringType()),
    T.StructField("DeviceProtection", T.StringType()),
    T.StructField("TechSupport", T.StringType()),
    T.StructField("StreamingTV", T.StringType()),
    T.StructField("StreamingMovies", T.StringType()),
    T.StructField("Contract", T.StringType()),
    T.StructField("PaperlessBilling", T.StringType()),
    T.StructField("PaymentMethod", T.StringType()),
    T.StructField("MonthlyCharges", T.DoubleType()),
    T.StructField("TotalCharges", T.StringType()),
    T.StructField("Churn", T.StringType()),
])

# Sentinel service answers that mean "No".
SERVICE_SENTINELS = {"No internet service": "No", "No phone service": "No"}

# Columns whose sentinel answers are replaced.
REPLACE_COLS = [
    "MultipleLines", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies",
]

# Yes/No style columns turned into 0/1 integers.
BOOLEAN_COLS = [
    "SeniorCitizen", "Partner", "Dependents", "PhoneService", "MultipleLines",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
    "StreamingTV", "StreamingMovies", "PaperlessBilling", "Churn",
]

# Services counted by NumServices (DeviceProtection is not one of them).
SERVICE_COLS = [
    "PhoneService", "MultipleLines", "AvailingInternetService",
    "OnlineSecurity", "OnlineBackup", "TechSupport", "StreamingTV", "StreamingMovies",
]

# Lenient flag coercion words.
TRUE_WORDS = ["yes", "true"]
FALSE_WORDS = ["no", "false"]

CONTRACT_ORDER = {"Month-to-month": 1, "One year": 2, "Two year": 3}

# tenure_group: upper bound (inclusive) -> label; anything above the last bound
# (and NaN/NULL) goes to LAST_TENURE_BIN.
TENURE_BINS = [
    (12, "0-12 Months"),
    (24, "13-24 Months"),
    (48, "25-48 Months"),
    (60, "49-60 Months"),
]
LAST_TENURE_BIN = "61-72 Months"
UNKNOWN_TENURE_BIN = "Unknown"

LONG_TERM_MONTHS = 24
SHORT_TENURE_MONTHS = 6

CATEGORICAL = ["gender", "InternetService", "PaymentMethod", "tenure_group"]
NUMERIC = ["tenure", "MonthlyCharges", "TotalCharges", "NumServices", "AvgCharge"]
APP_BOOL = [
    "SeniorCitizen", "Partner", "Dependents", "PhoneService", "MultipleLines",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
    "StreamingTV", "StreamingMovies", "PaperlessBilling", "LessThan6Months",
    "AvailingInternetService", "LongTerm",
]
# The original app lists leave Contract out; we add it as an ordinal numeric.
EXTRA_NUMERIC = ["Contract"]

POWER_FEATURES = ["tenure", "MonthlyCharges", "TotalCharges", "NumServices", "AvgCharge"]

# Validation rules (table form of the per-row schema check).
GENDERS = ["Male", "Female"]
INTERNET_SERVICES = ["DSL", "Fiber optic", "No"]
CONTRACTS = ["Month-to-month", "One year", "Two year"]
UNIT_RANGE_COLS = [
    "SeniorCitizen", "Partner", "Dependents", "PhoneService", "MultipleLines",
    "OnlineSecurity", "OnlineBackup", "TechSupport", "StreamingTV",
    "StreamingMovies", "PaperlessBilling",
]
NON_NEGATIVE_COLS = ["tenure", "MonthlyCharges", "TotalCharges"]

# Risk segments: quantile cut (or fixed band) -> label, first match wins.
RISK_LEVELS = [
    ("Very High Risk", 0.9),
    ("High Risk", 0.7),
    ("Medium Risk", 0.4),
]
LOWEST_RISK = "Low Risk"

# Segment -> (discount, contact, priority).
INTERVENTIONS = {
    "Very High Risk": ("30% retention offer", "Immediate manager call", "Critical"),
    "High Risk": ("20% loyalty discount", "Personalized email campaign", "High"),
    "Medium Risk": ("10% upgrade offer", "Automated engagement", "Normal"),
    "Low Risk": ("No discount", "Periodic newsletter", "Low"),
}

# Evaluation constants.
DEFAULT_THRESHOLD = 0.5
SWEEP_POINTS = 100          # thresholds linspace(0, 1, 100)
CLASS_HIST_BINS = 50
OUTCOME_HIST_BINS = 30
PR_F1_EPS = 1e-8

# ---------------------------------------------------------------------------


def require_columns(df: DataFrame, cols) -> None:
    """Raise a readable error when any of ``cols`` is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def present(df: DataFrame, cols) -> list[str]:
    """The subset of ``cols`` present in ``df``, keeping ``cols`` order."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def is_string(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.StringType)


def is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.NumericType)


def is_boolean(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.BooleanType)

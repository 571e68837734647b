"""churnspark - customer-churn analytics as Spark DataFrame / Spark ML operators."""

__version__ = "0.1.0"

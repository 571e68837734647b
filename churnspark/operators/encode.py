"""Category encodings: ordinal codes (F12), drop-first one-hot (G10), names.

One-hot comes as columns (:func:`one_hot_drop_first`, a column a level) or as one
sparse vector (:func:`fit_sparse_one_hot`, whose plan does not grow with the levels).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S

#: Levels that a category may have before its encoding is refused.
MAX_LEVELS = 100_000


def category_levels(df: DataFrame, cols, max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct non-NULL values of every column in ONE distributed job.

    Rows are unpivoted to (column, value) and de-duplicated with a map-side
    partial aggregate; only the vocabularies reach the driver.  A column with more
    than ``max_levels`` values is an error: it is an identifier or free text, not a
    category, and at most ``max_levels`` values a column are ever fetched.
    """
    cols = list(cols)
    if not cols:
        return {}
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("p")
    rows = df.select(pairs).select("p.col", "p.value").where(F.col("value").isNotNull()) \
        .distinct().limit(max_levels * len(cols) + 1).collect()
    out = {c: [] for c in cols}
    for r in rows:
        out[r["col"]].append(r["value"])
    many = [c for c in cols if len(out[c]) > max_levels]
    if many:
        raise ValueError(f"more than {max_levels} values in {many}: not categories")
    return {c: sorted(v) for c, v in out.items()}


def one_hot_drop_first(df: DataFrame, cols, levels: dict | None = None,
                       keep_input: bool = False) -> DataFrame:
    """One 0/1 double column ``<col>_<value>`` per level except the first
    (sorted) one; unseen values and NULL encode as all zeros."""
    cols = list(cols)
    levels = levels if levels is not None else category_levels(df, cols)
    new = {}
    for c in cols:
        for v in levels[c][1:]:
            new[f"{c}_{v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0))
    out = df.withColumns(new) if new else df
    return out if keep_input else out.drop(*cols)


def fit_sparse_one_hot(df: DataFrame, cols, out: str = "onehot", levels: dict | None = None,
                       max_levels: int = MAX_LEVELS) -> PipelineModel:
    """G10 as one sparse vector column ``out``; its components are named by :func:`one_hot_names`.

    The fitted model (savable like any) looks levels up in a table and adds a column,
    however many levels there are; only the active components of a row are stored.
    As in :func:`one_hot_drop_first`, a column's first level, values not seen and NULL
    have no active component.  Columns with less than two levels have no components.
    """
    levels = levels if levels is not None else category_levels(df, cols, max_levels)
    cols = [c for c in cols if len(levels[c]) > 1]
    if not cols:
        raise ValueError("no column has two or more levels")
    codes, at, parts = ([f"_{c}_{what}" for c in cols] for what in ("code", "at", "hot"))
    # the first level is left out of the table: like unseen values it gets the last code, which the encoder drops
    # (a table each: the labels of several columns would all be as long as the longest)
    index = [StringIndexerModel.from_labels(levels[c][1:], inputCol=c, outputCol=o, handleInvalid="keep") for c, o in zip(cols, codes)]
    # plain numbers: the encoder's names for components may not be empty, a level may
    plain = SQLTransformer(statement="SELECT *, " + ", ".join(f"`{c}` + 0D AS `{a}`" for c, a in zip(codes, at)) + " FROM __THIS__")
    sizes = [F.lit(0.0).alias(a, metadata={"ml_attr": {"type": "nominal", "num_vals": len(levels[c])}}) for c, a in zip(cols, at)]
    hot = OneHotEncoder(inputCols=at, outputCols=parts, dropLast=True).fit(df.limit(0).select(*sizes))   # reads no row
    tidy = SQLTransformer(statement="SELECT * EXCEPT (" + ", ".join(f"`{c}`" for c in [*codes, *at, *parts]) + ") FROM __THIS__")
    return PipelineModel([*index, plain, hot, VectorAssembler(inputCols=parts, outputCol=out), tidy])


def one_hot_names(cols, levels: dict) -> list[str]:
    return [f"{c}_{v}" for c in cols for v in levels[c][1:]]


def feature_names(cat_cols, levels: dict, numeric=None, boolean=None) -> list[str]:
    """One-hot names first, then numerics, then boolean flags."""
    numeric = list(S.NUMERIC + S.EXTRA_NUMERIC) if numeric is None else list(numeric)
    boolean = list(S.APP_BOOL) if boolean is None else list(boolean)
    return one_hot_names(cat_cols, levels) + numeric + boolean


def feature_name_frame(spark, names) -> DataFrame:
    """G11 as a DataFrame (idx, name)."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "idx int, name string")


def label_codes(df: DataFrame, cols, suffix: str = "") -> DataFrame:
    """each category -> its position among the sorted distinct values (int).

    Built-in ``StringIndexer`` (alphabetical order) fits all columns in one
    distributed count; the transform is a JVM lookup, no shuffle.
    """
    cols = list(cols)
    outs = [f"{c}__idx" for c in cols]
    model = StringIndexer(inputCols=cols, outputCols=outs, stringOrderType="alphabetAsc",
                          handleInvalid="keep").fit(df)
    out = model.transform(df)
    for c, o in zip(cols, outs):
        out = out.withColumn(c + suffix, F.col(o).cast("int")).drop(o) if suffix else \
            out.withColumn(c, F.col(o).cast("int")).drop(o)
    return out


def select_roles(df: DataFrame, categorical=None, numerical=None, exclude=(S.KEY, S.TARGET, "label")):
    """Column roles.  Explicit lists are intersected with the present columns;
    a missing (None) list falls back to the schema: string columns are
    categorical, numeric/boolean columns numerical.  Everything else is dropped."""
    from pyspark.sql import types as T
    cols = [c for c in df.columns if c not in exclude]
    if categorical is None:
        categorical = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    if numerical is None or len(numerical) == 0:
        numerical = [c for c in cols if c not in categorical and
                     isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
    return {"categorical": S.present(df, categorical), "numerical": S.present(df, numerical)}

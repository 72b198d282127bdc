"""A1-A4: scans, dataset info and preview.

CSV is read as text first, the pandas missing-value tokens are turned into
nulls, and every column's type is decided by one aggregate pass over all
columns (how many non-null values survive ``try_cast`` to long, double,
boolean).  The pass is a single map-side-combined aggregation, so inference
costs one scan whatever the width of the file.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import normalize_nan
from ..operators.schema import categorical_columns, numeric_columns

# The default missing-value tokens of pandas.read_csv
# (public pandas documentation, "na_values").
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# The literals pandas.read_csv reads as booleans.
PANDAS_TRUE = ["True", "TRUE", "true"]
PANDAS_FALSE = ["False", "FALSE", "false"]


def read_parquet(spark: SparkSession, path: str, where: Column | str | None = None) -> DataFrame:
    """A2: parquet scan; projections reach the reader.  A filter given as
    ``where`` is applied to the stored columns, before NaN becomes null, so it
    is pushed into the scan whatever the column type."""
    df = spark.read.parquet(path)
    return normalize_types(df if where is None else df.filter(where))


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Choose the reader by suffix (the service accepted only ``.csv``)."""
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    if fmt == "csv":
        return read_csv(spark, path)
    if fmt == "parquet":
        return read_parquet(spark, path)
    raise ValueError(f"unsupported format: {fmt}")


def _null_tokens(c: str) -> Column:
    raw = F.col(c)
    return F.when(F.trim(raw).isin(PANDAS_NA_TOKENS) | raw.isNull(), F.lit(None)).otherwise(raw)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             multi_line: bool = True) -> DataFrame:
    """A1: CSV scan with pandas-like null tokens and type inference.  Quotes
    are doubled inside quoted fields, which may hold line breaks; a large file
    without such breaks can be split over tasks with ``multi_line=False``."""
    reader = (spark.read.option("header", True).option("mode", "FAILFAST").option("quote", '"').option("escape", '"')
              .option("multiLine", multi_line))
    if schema is not None:
        return normalize_types(reader.schema(schema).csv(path))
    text = reader.option("inferSchema", False).csv(path)
    cols = text.columns
    text = text.select([_null_tokens(c).alias(c) for c in cols])
    probes = []
    for i, c in enumerate(cols):
        v = F.trim(F.col(c))
        probes += [
            F.count(v).alias(f"n{i}"),
            F.count(F.expr(f"try_cast(trim(`{c}`) as bigint)")).alias(f"l{i}"),
            F.count(F.expr(f"try_cast(trim(`{c}`) as double)")).alias(f"d{i}"),
            F.count(F.when(v.isin(PANDAS_TRUE + PANDAS_FALSE), 1)).alias(f"b{i}"),
        ]
    stats = text.agg(*probes).first() if cols else None
    out = []
    for i, c in enumerate(cols):
        n, nl, nd, nb = stats[f"n{i}"], stats[f"l{i}"], stats[f"d{i}"], stats[f"b{i}"]
        v = F.trim(F.col(c))
        if n == 0:
            # pandas reads an all-missing column as float64
            out.append(F.lit(None).cast("double").alias(c))
        elif nl == n:
            out.append(F.expr(f"try_cast(trim(`{c}`) as bigint)").alias(c))
        elif nd == n:
            out.append(F.expr(f"try_cast(trim(`{c}`) as double)").alias(c))
        elif nb == n:
            out.append(F.when(v.isin(PANDAS_TRUE), True).when(v.isin(PANDAS_FALSE), False).alias(c))
        else:
            out.append(F.col(c).alias(c))
    return normalize_types(text.select(out))


def normalize_types(df: DataFrame) -> DataFrame:
    """One null marker.  Float NaN becomes null, decimals become double;
    nested types other than numeric arrays are rejected."""
    out = []
    for f in df.schema.fields:
        dt = f.dataType
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            out.append(normalize_nan(F.col(f.name)).alias(f.name))
        elif isinstance(dt, T.DecimalType):
            out.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(dt, (T.MapType, T.StructType)):
            raise TypeError(f"column {f.name!r}: type {dt.simpleString()} is not supported")
        else:
            out.append(F.col(f.name))
    return df.select(out)


def dataset_info(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric / categorical counts, total missing —
    one aggregate pass over every column."""
    num = numeric_columns(df)
    cat = categorical_columns(df)
    missing = [F.sum(F.col(c).isNull().cast("long")) for c in df.columns]
    total = reduce(lambda a, b: a + b, missing) if missing else F.lit(0)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
        F.lit(len(num)).cast("bigint").alias("n_numeric"),
        F.lit(len(cat)).cast("bigint").alias("n_categorical"),
        F.coalesce(total, F.lit(0)).cast("bigint").alias("missing_total"),
    )


def preview(df: DataFrame, order_by: list[str] | None = None, n: int = 10) -> DataFrame:
    """First ``n`` rows under an explicit order (Spark rows carry none);
    a top-n sort keeps only n rows per task."""
    keys = order_by or df.columns
    return df.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).limit(n)

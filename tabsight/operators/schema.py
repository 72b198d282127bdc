"""Column roles and problem typing."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def is_numeric(dt: T.DataType) -> bool:
    """Booleans are not numeric (pandas ``select_dtypes('number')``)."""
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, exclude: list[str] | tuple = ()) -> list[str]:
    """B1: numeric columns in table order."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: list[str] | tuple = ()) -> list[str]:
    """B1: everything that is not numeric (strings, booleans, dates...)."""
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: list[str] | tuple = ()) -> list[str]:
    """B1: object/category columns = strings."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def existing(df: DataFrame, cols) -> list[str]:
    """B2: keep the names that exist, in the given order."""
    have = set(df.columns)
    return [c for c in (cols or []) if c in have]


def align_columns(df: DataFrame, columns: list[str], fill_value=0) -> DataFrame:
    """Reindex to the training columns, missing ones filled."""
    have = set(df.columns)
    return df.select([F.col(c) if c in have else F.lit(fill_value).alias(c) for c in columns])


def distinct_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Exact distinct non-null values of every column: the columns are
    unpivoted to (column, value) and de-duplicated together (map-side first),
    one shuffle whatever the number of columns."""
    if not cols:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("string").alias("v"))
                                for i, c in enumerate(cols)])).alias("kv")
    exact = (df.select(pairs).select("kv.*").filter(F.col("v").isNotNull()).distinct()
             .groupBy("k").count().collect())
    got = {r["k"]: int(r["count"]) for r in exact}
    return {c: got.get(i, 0) for i, c in enumerate(cols)}


def infer_problem_type(df: DataFrame, target: str | None) -> str:
    """H6: no target -> Clustering; numeric target with more than 10
    distinct values -> Regression; otherwise Classification."""
    if target is None:
        return "Clustering"
    dt = df.schema[target].dataType
    if is_numeric(dt):
        n = distinct_counts(df, [target])[target]
        return "Regression" if n > 10 else "Classification"
    return "Classification"


def problem_type_table(df: DataFrame, target: str | None) -> DataFrame:
    """H6 as a one-row table (for the SQL check)."""
    spark = df.sparkSession
    if target is None:
        return spark.createDataFrame([("Clustering",)], "problem_type string")
    dt = df.schema[target].dataType
    if not is_numeric(dt):
        return df.agg(F.lit("Classification").alias("problem_type"))
    return df.agg(F.when(F.count_distinct(target) > 10, "Regression")
                  .otherwise("Classification").alias("problem_type"))

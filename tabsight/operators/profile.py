"""Describe, column profile, top features, missing values.

Every statistic of every column comes out of one aggregate pass (plus the
quantile passes of ``functions.stats``); results are unpivoted with
``stack`` so each operator returns a small long table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import adjusted_skewness, correlation_row, quantiles
from .schema import categorical_columns, distinct_counts, is_numeric, numeric_columns


def _stack(pairs: list[tuple[str, list[Column]]], names: list[str]) -> Column:
    """Build ``stack(n, 'name', v1, v2, ..., ...)`` over aggregate columns."""
    args = []
    for name, values in pairs:
        args.append(F.lit(name))
        args.extend(values)
    return F.stack(F.lit(len(pairs)), *args).alias(*names)


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max per numeric column."""
    cols = cols or numeric_columns(df)
    q = quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs)
    pairs = []
    for i, c in enumerate(cols):
        qs = q[c]
        pairs.append((c, [F.col(f"c{i}"), F.col(f"m{i}"), F.col(f"s{i}"), F.col(f"lo{i}"),
                          F.lit(qs[0]).cast("double"), F.lit(qs[1]).cast("double"),
                          F.lit(qs[2]).cast("double"), F.col(f"hi{i}")]))
    return row.select(_stack(pairs, ["column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max"]))


def describe_categorical(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, unique, top (most frequent; the smallest value on a tie), freq."""
    cols = cols or categorical_columns(df)
    counts = value_counts(df, cols)
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value").asc())
    top = (counts.withColumn("__r", F.row_number().over(w)).filter("__r = 1")
           .select("column_name", F.col("value").alias("top"), F.col("count").alias("freq")))
    summary = counts.groupBy("column_name").agg(F.sum("count").alias("count"),
                                           F.count(F.lit(1)).alias("unique"))
    return summary.join(top, "column_name").select("column_name", "count", "unique", "top", "freq")


def value_counts(df: DataFrame, cols: list[str], as_label: bool = False) -> DataFrame:
    """Long table (column, value, count) of non-null values for many columns
    in one job: unpivot then one grouped count (map-side combined)."""
    vals = [(c, (F.coalesce(F.col(c).cast("string"), F.lit("nan")) if as_label
                 else F.col(c).cast("string"))) for c in cols]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), v.alias("value"))
                                         for c, v in vals])).alias("kv")).select("kv.*")
    return long.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 5) -> DataFrame:
    """F1/D3: the k most frequent values (as text, missing -> 'nan') per
    column, ties by value.  ``row_number() <= k`` lets Spark keep only k rows
    per column in each task before the shuffle (window group limit)."""
    cols = cols or categorical_columns(df)
    counts = value_counts(df, cols, as_label=True)
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value").asc())
    return (counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("column_name", "value", "count", F.col("rank").cast("bigint").alias("rank")))


def column_profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """Dtype, nunique, missing, is_target; numeric columns add min,
    max, mean, std and adjusted skew rounded to 5 places."""
    pairs = []
    aggs = []
    nunique = distinct_counts(df, df.columns)
    for i, f in enumerate(df.schema.fields):
        c, num = f.name, is_numeric(f.dataType)
        x = F.col(c).cast("double") if num else None
        aggs += [F.lit(nunique[c]).alias(f"u{i}"), F.sum(F.col(c).isNull().cast("long")).alias(f"z{i}")]
        if num:
            aggs += [F.round(F.min(x), 5).alias(f"lo{i}"), F.round(F.max(x), 5).alias(f"hi{i}"),
                     F.round(F.avg(x), 5).alias(f"m{i}"), F.round(F.stddev_samp(x), 5).alias(f"s{i}"),
                     F.round(adjusted_skewness(x), 5).alias(f"k{i}")]
        else:
            aggs += [F.lit(None).cast("double").alias(n + str(i)) for n in ("lo", "hi", "m", "s", "k")]
        pairs.append((c, [F.lit(f.dataType.simpleString()), F.col(f"u{i}").cast("bigint"),
                          F.coalesce(F.col(f"z{i}"), F.lit(0)).cast("bigint"), F.lit(c == target),
                          F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"m{i}"), F.col(f"s{i}"), F.col(f"k{i}")]))
    return df.agg(*aggs).select(_stack(pairs, ["column_name", "dtype", "nunique", "missing", "is_target",
                                               "min", "max", "mean", "std", "skew"]))


def correlation_long(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """D9 (pearson): long table (col_a, col_b, corr) for every ordered pair,
    pairwise-complete rows, null for a constant column.  Two sum-only passes."""
    cols = cols if cols is not None else numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    key = {p: k for k, p in enumerate(pairs)}
    row = correlation_row(df, pairs)
    out = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            k = key[(a, b)] if j >= i else key[(b, a)]
            out.append((a, [F.lit(b), F.col(f"r{k}")]))
    return row.select(_stack(out, ["col_a", "col_b", "corr"]))


def correlation_snippet(df: DataFrame) -> DataFrame:
    """First 8 numeric columns, pearson, 3 places."""
    cols = numeric_columns(df)[:8]
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    return correlation_long(df, cols).select("col_a", "col_b", F.round("corr", 3).alias("corr"))


def top_features(df: DataFrame, target: str | None = None, max_count: int = 5) -> DataFrame:
    """With a numeric target, the other numeric columns by absolute
    correlation with it; otherwise numeric columns by sample std.  Ties
    and nulls are ordered by name, nulls last."""
    num = numeric_columns(df)
    if not num:
        return df.sparkSession.createDataFrame([], "rank bigint, column_name string, score double")
    if target and target in num:
        others = [c for c in num if c != target]
        if not others:
            return df.sparkSession.createDataFrame([], "rank bigint, column_name string, score double")
        r = correlation_row(df, [(c, target) for c in others])
        pairs = [(c, None) for c in others]
        scores = r.select(*[F.abs(F.col(f"r{i}")).alias(f"s{i}") for i in range(len(others))])
    else:
        pairs = [(c, None) for c in num]
        scores = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(num)])
    long = scores.select(_stack([(c, [F.col(f"s{i}")]) for i, (c, _) in enumerate(pairs)],
                                ["column_name", "score"]))
    w = Window.orderBy(F.col("score").desc_nulls_last(), F.col("column_name"))
    return (long.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .filter(F.col("rank") <= max_count).select("rank", "column_name", "score"))


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count and percent (2 places) per column, ascending."""
    n = F.count(F.lit(1))
    aggs = [F.sum(F.col(c).isNull().cast("long")).alias(f"z{i}") for i, c in enumerate(df.columns)]
    row = df.agg(n.alias("__n"), *aggs)
    pairs = [(c, [F.coalesce(F.col(f"z{i}"), F.lit(0)).cast("bigint"),
                  F.round(F.coalesce(F.col(f"z{i}"), F.lit(0)) / F.greatest(F.col("__n"), F.lit(1)) * 100.0, 2)])
             for i, c in enumerate(df.columns)]
    return row.select(_stack(pairs, ["column_name", "missing", "pct"])).orderBy("pct", "column_name")


def dataset_summary(df: DataFrame) -> DataFrame:
    """A (section, key, value) table of shape, roles, missing counts
    and the numeric / categorical describes."""
    from ..sources.scan import dataset_info
    spark = df.sparkSession
    info = dataset_info(df)
    shape = info.select(F.stack(F.lit(5),
                                F.lit("n_rows"), F.col("n_rows").cast("string"),
                                F.lit("n_cols"), F.col("n_cols").cast("string"),
                                F.lit("n_numeric"), F.col("n_numeric").cast("string"),
                                F.lit("n_categorical"), F.col("n_categorical").cast("string"),
                                F.lit("missing_total"), F.col("missing_total").cast("string"))
                        .alias("key", "value")).select(F.lit("shape").alias("section"), "key", "value")
    roles = spark.createDataFrame(
        [("columns", f.name, f.dataType.simpleString()) for f in df.schema.fields],
        "section string, key string, value string")
    miss = missing_values(df).select(F.lit("missing").alias("section"), F.col("column_name").alias("key"),
                                     F.col("missing").cast("string").alias("value"))
    parts = [shape, roles, miss]
    if numeric_columns(df):
        d = describe(df)
        parts.append(d.select(F.lit("describe_numeric").alias("section"), F.col("column_name").alias("key"),
                              F.to_json(F.struct(*[c for c in d.columns if c != "column_name"])).alias("value")))
    if categorical_columns(df):
        d = describe_categorical(df)
        parts.append(d.select(F.lit("describe_categorical").alias("section"), F.col("column_name").alias("key"),
                              F.to_json(F.struct("count", "unique", "top", "freq")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

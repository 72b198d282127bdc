"""Duplicates, imputation, label encoding and the cleaning report.

Every per-column statistic is computed for all columns at once: one pass
counts nulls, one grouped count over the unpivoted (column, value) pairs
gives every mode, and exact medians come from ``functions.stats``.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import running_sums
from ..functions.stats import quantiles
from ..session import cut_lineage
from .profile import value_counts
from .schema import is_numeric, string_columns

REPORT_SCHEMA = ("step string, column_name string, action string, n_affected bigint, "
                 "fill_number double, fill_text string")
# Fixed value: the fill used when a non-numeric column has no value at all.
UNKNOWN = "Unknown"
MOST_SENT = 10_000      # codes of a column that are broadcast


@dataclass
class CleanResult:
    data: DataFrame
    report: DataFrame
    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    codes: DataFrame | None = None
    dropped_rows: int = 0


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One shuffle (group by every column) gives rows before and after."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__k"))
    return g.agg(F.coalesce(F.sum("__k"), F.lit(0)).cast("bigint").alias("n_before"),
                 F.count(F.lit(1)).cast("bigint").alias("n_after")).select(
        "n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_dropped"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row duplicates removed; survivors are identical so which
    copy is kept does not matter."""
    return df.dropDuplicates()


def null_counts(df: DataFrame) -> dict[str, int]:
    row = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"z{i}")
                   for i, c in enumerate(df.columns)]).first()
    return {c: int(row[f"z{i}"] or 0) for i, c in enumerate(df.columns)}


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column, smallest on a tie;
    a grouped count per (column, value), then the top row per column."""
    if not cols:
        return {}
    counts = value_counts(df, cols)
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value").asc())
    top = counts.withColumn("__r", F.row_number().over(w)).filter("__r = 1").collect()
    found = {r["column_name"]: r["value"] for r in top}
    return {c: found.get(c) for c in cols}


def impute(df: DataFrame, cols: list[str] | None = None, keep_all: bool = False):
    """Numeric columns with nulls get the exact median; others the
    mode, or 'Unknown' when every value is missing.  An all-null numeric
    column stays null (its median is undefined) and is reported.

    ``keep_all`` returns the median or mode of every column, also of those
    without nulls here: rows scored later may have nulls anywhere."""
    cols = cols if cols is not None else df.columns
    nulls = null_counts(df.select(cols)) if cols else {}
    wanted = [c for c in cols if keep_all or nulls[c] > 0]
    num = [c for c in wanted if is_numeric(df.schema[c].dataType)]
    cat = [c for c in wanted if c not in num]
    med = {c: v[0] for c, v in quantiles(df, num, [0.5]).items()} if num else {}
    mode = modes(df, cat)
    report = []
    repl = {}
    for c in num:
        if nulls[c] == 0:
            continue
        if med[c] is None:
            report.append(("impute", c, "all_null_numeric_left", nulls[c], None, None))
            continue
        repl[c] = F.coalesce(F.col(c), F.lit(med[c]).cast(df.schema[c].dataType)).alias(c)
        report.append(("impute", c, "median", nulls[c], float(med[c]), None))
    for c in cat:
        if nulls[c] == 0:
            continue
        val = mode[c]
        if val is None:
            repl[c] = F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c)
            report.append(("impute", c, "unknown", nulls[c], None, UNKNOWN))
        else:
            repl[c] = F.coalesce(F.col(c), F.lit(val).cast(df.schema[c].dataType)).alias(c)
            report.append(("impute", c, "mode", nulls[c], None, str(val)))
    out = df.select([repl.get(c, F.col(c)) for c in df.columns])
    return out, report, med, mode


def label_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, code) with codes 0..n-1 in code-point
    order of the text values (pandas ``astype(str)``: null -> 'nan').
    Codes are running counts over the sorted distinct values, so no column
    has to fit in one task."""
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string, value string, code int")
    parts = []
    for c in cols:
        distinct = (df.select(F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("value"))
                    .distinct().withColumn("__one", F.lit(1)))
        ranked = running_sums(distinct, "value", ["__one"])
        parts.append(ranked.select(F.lit(c).alias("column_name"), "value",
                                   (F.col("cum___one") - 1).cast("int").alias("code")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_codes(df: DataFrame, codes: DataFrame, cols: list[str], unseen: dict[str, int] | None = None,
                sizes: dict[str, int] | None = None) -> DataFrame:
    """Replace each column by its code through an equi join per column: a
    column known (``sizes``) to have at most ``MOST_SENT`` codes by broadcast, so
    the rows stay where they are; else AQE picks from the measured size.  A value without a
    code gets ``unseen[column]`` where that is given, else null."""
    out = df
    for c in cols:
        table = codes.filter(F.col("column_name") == c).select(F.col("value").alias("__v"),
                                                                F.col("code").alias("__code"))
        if (sizes or {}).get(c, MOST_SENT + 1) <= MOST_SENT:
            table = F.broadcast(table)
        key = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        code = F.coalesce(F.col("__code"), F.lit(unseen[c])) if unseen and c in unseen else F.col("__code")
        out = (out.withColumn("__v", key).join(table, "__v", "left")
               .withColumn(c, code).drop("__v", "__code"))
    return out.select(df.columns)


def label_encode(df: DataFrame, cols: list[str] | None = None):
    cols = cols if cols is not None else string_columns(df)
    codes = label_codes(df, cols)
    return apply_codes(df, codes, cols), codes


def clean(df: DataFrame, encode: bool = True, count_duplicates: bool = True, keep_all: bool = False) -> CleanResult:
    """Dedupe, impute, encode; the report lists every action, or one
    'none' row.  The de-duplicated rows are written once, and every later
    statistic reads them; the code table is kept the same way, so scoring
    never goes back to the training rows."""
    spark = df.sparkSession
    report = []
    data = cut_lineage(drop_duplicates(df))
    dropped = int(df.count() - data.count()) if count_duplicates else 0
    if dropped:
        report.append(("dedupe", None, "drop_duplicates", dropped, None, None))
    data, imp_report, med, mode = impute(data, keep_all=keep_all)
    report += imp_report
    codes = None
    if encode:
        cols = string_columns(data)
        if cols:
            codes = cut_lineage(label_codes(data, cols))
            sizes = {r["column_name"]: r["count"] for r in codes.groupBy("column_name").count().collect()}
            data = apply_codes(data, codes, cols, sizes=sizes)
            report += [("encode", c, "label_encode", None, None, None) for c in cols]
    if not report:
        report.append(("none", None, "no_cleaning_needed", 0, None, None))
    return CleanResult(data, spark.createDataFrame(report, REPORT_SCHEMA), med, mode, codes, dropped)

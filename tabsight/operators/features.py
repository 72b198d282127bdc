"""H1-H4: one-hot (drop first), interaction and square of the features
most correlated with the target, and the feature report."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import correlation_row
from .schema import is_numeric, numeric_columns, string_columns

MAX_LEVELS = 1_000


@dataclass
class FeatureResult:
    data: DataFrame
    features: list[str]
    report: list[tuple] = field(default_factory=list)
    dummies: dict = field(default_factory=dict)
    interaction: tuple | None = None
    square: str | None = None


def one_hot_levels(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted distinct values per column (bounded: a column over MAX_LEVELS
    values is refused rather than exploding the width)."""
    levels = {}
    for c in cols:
        vals = [r[0] for r in df.select(F.col(c).cast("string")).filter(F.col(c).isNotNull()).distinct()
                .limit(MAX_LEVELS + 1).collect()]
        if len(vals) > MAX_LEVELS:
            raise ValueError(f"{c}: more than {MAX_LEVELS} levels for one-hot encoding")
        levels[c] = sorted(vals)
    return levels


def one_hot(df: DataFrame, cols: list[str] | None = None, levels: dict | None = None) -> tuple[DataFrame, dict]:
    """H1: pandas get_dummies(drop_first=True): columns ``c_value`` for every
    sorted value but the first, 0/1 ints; the source columns are dropped."""
    cols = cols if cols is not None else string_columns(df)
    levels = levels or one_hot_levels(df, cols)
    keep = [F.col(c) for c in df.columns if c not in cols]
    dummies = [F.when(F.col(c).cast("string") == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}")
               for c in cols for v in levels[c][1:]]
    return df.select(*keep, *dummies), levels


def correlation_with(df: DataFrame, cols: list[str], target: str) -> list[tuple[str, float | None]]:
    """|corr(c, target)| for every column in one pass, sorted descending
    with nulls last (stable on the input order)."""
    if not cols:
        return []
    row = correlation_row(df, [(c, target) for c in cols]).first()
    vals = [(c, abs(row[f"r{i}"]) if row[f"r{i}"] is not None else None) for i, c in enumerate(cols)]
    return sorted(vals, key=lambda t: (t[1] is None, -(t[1] or 0.0)))


def engineer(df: DataFrame, target: str | None, levels: dict | None = None) -> FeatureResult:
    """H1-H4 in the reference's order."""
    report = []
    if target is not None:
        report.append(("separate_target", target))
        feats = [c for c in df.columns if c != target]
    else:
        report.append(("no_target", None))
        feats = list(df.columns)
    x = df
    cats = [c for c in string_columns(df) if c in feats]
    levels_used = {}
    if cats:
        x, levels_used = one_hot(df, cats, levels)
        report.append(("one_hot", ",".join(cats)))
    feats = [c for c in x.columns if c != target]
    num = [c for c in numeric_columns(x) if c != target]
    res = FeatureResult(x, feats, report, levels_used)
    if target is None or not is_numeric(x.schema[target].dataType):
        return res
    ranked = correlation_with(x, num, target)
    if len(num) >= 2 and len(ranked) >= 2:
        a, b = ranked[0][0], ranked[1][0]
        name = f"{a}_x_{b}"
        x = x.withColumn(name, F.col(a) * F.col(b))
        res.interaction = (a, b)
        report.append(("interaction", name))
    if num and ranked and ranked[0][1] is not None:
        top = ranked[0][0]
        x = x.withColumn(f"{top}_squared", F.col(top) * F.col(top))
        res.square = top
        report.append(("square", f"{top}_squared"))
    res.data = x
    res.features = [c for c in x.columns if c != target]
    res.report = report
    return res


def feature_report(spark, result: FeatureResult) -> DataFrame:
    """H4 as a table."""
    return spark.createDataFrame([(i, a, d) for i, (a, d) in enumerate(result.report)],
                                 "step int, action string, detail string")

"""Exploratory views.  Each returns the data behind a chart as a
DataFrame (drawing is left to the caller).

Scale rules followed here: statistics for all requested columns come out of
one aggregate pass; binning is an expression plus one grouped count; KDE sums
are made per task in arrays, so no grid x data product is materialised;
samples are top-n by a seeded
hash, so exactly n rows leave each task whatever the partitioning.
"""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import attach, average_ranks
from ..functions.scalar import as_label, sqrt_abs
from ..functions.stats import grouped_quantiles, quantiles
from .profile import _stack, correlation_long, top_values, value_counts
from .schema import distinct_counts, existing, is_numeric, numeric_columns

SQRT_2PI = math.sqrt(2.0 * math.pi)
QQ_PIECE = 10_000    # ranks that one row expands to at most


class ViewRefused(ValueError):
    """A guard of the reference refused the view (too many groups, wrong types)."""


# ------------------------------------------------------------------ helpers
def seeded_sample(df: DataFrame, n: int, seed: int = 42, key_cols: list[str] | None = None) -> DataFrame:
    """At most n rows chosen by a seeded hash of whole rows; a top-n
    sort keeps n rows per task before the single merge."""
    cols = key_cols or df.columns
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])
    return df.withColumn("__h", h).orderBy("__h", *cols).limit(n).drop("__h")


def _numeric_stats(df: DataFrame, cols: list[str], with_quartiles: bool = True) -> dict[str, dict]:
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                 F.stddev_samp(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    q = quantiles(df, cols, [0.25, 0.5, 0.75]) if with_quartiles else {}
    out = {}
    for i, c in enumerate(cols):
        out[c] = {"n": row[f"n{i}"], "lo": row[f"lo{i}"], "hi": row[f"hi{i}"], "std": row[f"s{i}"]}
        if with_quartiles:
            out[c].update(q1=q[c][0], median=q[c][1], q3=q[c][2])
    return out


def auto_bins(n: int, lo: float, hi: float, q1: float, q3: float) -> tuple[int, float, float]:
    """numpy 'auto' bin rule: the smaller of the Sturges and Freedman-Diaconis
    widths (Sturges alone when the IQR is 0).  Returns (bins, first_edge,
    last_edge)."""
    if n == 0 or lo is None:
        return 0, 0.0, 0.0
    if hi == lo:
        return 1, lo - 0.5, hi + 0.5
    rng = hi - lo
    sturges = rng / (math.log2(n) + 1.0)
    fd = 2.0 * (q3 - q1) * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd > 0 else sturges
    return max(1, int(math.ceil(rng / width))), lo, hi


def _bin_expr(x: Column, bins: int, lo: float, hi: float) -> Column:
    """numpy histogram: equal bins on [lo, hi], the last one closed."""
    idx = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)).cast("long")
    return F.least(idx, F.lit(bins - 1))


# ------------------------------------------------------------------ D9, E1
def correlation(df: DataFrame, method: str = "pearson", cols: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, corr) for every ordered pair of numeric columns.
    Spearman correlates average ranks (E1) of each column."""
    cols = cols if cols is not None else numeric_columns(df)
    if len(cols) < 2:
        raise ViewRefused("correlation needs two numeric columns")
    if method not in ("pearson", "spearman"):
        method = "pearson"
    if method == "pearson":
        return correlation_long(df, cols)
    nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(f"z{i}") for i, c in enumerate(cols)]).first()
    holed = [c for i, c in enumerate(cols) if nulls[f"z{i}"]]
    whole = [c for c in cols if c not in holed]
    parts = [_rank_correlation(df, whole)] if whole else []
    # a pair is ranked over its own complete rows, so pairs with a column that has nulls go one by one
    for i, a in enumerate(cols):
        for b in cols[i:]:
            if a in holed or b in holed:
                both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
                one = _rank_correlation(both, [a] if a == b else [a, b])
                parts.append(one if a == b else one.filter("col_a <> col_b"))
    return reduce(DataFrame.unionByName, parts)


def _rank_correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of the average ranks of columns without nulls."""
    ranked = df.select(*cols)
    for c in cols:
        ranked = attach(ranked, average_ranks(df, c, out=f"__rk_{c}"), c)
    return correlation_long(ranked.select([F.col(f"__rk_{c}").alias(c) for c in cols]), cols)


# ------------------------------------------------------------------ D10, D22
def histogram(df: DataFrame, cols: list[str] | str, bins: int | str = "auto") -> DataFrame:
    """(column_name, bin, lo, hi, count) for one or many numeric
    columns, empty bins included; all columns in one grouped count."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    cols = [c for c in cols if is_numeric(df.schema[c].dataType)]
    if not cols:
        raise ViewRefused("histogram needs a numeric column")
    st = _numeric_stats(df, cols, with_quartiles=(bins == "auto"))
    spec = {}
    for c in cols:
        s = st[c]
        if s["n"] == 0:
            continue
        if bins == "auto":
            spec[c] = auto_bins(s["n"], s["lo"], s["hi"], s["q1"], s["q3"])
        else:
            b = int(bins)
            lo, hi = (s["lo"] - 0.5, s["hi"] + 0.5) if s["lo"] == s["hi"] else (s["lo"], s["hi"])
            spec[c] = (b, lo, hi)
    spark = df.sparkSession
    if not spec:
        return spark.createDataFrame([], "column_name string, bin bigint, lo double, hi double, count bigint")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 _bin_expr(F.col(c).cast("double"), *spec[c]).alias("bin"))
        for c in spec])).alias("kv")).select("kv.*").filter(F.col("bin").isNotNull())
    counts = long.groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = spark.createDataFrame(
        [(c, i, b[1] + (b[2] - b[1]) * i / b[0], b[1] + (b[2] - b[1]) * (i + 1) / b[0])
         for c, b in spec.items() for i in range(b[0])],
        "column_name string, bin bigint, lo double, hi double")
    return (grid.join(counts, ["column_name", "bin"], "left")
            .select("column_name", "bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


# ------------------------------------------------------------------ D11, D13
def kde(df: DataFrame, col: str, gridsize: int = 200, cut: float = 3.0, by: str | None = None) -> DataFrame:
    """Gaussian KDE with Scott's bandwidth (std * n^-1/5) on a grid
    from min - cut*bw to max + cut*bw.  Values are first grouped (a hot value
    is one row with a weight); a task sums its values for every grid point in
    arrays, so it emits one row per grid point and batch, never grid x values."""
    x = F.col(col).cast("double")
    keys = [by] if by else []
    weighted = df.filter(x.isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("__w"))
    stats = df.filter(x.isNotNull()).groupBy(*keys).agg(
        F.count(x).alias("__n"), F.stddev_samp(x).alias("__sd"), F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    stats = stats.withColumn("__bw", F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2)))
    stats = stats.filter(F.col("__bw") > 0).withColumn("__g0", F.col("__lo") - cut * F.col("__bw")).withColumn(
        "__step", ((F.col("__hi") + cut * F.col("__bw")) - F.col("__g0")) / F.lit(gridsize - 1))
    if keys:
        # one row per group (callers check the group count): broadcast join
        j = weighted.join(F.broadcast(stats), keys, "inner")
    else:
        s = stats.first()
        if s is None:
            return df.sparkSession.createDataFrame([], "grid_index int, x double, density double")
        j = weighted.select("*", *[F.lit(s[k]).alias(k) for k in ("__n", "__bw", "__g0", "__step")])
    gk = [*keys, "__n", "__bw", "__g0", "__step"]
    j = j.select(*gk, F.col(col).cast("double").alias("__v"), "__w")

    def partial(frames):
        steps = np.arange(gridsize)
        for pdf in frames:
            for key, part in pdf.groupby(gk, dropna=False, sort=False):
                bw, g0, step = key[-3:]
                sums = np.zeros(gridsize)
                for i in range(0, len(part), 4096):
                    v, w = part["__v"].to_numpy()[i:i + 4096], part["__w"].to_numpy()[i:i + 4096]
                    sums += np.exp(-0.5 * ((g0 + steps[:, None] * step - v[None, :]) / bw) ** 2) @ w
                out = pd.DataFrame({"grid_index": steps, "__d": sums})
                for name, value in zip(gk, key):
                    out[name] = value
                yield out[[*gk, "grid_index", "__d"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in j.schema.fields if f.name in gk)
    sums = (j.mapInPandas(partial, f"{fields}, grid_index int, __d double")
            .groupBy(*gk, "grid_index").agg(F.sum("__d").alias("__s")))
    return sums.select(*keys, "grid_index",
                       (F.col("__g0") + F.col("grid_index") * F.col("__step")).alias("x"),
                       (F.col("__s") / (F.col("__n") * F.col("__bw") * F.lit(SQRT_2PI))).alias("density"))


def distribution_grid(df: DataFrame, cols: list[str], bins: int | str = "auto", gridsize: int = 200) -> DataFrame:
    """(column_name, kind, position, x, value): the histogram (x = middle of
    the bin, value = count) and the density of every column, one job each for
    all columns together."""
    cols = [c for c in cols if is_numeric(df.schema[c].dataType)]
    bars = histogram(df, cols, bins).select(
        "column_name", F.lit("histogram").alias("kind"), F.col("bin").cast("long").alias("position"),
        ((F.col("lo") + F.col("hi")) / 2).alias("x"), F.col("count").cast("double").alias("value"))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols]))
                     .alias("kv")).select("kv.*")
    lines = kde(long, "v", gridsize, by="column_name").select(
        "column_name", F.lit("density").alias("kind"), F.col("grid_index").cast("long").alias("position"), "x",
        F.col("density").alias("value"))
    return bars.unionByName(lines)


def violin(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Density over 100 grid points (cut 2) with the quartiles of each
    group.  The caller bounds the number of groups."""
    density = kde(df, col, 100, 2.0, by=by)
    box = box_stats(df, [col], by).select("group", "q1", "median", "q3")
    density = density.withColumn("group", as_label(F.col(by)) if by else F.lit(None).cast("string"))
    on = density["group"].eqNullSafe(box["group"])
    return density.join(box, on).select(density["group"], "grid_index", "x", "density", "q1", "median", "q3")


# ------------------------------------------------------------------ D12, D21, B13
def box_stats(df: DataFrame, cols: list[str], by: str | None = None, limit_cols: int | None = 6) -> DataFrame:
    """Quartiles, whiskers (extreme data inside 1.5 IQR) and flier
    counts per numeric column (and per group of ``by``)."""
    cols = [c for c in cols if is_numeric(df.schema[c].dataType)][:limit_cols]
    if not cols:
        raise ViewRefused("box plot needs a numeric column")
    if by is None:
        q = quantiles(df, cols, [0.25, 0.5, 0.75])
        aggs, pairs = [], []
        for i, c in enumerate(cols):
            q1, med, q3 = q[c]
            if q1 is None:
                continue
            x, lo_f, hi_f = F.col(c).cast("double"), q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            aggs += [F.min(F.when(x >= lo_f, x)).alias(f"lo{i}"), F.max(F.when(x <= hi_f, x)).alias(f"hi{i}"),
                     F.count(F.when((x < lo_f) | (x > hi_f), 1)).alias(f"f{i}"), F.count(x).alias(f"n{i}")]
            pairs.append((c, [F.lit(None).cast("string"), F.lit(q1), F.lit(med), F.lit(q3),
                              *[F.col(f"{k}{i}") for k in ("lo", "hi", "f", "n")]]))
        if not pairs:
            raise ViewRefused("no value in the numeric columns")
        return df.agg(*aggs).select(_stack(pairs, ["column_name", "group", "q1", "median", "q3", "whisker_lo",
                                                   "whisker_hi", "n_fliers", "n"]))
    # grouped: exact quartiles from ranges of (group, value)
    x = F.col(cols[0]).cast("double")
    qs = grouped_quantiles(df, by, cols[0], [0.25, 0.5, 0.75]).toDF(by, "q1", "median", "q3")
    j = df.join(qs, [by], "inner").filter(x.isNotNull())
    lo_f = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return j.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(x >= lo_f, x)).alias("whisker_lo"),
        F.max(F.when(x <= hi_f, x)).alias("whisker_hi"),
        F.count(F.when((x < lo_f) | (x > hi_f), 1)).alias("n_fliers"),
        F.count(x).alias("n")).select(
        F.lit(cols[0]).alias("column_name"), as_label(F.col(by)).alias("group"), "q1", "median", "q3",
        "whisker_lo", "whisker_hi", "n_fliers", "n")


def outlier_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column the IQR fences and inlier / outlier counts
    (strictly outside the fences is an outlier)."""
    cols = [c for c in (cols or []) if is_numeric(df.schema[c].dataType)][:6] or numeric_columns(df)[:6]
    if not cols:
        raise ViewRefused("no numeric column")
    q = quantiles(df, cols, [0.25, 0.75])
    aggs, pairs = [], []
    for i, c in enumerate(cols):
        q1, q3 = q[c]
        if q1 is None:
            continue
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        x = F.col(c).cast("double")
        aggs += [F.count(F.when((x >= lo) & (x <= hi), 1)).alias(f"i{i}"),
                 F.count(F.when((x < lo) | (x > hi), 1)).alias(f"o{i}")]
        pairs.append((c, [F.lit(q1), F.lit(q3), F.lit(lo), F.lit(hi), F.col(f"i{i}"), F.col(f"o{i}")]))
    return df.agg(*aggs).select(_stack(pairs, ["column_name", "q1", "q3", "lo", "hi", "n_inliers", "n_outliers"]))


def outlier_rows(df: DataFrame, col: str) -> DataFrame:
    """Rows of ``df`` with an ``is_outlier`` flag for ``col``."""
    q1, q3 = quantiles(df, [col], [0.25, 0.75])[col]
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    x = F.col(col).cast("double")
    return df.withColumn("is_outlier", (x < lo) | (x > hi))


# ------------------------------------------------------------------ D14, D15, D19
def group_bar(df: DataFrame, cat: str, num: str, estimator: str = "mean", max_groups: int = 30) -> DataFrame:
    """Mean / sum / count of ``num`` per ``cat`` group, the null group
    kept, descending; refused over ``max_groups`` groups."""
    if estimator not in ("mean", "sum", "count"):
        estimator = "mean"
    if distinct_counts(df, [cat])[cat] > max_groups:
        raise ViewRefused(f"{cat} has more than {max_groups} groups")
    x = F.col(num).cast("double")
    f = {"mean": F.avg(x), "sum": F.coalesce(F.sum(x), F.lit(0.0)), "count": F.count(x).cast("double")}[estimator]
    return df.groupBy(F.col(cat).cast("string").alias("group")).agg(f.alias("value")).select(
        "group", F.lit(estimator).alias("estimator"), "value")


def count_top(df: DataFrame, col: str, top_n: int = 15) -> DataFrame:
    """Counts of the ``top_n`` most frequent values (as text)."""
    return top_values(df, [col], k=top_n).select(F.col("value"), "count", "rank")


def pie(df: DataFrame, col: str, top_n: int = 8) -> DataFrame:
    """Top-n counts and each one's share of the shown total."""
    t = count_top(df, col, top_n)
    return t.select("value", "count", "rank",
                    (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("share"))


# ------------------------------------------------------------------ D16, D17, D18
def scatter(df: DataFrame, x: str, y: str, hue: str | None = None, n: int = 2000, seed: int = 42) -> DataFrame:
    """At most n points."""
    cols = [x, y] + ([hue] if hue and hue in df.columns else [])
    return seeded_sample(df.select(*cols), n, seed)


def line(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Mean of y per x (and hue) with a normal 95 % interval."""
    keys = [x] + ([hue] if hue and hue in df.columns else [])
    yy = F.col(y).cast("double")
    return df.groupBy(*keys).agg(F.avg(yy).alias("mean"), F.count(yy).alias("n"),
                                 F.stddev_samp(yy).alias("__sd")).select(
        *keys, "mean", "n", (F.lit(1.96) * F.col("__sd") / F.sqrt(F.col("n"))).alias("ci"))


def pairplot(df: DataFrame, cols: list[str], hue: str | None = None, n: int = 500, seed: int = 42,
             max_cols: int = 5) -> DataFrame:
    """Long (x_col, y_col, x, y, hue) over a sample of complete rows."""
    max_cols = min(max_cols, 6)
    use = existing(df, cols)[:max_cols] or numeric_columns(df)[:max_cols]
    if not use:
        raise ViewRefused("no columns")
    keep = use + ([hue] if hue and hue in df.columns and hue not in use else [])
    sample = seeded_sample(df.select(*keep).na.drop(), n, seed).withColumn("__row", F.monotonically_increasing_id())
    pairs = []
    for a in use:
        for b in use:
            pairs.append((a, [F.lit(b), F.col(a).cast("double"), F.col(b).cast("double")]))
    hue_col = [as_label(F.col(hue)).alias("hue")] if hue and hue in df.columns else [F.lit(None).cast("string").alias("hue")]
    return sample.select("__row", *hue_col, _stack(pairs, ["x_col", "y_col", "x", "y"])).drop("__row")


# ------------------------------------------------------------------ D20, D24
def crosstab(df: DataFrame, a: str, b: str, normalize: bool = False) -> DataFrame:
    """Counts of (a, b), optionally as shares of each ``a`` row;
    refused over 20 x 10 values."""
    d = distinct_counts(df, [a, b])
    if d[a] > 20 or d[b] > 10:
        raise ViewRefused("too many values for a crosstab")
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    counts = both.groupBy(F.col(a).cast("string").alias("row_value"), F.col(b).cast("string").alias("col_value")).agg(
        F.count(F.lit(1)).alias("count"))
    # at most 20 x 10 cells: empty ones count 0
    counts = counts.collect()
    cells = {(r["row_value"], r["col_value"]): r["count"] for r in counts}
    rows = [(x, y, cells.get((x, y), 0)) for x in sorted({x for x, _ in cells}) for y in sorted({y for _, y in cells})]
    g = df.sparkSession.createDataFrame(rows, "row_value string, col_value string, count bigint")
    share = F.col("count") / F.sum("count").over(Window.partitionBy("row_value"))
    return g.select("row_value", "col_value", "count",
                    (share if normalize else F.col("count").cast("double")).alias("value"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Count and share per class (classes as text)."""
    vc = value_counts(df, [target], as_label=True)
    return vc.select(F.col("value").alias("class"), "count",
                     (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("share"))


# ------------------------------------------------------------------ D23, D25-D27
def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line over complete rows (one row: slope, intercept)."""
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    return df.agg(F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("intercept"),
                  F.regr_count(yy, xx).alias("n"))


def residuals(df: DataFrame, feat: str, target: str) -> DataFrame:
    """Fitted value and residual per complete row of (feat, target);
    the one-row fit is broadcast."""
    sub = df.select(F.col(feat).cast("double").alias("x"), F.col(target).cast("double").alias("y")).na.drop()
    fit = line_fit(sub, "x", "y").first()
    fitted = F.lit(fit["slope"]) * F.col("x") + F.lit(fit["intercept"])
    return sub.select("x", "y", fitted.alias("fitted"), (F.col("y") - fitted).alias("residual"))


def residual_histogram(df: DataFrame, feat: str, target: str, bins: int | str = "auto") -> DataFrame:
    """Histogram of the residuals of the one-feature line."""
    return histogram(residuals(df, feat, target), ["residual"], bins)


def scale_location(df: DataFrame, feat: str, target: str) -> DataFrame:
    """sqrt(|residual|) against fitted."""
    r = residuals(df, feat, target)
    return r.select("fitted", sqrt_abs("residual").alias("sqrt_abs_residual"))


def target_vs_feature(df: DataFrame, feat: str, target: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """num/num -> sampled points plus the fitted trend (on all rows);
    cat/num -> box per category (20 or fewer); num/cat -> box per class
    (10 or fewer); cat/cat -> refused."""
    fnum, tnum = is_numeric(df.schema[feat].dataType), is_numeric(df.schema[target].dataType)
    if fnum and tnum:
        sub = df.select(feat, target).na.drop()
        fit = line_fit(sub, feat, target).first()
        pts = seeded_sample(sub, n, seed)
        return pts.select(F.col(feat).cast("double").alias("x"), F.col(target).cast("double").alias("y"),
                          (F.lit(fit["slope"]) * F.col(feat) + F.lit(fit["intercept"])).alias("trend"))
    if not fnum and tnum:
        if distinct_counts(df, [feat])[feat] > 20:
            raise ViewRefused("too many categories")
        return box_stats(df, [target], by=feat)
    if fnum and not tnum:
        if distinct_counts(df, [target])[target] > 10:
            raise ViewRefused("too many classes")
        return box_stats(df, [feat], by=target)
    raise ViewRefused("categorical vs categorical is not drawn")


def qq_points(df: DataFrame, feat: str, target: str) -> DataFrame:
    """Ordered residuals of the one-feature line against normal quantiles."""
    return qq_of(residuals(df, feat, target))


def qq_of(r: DataFrame) -> DataFrame:
    """Ordered values of ``residual`` against normal order-statistic
    medians (Filliben).  Ordinal ranks come from running counts over distinct
    residual values, so the global order never sits in one task."""
    from ..functions.normal import inv_norm
    from ..functions.ranks import running_sums
    g = r.groupBy("residual").agg(F.count(F.lit(1)).alias("__c"))
    cum = running_sums(g, "residual", ["__c"])
    n = r.count()
    # a value with many copies is cut into pieces that spread over the tasks before they become rows
    first, last_i = F.col("cum___c") - F.col("__c") + 1, F.col("cum___c")
    pieces = cum.select("residual", last_i.alias("last"), F.explode(F.sequence(first, last_i, F.lit(QQ_PIECE).cast("long"))).alias("a"))
    rows = pieces.repartition("a").select("residual", F.explode(F.sequence(
        F.col("a"), F.least(F.col("a") + QQ_PIECE - 1, F.col("last")))).alias("i"))
    i = F.col("i").cast("double")
    last = 0.5 ** (1.0 / n) if n else 0.5
    m = (F.when(F.col("i") == n, F.lit(last)).when(F.col("i") == 1, F.lit(1.0 - last))
         .otherwise((i - 0.3175) / (n + 0.365)))
    return rows.select(F.col("i").cast("bigint").alias("i"), inv_norm(m).alias("theoretical"),
                       F.col("residual").alias("ordered"))


def feature_variance(df: DataFrame, target: str | None = None) -> DataFrame:
    """Variance of each standardised numeric column after median fill,
    next to the raw population variance, ascending."""
    cols = [c for c in numeric_columns(df) if c != target]
    if not cols:
        raise ViewRefused("no numeric column")
    med = {c: v[0] for c, v in quantiles(df, cols, [0.5]).items()}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c in cols}
    first = df.agg(*[F.avg(filled[c]).alias(f"m{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(filled[c]).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    aggs = []
    for i, c in enumerate(cols):
        m, sd = first[f"m{i}"], first[f"s{i}"]
        x = filled[c] - F.lit(m)
        aggs += [F.var_pop(x / F.lit(sd) if sd else x).alias(f"z{i}"), F.var_pop(x).alias(f"v{i}")]
    pairs = [(c, [F.col(f"z{i}"), F.col(f"v{i}")]) for i, c in enumerate(cols)]
    return df.agg(*aggs).select(_stack(pairs, ["column_name", "scaled_variance", "raw_variance"])).orderBy(
        F.round("scaled_variance", 9), "column_name")


# ------------------------------------------------------------------ B12, F6, H2/H3 long form
def rows_in_top(df: DataFrame, col: str, top_n: int = 15) -> DataFrame:
    """Rows whose value (as text) is among the ``top_n`` most
    frequent; the top list has top_n rows, so it is broadcast."""
    top = top_values(df, [col], k=top_n).select(F.col("value").alias("__v"))
    return df.join(F.broadcast(top), as_label(F.col(col)) == F.col("__v"), "left_semi")


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """distinct values of a column, sorted (for an input form)."""
    return df.select(F.col(col).alias("value")).filter(F.col("value").isNotNull()).distinct().orderBy("value")


def engineered_long(df: DataFrame, target: str, key: list[str], which: str) -> DataFrame:
    """H2/H3 as (key..., feature, value) for the SQL check."""
    from .features import engineer
    res = engineer(df, target)
    if which == "interaction":
        a, b = res.interaction
        name = f"{a}_x_{b}"
    else:
        name = f"{res.square}_squared"
    return res.data.select(*key, F.lit(name).alias("feature"), F.col(name).cast("double").alias("value"))

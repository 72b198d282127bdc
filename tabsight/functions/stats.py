"""Statistics used by many operators: exact quantiles that scale, moments,
pairwise-complete correlation.

Exact quantiles.  All columns are unpivoted and grouped by (column, value), so
a hot value is one row; the grouped rows are range-partitioned by (column,
value) and kept once; totals per partition (one row per column and partition)
tell which rows hold the wanted ranks.  Nothing is estimated, no values reach
the driver but the wanted ones, and the steps are the same at every size.
Results equal pandas' linear interpolation (``quantile_cont``).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranged


def grouped_quantiles(df: DataFrame, by: str, col: str, probs: list[float]) -> DataFrame:
    """(by, q0, q1, ...) exact quantiles of ``col`` for any number of groups, by
    the same ranges keyed by (group, value): a group with all rows is many
    ranges, and nothing reaches the driver.  Groups without a value are absent."""
    v = F.col(col).cast("double")
    grouped = df.select(F.col(by).alias("g"), v.alias("v")).filter(F.col("v").isNotNull()).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    rows = ranged(grouped, "g", "v")
    parts = rows.groupBy("g", "__part").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("g").alias("og"), F.col("__part").alias("op"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("below"),
                           F.sum("m").over(Window.partitionBy("g")).alias("total"))
    inside = Window.partitionBy("g", "__part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("n").over(inside))
    placed = placed.join(offsets, placed["g"].eqNullSafe(offsets["og"]) & (placed["__part"] == offsets["op"]))
    placed = placed.withColumn("upto", F.col("upto") + F.col("below"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto")), F.col("v")))

    spots = {j: F.lit(float(p)) * (F.col("total") - 1) for j, p in enumerate(probs)}
    found = placed.groupBy("g").agg(F.max("total").alias("total"), *[
        c for j, s in spots.items() for c in (at(F.floor(s)).alias(f"a{j}"), at(F.least(F.floor(s) + 1, F.col("total") - 1)).alias(f"b{j}"))])
    step = {j: s - F.floor(s) for j, s in spots.items()}
    return found.select(F.col("g").alias(by), *[
        F.when(F.col(f"a{j}") == F.col(f"b{j}"), F.col(f"a{j}")).otherwise(
            (1.0 - w) * F.col(f"a{j}") + w * F.col(f"b{j}")).alias(f"q{j}") for j, w in step.items()])


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact, pandas-compatible quantiles of several numeric columns."""
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("v"))
                                         for i, c in enumerate(cols)])).alias("kv")).select("kv.*")
    grouped = long.filter(F.col("v").isNotNull()).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    rows = ranged(grouped, "k", "v")
    parts = rows.groupBy("k", "__part").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("k").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("k")
    offsets = parts.select("k", "__part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("below"),
                           F.sum("m").over(every).alias("total"))
    inside = Window.partitionBy("k", "__part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (rows.withColumn("upto", F.sum("n").over(inside))
              .join(F.broadcast(offsets), ["k", "__part"])     # one row per column and shuffle partition
              .withColumn("upto", F.col("upto") + F.col("below")))
    position = lambda p: F.lit(float(p)) * (F.col("total") - 1)
    wanted = F.array(*[F.struct(F.lit(j).alias("j"), rank.cast("long").alias("r")) for j, p in enumerate(probs)
                       for rank in (F.floor(position(p)), F.least(F.floor(position(p)) + 1, F.col("total") - 1))])
    hit = F.filter(wanted, lambda w: (w["r"] >= F.col("upto") - F.col("n")) & (w["r"] < F.col("upto")))
    found = placed.select("k", "v", "total", F.explode(hit).alias("w")).select("k", "v", "total", "w.j", "w.r").collect()
    at, total = {}, {}
    for row in found:
        at[(row["k"], row["j"], row["r"])] = row["v"]
        total[row["k"]] = row["total"]
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        if i not in total:
            out[c] = [None] * len(probs)
            continue
        out[c] = []
        for j, p in enumerate(probs):
            pos = p * (total[i] - 1)
            lo = int(math.floor(pos))
            a, b = at[(i, j, lo)], at[(i, j, min(lo + 1, total[i] - 1))]
            out[c].append(a if a == b else (lo + 1 - pos) * a + (pos - lo) * b)
    return out


def adjusted_skewness(c) -> Column:
    """Bias-adjusted sample skewness (pandas ``skew``):
    g1 * sqrt(n(n-1)) / (n-2); null under 3 values or for a constant."""
    x = F.col(c) if isinstance(c, str) else c
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def correlation_row(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of many column pairs as one row (columns r0, r1, ...).

    Pass 1 (eager, d aggregates) gets each column's mean and null count.
    Pass 2 is plain sums of mean-shifted values (cheap in generated code and
    numerically safe): per-column sums when a pair has no nulls, per-pair
    conditional sums (pairwise-complete rows) when it does.  A constant
    column gives null."""
    cols = sorted({c for p in pairs for c in p})
    head = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)],
                  *[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(cols)]).first()
    idx = {c: i for i, c in enumerate(cols)}
    mean = {c: head[f"m_{idx[c]}"] or 0.0 for c in cols}
    full = {c: head[f"n_{idx[c]}"] == head["__n"] for c in cols}
    dev = {c: F.col(c).cast("double") - F.lit(mean[c]) for c in cols}
    aggs, exprs = {}, []

    def need(name, expr):
        if name not in aggs:
            aggs[name] = expr.alias(name)
        return F.col(name)

    for k, (a, b) in enumerate(pairs):
        ia, ib = idx[a], idx[b]
        if full[a] and full[b]:
            n = need("__cnt", F.count(F.lit(1)).cast("double"))
            sa, sb = need(f"s_{ia}", F.sum(dev[a])), need(f"s_{ib}", F.sum(dev[b]))
            qa, qb = need(f"q_{ia}", F.sum(dev[a] * dev[a])), need(f"q_{ib}", F.sum(dev[b] * dev[b]))
            lo, hi = min(ia, ib), max(ia, ib)
            pab = need(f"p_{lo}_{hi}", F.sum(dev[cols[lo]] * dev[cols[hi]]))
        else:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            da, db = F.when(both, dev[a]), F.when(both, dev[b])
            lo, hi = min(ia, ib), max(ia, ib)
            n = need(f"cn_{lo}_{hi}", F.count(F.when(both, 1)).cast("double"))
            sa, sb = need(f"cs_{ia}_{ib}", F.sum(da)), need(f"cs_{ib}_{ia}", F.sum(db))
            qa, qb = need(f"cq_{ia}_{ib}", F.sum(da * da)), need(f"cq_{ib}_{ia}", F.sum(db * db))
            pab = need(f"cp_{lo}_{hi}", F.sum(da * db))
        va = qa - sa * sa / n
        vb = qb - sb * sb / n
        cov = pab - sa * sb / n
        denom = F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0)))
        exprs.append((cov / F.nullif(denom, F.lit(0.0))).alias(f"r{k}"))
    if not aggs:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(f"r{k}") for k in range(len(pairs))])
    row = df.agg(*aggs.values())
    # a constant column has a zero (or rounding-level) variance: null like pandas' NaN
    return row.select(*exprs)

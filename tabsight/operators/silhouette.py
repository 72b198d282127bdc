"""K3, K4: exact Euclidean silhouette.

Equal points of a cluster are one weighted point.  Points are dealt into
blocks, and every pair of blocks meets in one task once; a task hands on the sum
of weighted distances per point and cluster (both directions), never pairs.
The work grows with the square of the distinct points, so callers with more
rows than they want to pay for pass ``rows``: a seeded sample of that many (B14).
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .near import distances, point, whole

BLOCK = 2_048


def _sums(clusters: np.ndarray):
    def run(key, pdf):
        x, w, of = np.stack(pdf["x"].to_numpy()), pdf["w"].to_numpy(dtype=float), np.searchsorted(clusters, pdf["cluster"].to_numpy())
        left = pdf["s"].to_numpy() == key[0]
        a, b = np.flatnonzero(left), np.flatnonzero(~left) if key[0] != key[1] else np.flatnonzero(left)
        total = np.zeros((len(pdf), len(clusters)))
        hot = np.zeros((len(pdf), len(clusters)))
        hot[np.arange(len(pdf)), of] = w
        for i in range(0, len(a), 256):
            rows = a[i:i + 256]
            d = distances(x[rows], x[b], 2)
            total[rows] += d @ hot[b]
            if key[0] != key[1]:
                total[b] += d.T @ hot[rows]
        p, c = np.nonzero(total)
        return pd.DataFrame({"rid": pdf["rid"].to_numpy()[p], "other": clusters[c], "total": total[p, c]})
    return run


def silhouette_values(df: DataFrame, features: list[str] | Column, cluster: str = "cluster") -> DataFrame:
    """(x, cluster, w, silhouette): K4, the silhouette of every distinct clustered
    point and how many rows have it; noise (-1) takes no part, a point alone in
    its cluster has 0.  Empty with fewer than two clusters."""
    x = point(features) if isinstance(features, list) else features
    rows = df.select(x.alias("x"), F.col(cluster).cast("long").alias("cluster")).filter(whole(F.col("x")) & (F.col("cluster") != -1))
    points = rows.groupBy("x", "cluster").agg(F.count(F.lit(1)).alias("w"))
    points = cut_lineage(points.withColumn("rid", F.monotonically_increasing_id()))
    size = points.groupBy("cluster").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("points"))
    per = size.orderBy("cluster").limit(100_000).collect()
    if len(per) < 2:
        return points.select("x", "cluster", "w", F.lit(0.0).alias("silhouette")).limit(0)
    if len(per) == 100_000:
        raise ValueError("too many clusters for a silhouette")
    k = max(1, -(-sum(r["points"] for r in per) // BLOCK))
    s = F.pmod(F.xxhash64("rid"), F.lit(k)).cast("int").alias("s")
    cells = points.select("rid", "x", "w", "cluster", s, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("t"))
    cells = cells.select("rid", "x", "w", "cluster", "s", F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi"))
    sums = (cells.groupBy("lo", "hi").applyInPandas(_sums(np.array([r["cluster"] for r in per])), "rid long, other long, total double")
            .groupBy("rid", "other").agg(F.sum("total").alias("total")))
    others = size.select(F.col("cluster").alias("other"), "n")
    # a pair without a sum has distance 0: every point starts with every cluster
    table = points.select("rid", F.explode(F.array(*[F.lit(r["cluster"]) for r in per])).alias("other"), "cluster")
    table = table.join(others, "other").join(sums, ["rid", "other"], "left").fillna(0.0, ["total"])
    own = F.col("other") == F.col("cluster")
    score = table.groupBy("rid").agg(F.max(F.when(own, F.col("n"))).alias("n"),
                                     F.max(F.when(own, F.col("total") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"),
                                     F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    top = F.greatest("a", "b")
    value = F.when((F.col("n") > 1) & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return points.join(score.select("rid", value.alias("silhouette")), "rid").select("x", "cluster", "w", "silhouette")


def silhouette(df: DataFrame, features: list[str] | Column, cluster: str = "cluster", rows: int | None = None, seed: int = 42) -> float:
    """K3 with the rules of J8: the mean over rows, -1 with fewer than two
    clusters or if every row is a cluster of its own."""
    x = point(features) if isinstance(features, list) else features
    d = df.select(x.alias("x"), F.col(cluster).alias("cluster"))
    if rows is not None:
        d = d.orderBy(F.xxhash64(F.lit(seed), "x", "cluster")).limit(rows)
    d = cut_lineage(d)
    n = d.agg(F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("k"), F.count(F.lit(1)).alias("n")).first()
    if n["k"] < 2 or n["k"] >= n["n"]:
        return -1.0
    got = silhouette_values(d, F.col("x")).agg((F.sum(F.col("silhouette") * F.col("w")) / F.sum("w")).alias("s")).first()["s"]
    return -1.0 if got is None else float(got)

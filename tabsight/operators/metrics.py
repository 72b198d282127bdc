"""Evaluation metrics over scored DataFrames.

Everything is an aggregate over (label, prediction/score) columns: a
confusion table for classification (classes^2 rows), running sums over
distinct scores for ROC / PR (``functions.ranks``), per-cluster sums for
the cluster indices.  Only class or cluster lists, which are small by
construction and size-checked, reach the driver.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import running_sums, with_next
from ..functions.stats import quantiles

MAX_CLASSES = 10_000


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """K1: MSE, R2, MAE, RMSE, residual mean and population std; R2 of a
    constant label is 1 for a perfect fit, else 0 (sklearn's finite rule)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    row = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("residual_mean"),
                 F.stddev_pop(e).alias("residual_std"), F.sum(e * e).alias("__sse"),
                 (F.var_pop(y) * F.count(y)).alias("__sst"))
    r2 = (F.when(F.col("__sst") > 0, F.lit(1.0) - F.col("__sse") / F.col("__sst"))
          .when(F.col("__sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return row.select("mse", r2.alias("r2"), "mae", F.sqrt("mse").alias("rmse"), "residual_mean", "residual_std")


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """K2: accuracy and support-weighted precision, recall, F1; a class
    never predicted has precision 0 (zero_division=0)."""
    cc = confusion_counts(df, label, prediction)
    by_true = cc.groupBy(F.col("label").alias("c")).agg(F.sum("count").alias("support"),
                                                       F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count"))
                                                             .otherwise(0)).alias("tp"))
    by_pred = cc.groupBy(F.col("prediction").alias("c")).agg(F.sum("count").alias("predicted"))
    per = by_true.join(by_pred, "c", "left").fillna(0, ["predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.select("support", "tp", prec.alias("p"), rec.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    n = F.sum("support")
    return per.agg((F.sum("tp") / n).alias("accuracy"),
                   (F.sum(F.col("support") * F.col("p")) / n).alias("precision"),
                   (F.sum(F.col("support") * F.col("r")) / n).alias("recall"),
                   (F.sum(F.col("support") * f1) / n).alias("f1"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts for every (true, predicted) pair over the union of the
    labels seen on either side, zeros included."""
    cc = confusion_counts(df, label, prediction)
    labels = sorted({r[0] for r in cc.select("label").union(cc.select("prediction")).distinct()
                     .limit(MAX_CLASSES + 1).collect()}, key=lambda v: (v is None, v))
    if len(labels) > MAX_CLASSES:
        raise ValueError("too many classes for a confusion matrix")
    lit_labels = F.array(*[F.lit(v) for v in labels])
    grid = cc.sparkSession.range(1).select(F.explode(lit_labels).alias("label")).select(
        "label", F.explode(lit_labels).alias("prediction"))
    return grid.join(cc, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def _score_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("tp"), F.sum((1 - F.col(y)).cast("long")).alias("fp"))


def binary_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Per distinct score (descending), cumulative true / false
    positives; the basis of ROC and PR curves."""
    g = _score_counts(df, y, score)
    return running_sums(g, "score", ["tp", "fp"], descending=True)


def roc_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, plus the origin."""
    cur = binary_curve(df, y, score)
    tot = df.agg(F.sum(F.col(y).cast("long")).alias("P"), F.sum((1 - F.col(y)).cast("long")).alias("N")).first()
    P, N = tot["P"] or 0, tot["N"] or 0
    pts = cur.select(F.col("score").alias("threshold"),
                     (F.col("cum_fp") / F.lit(N) if N else F.lit(None).cast("double")).alias("fpr"),
                     (F.col("cum_tp") / F.lit(P) if P else F.lit(None).cast("double")).alias("tpr"))
    origin = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                              F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def thinned(curve: DataFrame) -> DataFrame:
    """The rows of ``binary_curve`` without those between two equal steps: the
    lines through the rest, and the areas under them, are the same."""
    rows = with_next(curve, "score", ["tp", "fp"], descending=True)
    corner = F.col("next_tp").isNull() | (F.col("next_tp") != F.col("tp")) | (F.col("next_fp") != F.col("fp"))
    first = F.col("cum_tp") + F.col("cum_fp") == F.col("tp") + F.col("fp")
    return rows.filter(corner | first).drop("next_tp", "next_fp")


def micro_curves(df: DataFrame, label: str, scores: str, classes: list) -> DataFrame:
    """(threshold, fpr, tpr, precision, recall) at the corners of the curve
    of the flattened one-vs-rest matrix."""
    cur = binary_curve(flatten_scores(df, label, scores, classes), "y", "score")
    total = cur.agg(F.sum("tp").alias("p"), F.sum("fp").alias("n")).first()
    share = lambda c, n: F.col(c) / F.lit(n) if n else F.lit(None).cast("double")
    return thinned(cur).select(F.col("score").alias("threshold"), share("cum_fp", total["n"]).alias("fpr"),
                               share("cum_tp", total["p"]).alias("tpr"),
                               (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"),
                               share("cum_tp", total["p"]).alias("recall"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC (trapezoids; ties at a score form one step)."""
    cur = binary_curve(df, y, score)
    before = F.col("cum_tp") - F.col("tp")
    return cur.agg((F.sum(F.col("fp") * (2 * before + F.col("tp"))) /
                    (2.0 * F.sum("tp") * F.sum("fp"))).alias("auc"))


def average_precision(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """AP = sum over thresholds of (recall step) x precision."""
    cur = binary_curve(df, y, score)
    prec = F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    return cur.agg((F.sum(F.col("tp") * prec) / F.sum("tp")).alias("average_precision"))


def pr_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, precision, recall) per distinct score."""
    cur = binary_curve(df, y, score)
    P = df.agg(F.sum(F.col(y).cast("long"))).first()[0] or 0
    return cur.select(F.col("score").alias("threshold"),
                      (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"),
                      (F.col("cum_tp") / F.lit(P) if P else F.lit(None).cast("double")).alias("recall"))


def calibration(df: DataFrame, y: str = "y", prob: str = "prob", n_bins: int = 10) -> DataFrame:
    """Quantile bins of the clipped probability (edges = exact
    quantiles; a value equal to an inner edge falls in the lower bin, so
    ties share a bin); empty bins are absent."""
    p = F.least(F.greatest(F.col(prob).cast("double"), F.lit(0.0)), F.lit(1.0))
    d = df.select(F.col(y).cast("double").alias("__y"), p.alias("__p"))
    probs = [i / n_bins for i in range(1, n_bins)]
    edges = quantiles(d, ["__p"], probs)["__p"]
    bin_id = sum((F.col("__p") > F.lit(e)).cast("int") for e in edges) if edges and edges[0] is not None else F.lit(0)
    return d.groupBy(bin_id.alias("bin")).agg(F.avg("__y").alias("prob_true"), F.avg("__p").alias("prob_pred"),
                                             F.count(F.lit(1)).alias("n"))


def flatten_scores(df: DataFrame, label: str, scores: str, classes: list) -> DataFrame:
    """One row per (row, class) with the one-vs-rest indicator and
    that class's score; absent classes still get a column of scores."""
    arr = F.col(scores)
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("c"),
                         F.slice(arr, 1, len(classes)).alias("s"))
    return df.select(F.col(label).alias("__l"), F.explode(pairs).alias("__z")).select(
        (F.col("__l") == F.col("__z.c")).cast("int").alias("y"), F.col("__z.s").cast("double").alias("score"))


def micro_auc_ap(df: DataFrame, label: str, scores: str, classes: list) -> DataFrame:
    """Micro-averaged ROC AUC and AP over the flattened one-vs-rest
    matrix."""
    flat = flatten_scores(df, label, scores, classes)
    cur = binary_curve(flat, "y", "score")
    before = F.col("cum_tp") - F.col("tp")
    prec = F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    return cur.agg((F.sum(F.col("fp") * (2 * before + F.col("tp"))) /
                    (2.0 * F.sum("tp") * F.sum("fp"))).alias("auc"),
                   (F.sum(F.col("tp") * prec) / F.sum("tp")).alias("average_precision"))


# ------------------------------------------------------------------ clusters
def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size per cluster label (-1 = noise)."""
    return df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


def cluster_counts(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """K7: number of clusters (noise excluded) and noise points."""
    s = cluster_sizes(df, cluster)
    return s.agg(F.count(F.when(F.col("cluster") != -1, 1)).alias("n_clusters"),
                 F.coalesce(F.sum(F.when(F.col("cluster") == -1, F.col("size"))), F.lit(0)).cast("bigint")
                 .alias("n_noise"))


def centroids(df: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """K8: (cluster, feature, mean) in long form, noise excluded."""
    g = df.filter(F.col(cluster) != -1).groupBy(F.col(cluster).alias("cluster")).agg(
        *[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)])
    pairs = [(f, [F.col(f"m{i}")]) for i, f in enumerate(features)]
    from .profile import _stack
    return g.select("cluster", _stack(pairs, ["feature", "mean"]))


def _cluster_moments(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    sq = sum(F.col(f).cast("double") * F.col(f).cast("double") for f in features)
    return df.filter(F.col(cluster) != -1).groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(sq).alias("sumsq"),
        *[F.sum(F.col(f).cast("double")).alias(f"s{i}") for i, f in enumerate(features)])


def calinski_harabasz(df: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """K5: between / within dispersion ratio from per-cluster count, sum and
    sum of squares (one grouped pass, k rows)."""
    # sums of squares about the global mean: about zero they cancel far from the origin
    mean = df.filter(F.col(cluster) != -1).agg(*[F.avg(F.col(f).cast("double")).alias(f"m{i}")
                                                 for i, f in enumerate(features)]).first()
    centred = df.select(F.col(cluster).alias("__cl"), *[(F.col(f).cast("double") - F.lit(mean[f"m{i}"] or 0.0)).alias(f"__x{i}")
                                                        for i, f in enumerate(features)])
    m = _cluster_moments(centred, [f"__x{i}" for i in range(len(features))], "__cl")
    d = len(features)
    mean_sq = sum(F.col(f"s{i}") * F.col(f"s{i}") for i in range(d)) / F.col("n")  # n_c * |mu_c|^2
    per = m.select("n", "sumsq", mean_sq.alias("nmu2"), *[F.col(f"s{i}") for i in range(d)])
    tot = per.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum("sumsq").alias("SS"),
                  F.sum("nmu2").alias("NMU2"), *[F.sum(f"s{i}").alias(f"t{i}") for i in range(d)])
    grand = sum(F.col(f"t{i}") * F.col(f"t{i}") for i in range(d)) / F.col("N")
    within = F.col("SS") - F.col("NMU2")
    between = F.col("NMU2") - grand
    return tot.select(F.when((F.col("k") > 1) & (within > 0),
                             (between / (F.col("k") - 1)) / (within / (F.col("N") - F.col("k"))))
                      .otherwise(F.lit(None).cast("double")).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """K6: mean over clusters of the worst (s_i + s_j) / |mu_i - mu_j|, with
    s = mean Euclidean distance to the centroid.  Centroids (k rows) are
    broadcast; the k x k step runs on the k-row table."""
    cen = df.filter(F.col(cluster) != -1).groupBy(F.col(cluster).alias("__c")).agg(
        *[F.avg(F.col(f).cast("double")).alias(f"__m{i}") for i, f in enumerate(features)])
    k = cen.count()
    if k > MAX_CLASSES:
        raise ValueError("too many clusters")
    dist = F.sqrt(sum((F.col(f).cast("double") - F.col(f"__m{i}")) ** 2 for i, f in enumerate(features)))
    s = (df.filter(F.col(cluster) != -1).withColumn("__c", F.col(cluster)).join(F.broadcast(cen), "__c")
         .groupBy("__c").agg(F.avg(dist).alias("__s")))
    per = cen.join(s, "__c").collect()  # k rows, size-checked above
    mu = np.array([[r[f"__m{i}"] for i in range(len(features))] for r in per], dtype=float).reshape(len(per), -1)
    spread = np.array([r["__s"] for r in per], dtype=float)
    worst = []
    for a in range(len(per)):
        gap = np.sqrt(((mu - mu[a]) ** 2).sum(axis=1))
        with np.errstate(divide="ignore"):
            ratio = np.where(gap > 0, (spread + spread[a]) / gap, np.inf)
        worst.append(float(np.delete(ratio, a).max(initial=0.0)))
    val = sum(worst) / len(worst) if len(worst) > 1 else None
    return df.sparkSession.createDataFrame([(val,)], "davies_bouldin double")


def silhouette_points(df: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """K4: every clustered row with its own silhouette (squared Euclidean
    distance, noise excluded).  Mean distances come from the count, mean and
    mean square of each cluster, so no pairs are made; the k rows of cluster
    moments travel with the tasks."""
    rows = df.filter(F.col(cluster) != -1)
    mean = rows.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    x = [F.col(f).cast("double") - F.lit(mean[f"m{i}"] or 0.0) for i, f in enumerate(features)]
    per = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg(sum(c * c for c in x)).alias("q"),
                                    *[F.avg(c).alias(f"a{i}") for i, c in enumerate(x)]).collect()
    if len(per) > MAX_CLASSES:
        raise ValueError("too many clusters")
    ids = np.array([r[cluster] for r in per])
    n, q = np.array([r["n"] for r in per], dtype=float), np.array([r["q"] for r in per], dtype=float)
    mu = np.array([[r[f"a{i}"] for i in range(len(features))] for r in per], dtype=float).reshape(len(per), -1)

    @F.pandas_udf("double")
    def one(own: pd.Series, *cols: pd.Series) -> pd.Series:
        p = np.stack([c.to_numpy(dtype=float) for c in cols], axis=1)
        d = (p * p).sum(1)[:, None] - 2.0 * p @ mu.T + q[None, :]
        at = own.to_numpy()[:, None] == ids[None, :]
        size = (at * n).sum(1)
        a = np.where(size > 1, (at * d * n).sum(1) / np.maximum(size - 1, 1), 0.0)
        b = np.where(at, np.inf, d).min(axis=1, initial=np.inf)
        top = np.maximum(a, b)
        return pd.Series(np.where((size > 1) & np.isfinite(b) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0))

    return rows.withColumn("silhouette", one(F.col(cluster), *x))


def silhouette_sq(df: DataFrame, features_col: str = "features", cluster: str = "cluster") -> float | None:
    """K3 (scalable form): mean silhouette with squared Euclidean distance
    (Spark's evaluator, O(n k)); noise rows excluded, None under 2 clusters."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    d = df.filter(F.col(cluster) != -1)
    if d.select(cluster).distinct().limit(2).count() < 2:
        return None
    ev = ClusteringEvaluator(featuresCol=features_col, predictionCol=cluster,
                             metricName="silhouette", distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(d.withColumn(cluster, F.col(cluster).cast("double"))))


# ------------------------------------------------------------------ F4, K9
def leaderboard(scores: DataFrame, model: str = "model", score: str = "score", order: str = "train_order") -> DataFrame:
    """Models by score (desc, then training order), share of the best
    score and the best flag (strictly greater wins, first on a tie)."""
    w = Window.orderBy(F.col(score).desc_nulls_last(), F.col(order))
    share = F.col(score) / F.greatest(F.max(score).over(Window.partitionBy()), F.lit(1.0))
    r = scores.select(model, score, order, F.row_number().over(w).alias("position"), share.alias("share_of_best"))
    return r.select(model, score, order, F.col("position").cast("bigint").alias("position"), "share_of_best",
                    (F.col("position") == 1).alias("is_best"))

"""Gaussian mixtures with full, tied, diagonal or spherical covariances.

Expectation-maximisation over mergeable sufficient statistics: a round is one
scan in which a task adds up responsibilities, weighted sums and weighted
products; only those numbers are shuffled.  Starts come from k-means, the best
of several is kept, and k and the covariance type are chosen by BIC.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.near import distances, whole
from ..session import cut_lineage

TYPES = ("full", "tied", "diag", "spherical")
RIDGE = 1e-6          # added to variances
STEP = 4_096


class Mixture:
    """Weights (k), means (k x d) and covariances: k x d x d for every type."""

    def __init__(self, kind: str, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray):
        self.kind, self.weights, self.means, self.covariances = kind, weights, means, covariances
        self.log_likelihood, self.n = -math.inf, 0
        lower = np.linalg.cholesky(covariances)
        self._whiten = np.linalg.inv(lower)
        self._log_det = 2 * np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """(rows x k) logarithms of weight times density."""
        out = np.empty((len(x), len(self.weights)))
        for j in range(len(self.weights)):
            z = (x - self.means[j]) @ self._whiten[j].T
            out[:, j] = -0.5 * ((z * z).sum(axis=1) + self._log_det[j] + x.shape[1] * math.log(2 * math.pi))
        return out + np.log(self.weights)

    def bic(self) -> float:
        k, d = self.means.shape
        free = {"full": k * d * (d + 1) / 2, "tied": d * (d + 1) / 2, "diag": k * d, "spherical": k}[self.kind]
        return (free + k * d + k - 1) * math.log(self.n) - 2 * self.log_likelihood

    def transform(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("int")
        def likeliest(xs: pd.Series) -> pd.Series:
            out = [np.empty(0, dtype=int)]
            for i in range(0, len(xs), STEP):
                out.append(model.log_density(np.stack(xs.iloc[i:i + STEP].to_numpy())).argmax(axis=1))
            return pd.Series(np.concatenate(out))
        return df.withColumn("prediction", likeliest(vector_to_array(F.col("features"))))


def statistics(x: np.ndarray, share: np.ndarray, products: bool) -> np.ndarray:
    """Counts, sums and products (squares unless ``products``) per component, as one array."""
    first = [share.sum(axis=0), (share.T @ x).ravel()]
    if products:
        return np.concatenate([*first, np.einsum("nk,ni,nj->kij", share, x, x, optimize=True).ravel()])
    return np.concatenate([*first, (share.T @ (x * x)).ravel()])


def from_statistics(kind: str, s: np.ndarray, k: int, d: int) -> Mixture:
    n = s[:k] + 10 * np.finfo(float).eps
    means = s[k:k + k * d].reshape(k, d) / n[:, None]
    rest, eye = s[k + k * d:], np.eye(d)
    if kind in ("full", "tied"):
        cov = rest.reshape(k, d, d) / n[:, None, None] - means[:, :, None] * means[:, None, :]
        if kind == "tied":
            cov = np.broadcast_to((cov * n[:, None, None]).sum(axis=0) / n.sum(), (k, d, d))
        cov = cov + RIDGE * eye
    else:
        var = np.maximum(rest.reshape(k, d) / n[:, None] - means * means, 0.0) + RIDGE
        if kind == "spherical":
            var = np.broadcast_to(var.mean(axis=1)[:, None], (k, d))
        cov = var[:, :, None] * eye
    return Mixture(kind, n / n.sum(), means, cov)


def _added(points: DataFrame, share, products: bool) -> np.ndarray:
    """Statistics of all rows, the log-likelihood last.  ``share`` gives
    responsibilities and log-likelihoods of a matrix."""
    def run(frames):
        total = None
        for pdf in frames:
            for i in range(0, len(pdf), STEP):
                x = np.stack(pdf["x"].iloc[i:i + STEP].to_numpy())
                r, ll = share(x)
                s = np.append(statistics(x, r, products), ll)
                total = s if total is None else total + s
        if total is not None:
            yield pd.DataFrame({"slot": np.arange(len(total)), "v": total})

    rows = points.mapInPandas(run, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:                                  # one number per statistic
        out[r["slot"]] = r["v"]
    return out


def expectation(model: Mixture):
    def share(x):
        log = model.log_density(x)
        top = log.max(axis=1, keepdims=True)
        each = np.exp(log - top)
        total = each.sum(axis=1, keepdims=True)
        return each / total, float((np.log(total) + top).sum())
    return share


def nearest_share(centres: np.ndarray):
    def share(x):
        r = np.zeros((len(x), len(centres)))
        r[np.arange(len(x)), distances(x, centres, 2).argmin(axis=1)] = 1.0
        return r, 0.0
    return share


def fit_from(points: DataFrame, centres: np.ndarray, kind: str, rounds: int = 100, tolerance: float = 1e-3) -> Mixture:
    """EM on ``points(x)`` from k-means centres."""
    k, d = centres.shape
    products = kind in ("full", "tied")
    model, before = from_statistics(kind, _added(points, nearest_share(centres), products)[:-1], k, d), -math.inf
    for _ in range(rounds):
        s = _added(points, expectation(model), products)
        n, likelihood = s[:k].sum(), float(s[-1])
        model.log_likelihood, model.n = likelihood, int(round(n))
        if abs(likelihood / n - before) < tolerance:
            break
        before = likelihood / n
        after = from_statistics(kind, s[:-1], k, d)
        after.log_likelihood, after.n = likelihood, model.n
        model = after
    return model


def best_mixture(data: DataFrame, ks, kinds=TYPES, starts: int = 3, seed: int = 42, rounds: int = 100) -> Mixture:
    """The lowest BIC over k and covariance type, the likeliest of ``starts`` each."""
    points = cut_lineage(data.select(vector_to_array(F.col("features")).alias("x")).filter(whole(F.col("x"))))
    best = None
    for k in ks:
        fits = [KMeans(k=k, seed=seed + i, maxIter=20).fit(data) for i in range(starts)]
        centres = [np.array(m.clusterCenters()) for m in fits]
        for kind in kinds:
            tried = [fit_from(points, c, kind, rounds) for c in centres if len(c) == k]
            if tried:
                model = max(tried, key=lambda m: m.log_likelihood)
                if best is None or model.bic() < best.bic():
                    best = model
    if best is None:
        raise ValueError("fewer distinct rows than components")
    return best

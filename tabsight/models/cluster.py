"""Clustering.  One k sweep (KMeans per k) is fitted once and shared
by the elbow view (D30), the silhouette view (D31), auto-k (J2) and the
KMeans candidate (J1).  Silhouette is Spark's O(n k) squared-Euclidean
form."""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.silhouette import silhouette
from ..session import cut_lineage
from .centres import bandwidth, birch, mean_shift
from .density import DensityModel
from .mixture import best_mixture

SWEPT = 50_000       # rows of one task of a sweep: each is read in every round of every fit
SCORED = 2_000       # rows of a seeded sample that score a setting of a search


@dataclass
class Sweep:
    ks: list[int]
    inertia: list[float]
    silhouette: list[float]
    models: dict = field(default_factory=dict)

    @property
    def best_k(self) -> int:
        """Best silhouette, the first k wins a tie."""
        best, k_best = None, self.ks[0] if self.ks else 2
        for k, s in zip(self.ks, self.silhouette):
            if best is None or s > best:
                best, k_best = s, k
        return k_best


def _silhouette(pred: DataFrame, n_rows: int, col: str = "prediction") -> float:
    """-1 when fewer than 2 clusters came out, or every row is its own."""
    found = pred.groupBy(col).count().count()
    if found < 2 or found >= n_rows:
        return -1.0
    ev = ClusteringEvaluator(featuresCol="features", predictionCol=col, metricName="silhouette",
                             distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(pred))


def best_kmeans(data: DataFrame, k: int, seeds: list[int]):
    """The fit with the lowest inertia over several starts."""
    fits = [KMeans(k=k, seed=s, featuresCol="features", maxIter=20).fit(data) for s in seeds]
    return min(fits, key=lambda m: m.summary.trainingCost)


def k_sweep(data: DataFrame, n_rows: int, max_k: int = 10, seed: int = 42, n_init: int = 3, threads: int = 4) -> Sweep:
    """k = 2..min(max_k, n-1); ``data`` is kept by the caller.
    The fits are many small jobs, so several ks run at a time."""
    ks = list(range(2, min(max_k, n_rows - 1) + 1))
    tasks = -(-n_rows // SWEPT)
    if tasks > data.rdd.getNumPartitions():      # a table in one part of a file would be swept by one task
        data = cut_lineage(data.repartition(tasks))
    seeds = [seed + i for i in range(n_init)]

    def one(k: int):
        m = best_kmeans(data, k, seeds)
        return m, float(m.summary.trainingCost), _silhouette(m.transform(data), n_rows)

    with ThreadPoolExecutor(threads) as pool:
        fits = list(pool.map(one, ks))
    return Sweep(ks, [f[1] for f in fits], [f[2] for f in fits], {k: f[0] for k, f in zip(ks, fits)})


def _searched(data: DataFrame, made) -> object:
    """The model with the best exact silhouette (the first of equals) on a
    seeded sample of SCORED rows; all models are fitted on all rows."""
    best, top = None, -1.0
    for m in made:
        s = silhouette(m.transform(data), vector_to_array(F.col("features")), "prediction", rows=SCORED)
        if s > top:
            best, top = m, s
    return best


def fit_clusterers(data: DataFrame, sweep: Sweep, models: list[str] | None = None, seed: int = 42,
                   effort: str = "quick") -> dict:
    """KMeans at the best k, bisecting k-means (divisive stand-in
    for agglomerative), DBSCAN, mean shift and BIRCH searched by silhouette,
    Gaussian mixture chosen by BIC.  ``quick`` searches part of each grid."""
    out = {}
    k, full = sweep.best_k, effort == "full"
    want = set(models or ["kmeans", "bisecting_kmeans", "gaussian_mixture"])
    # The search grids.
    eps = [0.2, 0.3, 0.5, 0.7, 1.0, 1.5] if full else [0.3, 0.5, 1.0]
    samples = [3, 5, 8, 10, 15] if full else [5]
    factors = [0.5, 0.75, 1.0, 1.25, 1.5] if full else [0.5, 1.0]
    grid = [(t, b) for t in ([0.2, 0.3, 0.5, 0.7, 1.0] if full else [0.3, 0.7]) for b in ([30, 50, 100] if full else [50])]

    def shifts():
        width = bandwidth(data, seed=seed)
        for f in factors if width > 0 else []:
            yield mean_shift(data, width * f)

    searches = {"dbscan": lambda: (DensityModel(e, s) for e in eps for s in samples), "mean_shift": shifts,
                "birch": lambda: (birch(data, k, t, b, seed) for t, b in grid)}
    for name, made in searches.items():
        if name in want:
            try:
                found = _searched(data, made())
                if found is not None:
                    out[name] = found
                elif name == "mean_shift":
                    out[name] = mean_shift(data)
            except Exception as e:  # noqa: BLE001
                out[name] = e
    if "kmeans" in want and k in sweep.models:
        out["kmeans"] = sweep.models[k]
    if "bisecting_kmeans" in want:
        try:
            ks = sweep.ks if full else [k]
            out["bisecting_kmeans"] = _searched(data, (BisectingKMeans(k=i, seed=seed).fit(data) for i in ks)) \
                or BisectingKMeans(k=k, seed=seed).fit(data)
        except Exception as e:  # noqa: BLE001
            out["bisecting_kmeans"] = e
    if "gaussian_mixture" in want:
        try:
            out["gaussian_mixture"] = best_mixture(data, sweep.ks or [2], seed=seed) if full else \
                best_mixture(data, [k], starts=1, seed=seed)
        except Exception as e:  # noqa: BLE001
            out["gaussian_mixture"] = e
    return out


def assign(model, data: DataFrame) -> DataFrame:
    return model.transform(data).withColumn("cluster", F.col("prediction").cast("int"))

"""Clusterers that end in a bounded set of centres.

BIRCH: clustering features (count, sum, sum of squares) are built per task,
merged over a tree of tasks and clustered by weighted k-means; a feature takes a
point as long as its radius stays within the threshold.  Mean shift: seeds are
the fullest cells of a grid, moved to the mean of the rows within the bandwidth
until they rest; a round is one scan with sums per task.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.near import distances, whole
from ..session import cut_lineage

MOST_FEATURES = 5_000    # features of one task: beyond, the threshold of that task grows
MOST_SEEDS = 200
STEP = 4_096


class CentresModel:
    """Rows go to the label of the nearest centre (the first of equals)."""

    def __init__(self, centres: np.ndarray, labels: np.ndarray | None = None, params: dict | None = None):
        self.centres = np.asarray(centres, dtype=float)
        self.labels = np.arange(len(centres)) if labels is None else np.asarray(labels)
        self.params = params or {}

    def transform(self, df: DataFrame) -> DataFrame:
        centres, labels = self.centres, self.labels

        @F.pandas_udf("int")
        def nearest(xs: pd.Series) -> pd.Series:
            out = [np.empty(0, dtype=int)]
            for i in range(0, len(xs), 256):
                out.append(labels[distances(np.stack(xs.iloc[i:i + 256].to_numpy()), centres, 2).argmin(axis=1)])
            return pd.Series(np.concatenate(out))
        return df.withColumn("prediction", nearest(vector_to_array(F.col("features"))))


# ---------------------------------------------------------------- BIRCH

class Features:
    """Clustering features of one task."""

    def __init__(self, threshold: float, dim: int, most: int = MOST_FEATURES):
        self.threshold, self.most = threshold, most
        self.n, self.total, self.square = np.zeros(0), np.zeros((0, dim)), np.zeros(0)

    def _radius(self, n, total, square):
        return np.sqrt(np.maximum(0.0, square / n - (total * total).sum(axis=-1) / (n * n)))

    def add(self, n: np.ndarray, total: np.ndarray, square: np.ndarray) -> None:
        """Merge features one by one into the nearest one that keeps its radius."""
        rest = list(range(len(n)))
        held = [self.n.tolist(), [t for t in self.total], self.square.tolist()]
        centres = self.total / self.n[:, None] if len(self.n) else self.total
        store = np.empty((max(16, 2 * len(held[0])), self.total.shape[1]))
        store[:len(centres)] = centres
        size = len(held[0])
        for i in rest:
            c = total[i] / n[i]
            at = int(((store[:size] - c) ** 2).sum(axis=1).argmin()) if size else -1
            if at >= 0:
                new = held[0][at] + n[i], held[1][at] + total[i], held[2][at] + square[i]
                if self._radius(*new) <= self.threshold:
                    held[0][at], held[1][at], held[2][at] = new
                    store[at] = new[1] / new[0]
                    continue
            if size == len(store):
                store = np.concatenate([store, np.empty_like(store)])
            store[size] = c
            for h, v in zip(held, (n[i], total[i], square[i])):
                h.append(v)
            size += 1
            if size > self.most:        # bounded memory: a wider threshold, and all features again
                self.n, self.total, self.square = np.array(held[0]), np.array(held[1]), np.array(held[2])
                self._widen()
                held = [self.n.tolist(), [t for t in self.total], self.square.tolist()]
                size = len(held[0])
                store[:size] = self.total / self.n[:, None]
        self.n, self.total, self.square = np.array(held[0]), np.array(held[1]).reshape(size, -1), np.array(held[2])

    def _widen(self) -> None:
        while len(self.n) > self.most // 2:
            wider = Features(self.threshold * 1.5, self.total.shape[1], 1 << 62)
            order = np.argsort(-self.n, kind="stable")
            wider.add(self.n[order], self.total[order], self.square[order])
            self.threshold, self.n, self.total, self.square = wider.threshold, wider.n, wider.total, wider.square

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"n": self.n, "total": list(self.total), "square": self.square})


_CF = "n double, total array<double>, square double"


def clustering_features(points: DataFrame, threshold: float, branching: int = 50) -> DataFrame:
    """(n, total, square) of ``points(x)``: one tree of tasks, ``branching`` tables a node."""
    def build(frames):
        held = None
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                held = held or Features(threshold, x.shape[1])
                values, counts = np.unique(x, axis=0, return_counts=True)      # copies are one feature
                held.add(counts.astype(float), values * counts[:, None], (values * values).sum(1) * counts)
        if held is not None:
            yield held.frame()

    def merge(pdf):
        total = np.stack(pdf["total"].to_numpy())
        held = Features(threshold, total.shape[1])
        order = np.lexsort((*total.T[::-1], -pdf["n"].to_numpy()))
        held.add(pdf["n"].to_numpy()[order], total[order], pdf["square"].to_numpy()[order])
        return held.frame()

    rows = cut_lineage(points.mapInPandas(build, _CF).withColumn("part", F.spark_partition_id()))
    parts = rows.agg(F.max("part")).first()[0] or 0
    while parts > 0:
        grouped = rows.withColumn("node", F.floor(F.col("part") / branching).cast("int")).drop("part")
        rows = cut_lineage(grouped.groupBy("node").applyInPandas(lambda key, pdf: merge(pdf).assign(part=key[0]), f"{_CF}, part int"))
        parts //= branching
    return rows.drop("part")


def birch(data: DataFrame, k: int, threshold: float = 0.5, branching: int = 50, seed: int = 42) -> CentresModel:
    """J5 on ``data(features)``: rows take the cluster of their nearest feature."""
    x = vector_to_array(F.col("features"))
    points = data.select(x.alias("x")).filter(whole(F.col("x")))
    found = clustering_features(points, threshold, branching)
    found = cut_lineage(found.select("n", F.transform("total", lambda t: t / F.col("n")).alias("x")))
    rows = found.orderBy(F.col("n").desc(), "x").limit(MOST_FEATURES).collect()      # at most this many leave the last node
    centres = np.array([r["x"] for r in rows], dtype=float)
    if len(rows) <= k:
        return CentresModel(centres, None, {"threshold": threshold, "branching": branching})
    fitted = KMeans(k=k, seed=seed, weightCol="n", maxIter=50).fit(found.select("n", array_to_vector("x").alias("features")))
    labels = distances(centres, np.array([c for c in fitted.clusterCenters()]), 2).argmin(axis=1)
    return CentresModel(centres, labels, {"threshold": threshold, "branching": branching})


# ---------------------------------------------------------------- mean shift

def bandwidth(data: DataFrame, quantile: float = 0.2, rows: int = 500, seed: int = 42) -> float:
    """Mean distance to the ``quantile``-th nearest row, over a seeded sample."""
    x = vector_to_array(F.col("features"))
    some = data.select(x.alias("x")).filter(whole(F.col("x"))).orderBy(F.xxhash64(F.lit(seed), "x")).limit(rows).collect()
    if len(some) < 2:
        return 0.0
    d = np.sort(distances(np.array([r["x"] for r in some]), np.array([r["x"] for r in some]), 2), axis=1)
    return float(d[:, max(1, int(len(d) * quantile)) - 1].mean())


def _within(seeds: np.ndarray, width: float):
    def run(frames):
        n, total = np.zeros(len(seeds)), np.zeros(seeds.shape)
        for pdf in frames:
            for i in range(0, len(pdf), STEP):
                x = np.stack(pdf["x"].iloc[i:i + STEP].to_numpy())
                near = (distances(seeds, x, 2) <= width).astype(float)
                n += near.sum(axis=1)
                total += near @ x
        yield pd.DataFrame({"seed": np.arange(len(seeds)), "n": n, "total": list(total)})
    return run


def shifted(points: DataFrame, seeds: np.ndarray, width: float, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Seeds at rest and the rows within the bandwidth of each."""
    count = np.zeros(len(seeds))
    for _ in range(rounds):
        parts = points.mapInPandas(_within(seeds, width), "seed int, n double, total array<double>")
        dim = seeds.shape[1]
        sums = parts.groupBy("seed").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[j]) for j in range(dim)]).alias("total"))
        new = seeds.copy()
        for r in sums.collect():                  # one row a seed
            count[r["seed"]] = r["n"]
            if r["n"]:
                new[r["seed"]] = np.array(r["total"]) / r["n"]
        moved = np.sqrt(((new - seeds) ** 2).sum(axis=1)).max(initial=0.0)
        seeds = new
        if moved < 1e-3 * width:
            break
    return seeds, count


def mean_shift(data: DataFrame, width: float | None = None) -> CentresModel:
    """J7 on ``data(features)``; resting seeds closer than the bandwidth to a
    fuller one are the same mode."""
    width = width or bandwidth(data)
    points = cut_lineage(data.select(vector_to_array(F.col("features")).alias("x")).filter(whole(F.col("x"))))
    if width <= 0:
        first = points.select("x").limit(1).collect()
        return CentresModel(np.array([r["x"] for r in first], dtype=float), None, {"bandwidth": 0.0})
    cell: Column = F.transform("x", lambda v: F.round(v / F.lit(width)))
    cells = points.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "cell").limit(MOST_SEEDS)
    seeds = np.array([r["cell"] for r in cells.collect()], dtype=float) * width
    seeds, count = shifted(points, seeds, width)
    modes: list[int] = []
    for i in np.lexsort((*seeds.T[::-1], -count)):
        if count[i] and all(((seeds[i] - seeds[m]) ** 2).sum() > width * width for m in modes):
            modes.append(int(i))
    return CentresModel(seeds[modes], None, {"bandwidth": width})

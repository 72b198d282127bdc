"""K nearest neighbours over the pruned exact join (C4).

``NearestNeighbours`` predicts from all labelled rows.  The search computes one
neighbour table per norm at the largest k, in which rows of one fold do not
meet; every k and both weightings are scored from it in one aggregate.
"""
from __future__ import annotations

import math
import random

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.near import nearest_rows, point, whole
from ..session import cut_lineage

MOST_NEIGHBOURS = 30


def k_ceiling(n_rows: int, folds: int) -> int:
    """The rows that every training fold has, at most 30."""
    if n_rows <= 2:
        return 1
    return max(1, min(MOST_NEIGHBOURS, n_rows - math.ceil(n_rows / max(2, folds))))


def _weighted(near: DataFrame) -> DataFrame:
    """Adds ``by_distance``: 1 / d; where a neighbour has distance 0 only those count."""
    least = F.min("d").over(Window.partitionBy("qid"))
    weight = F.when(F.col("least") > 0, 1.0 / F.col("d")).otherwise((F.col("d") == 0).cast("double"))
    return near.withColumn("least", least).withColumn("by_distance", weight).drop("least")


def _share(k: int, weights: str) -> Column:
    """The weight of a neighbour for one setting."""
    return F.when(F.col("n") <= k, F.col("by_distance") if weights == "distance" else F.lit(1.0)).otherwise(F.lit(0.0))


class NearestNeighbours:
    """Exact neighbours among all labelled rows.  Ties in distance go to the row
    that comes first in hash order, ties in the vote to the smallest label.  Rows
    with missing components get no prediction."""

    def __init__(self, features: list[str] | None, label: str, k: int = 5, classify: bool = True, weights: str = "uniform",
                 norm: int = 2, vector: str | None = None, n_classes: int = 0):
        self.features, self.label, self.k, self.classify = features, label, k, classify
        self.weights, self.norm, self.vector, self.n_classes = weights, norm, vector, n_classes

    def _point(self) -> Column:
        return vector_to_array(F.col(self.vector)) if self.vector else point(self.features)

    def _held(self, train: DataFrame, order: Column, apart: Column) -> DataFrame:
        x, y = self._point(), F.col(self.label)
        y = y if self.classify else y.cast("double")
        rows = train.select(x.alias("x"), y.alias("hid"), order.alias("o"), apart.cast("int").alias("apart"))
        return rows.filter(whole(F.col("x")) & F.col("hid").isNotNull())

    def fit(self, train: DataFrame, key: list[str] | None = None, seed: int = 42) -> "NearestNeighbours":
        if key:
            order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
        else:
            order = F.hex(F.xxhash64(F.lit(seed), self._point(), F.col(self.label)))
        fitted = self.copy({})
        fitted.train = cut_lineage(self._held(train, order, F.lit(None)))
        return fitted

    def copy(self, extra=None) -> "NearestNeighbours":
        held = {k: getattr(self, k) for k in ("features", "label", "k", "classify", "weights", "norm", "vector", "n_classes")}
        return NearestNeighbours(**{**held, **(extra or {})})

    def transform(self, df: DataFrame) -> DataFrame:
        asked = cut_lineage(df.withColumn("__qid", F.monotonically_increasing_id()))      # ids that stay
        rows = asked.select(F.col("__qid").alias("qid"), self._point().alias("x"), F.lit(None).cast("int").alias("apart"))
        near = _weighted(nearest_rows(self.train, rows.filter(whole(F.col("x"))), self.k, self.norm))
        w = _share(self.k, self.weights)
        if not self.classify:
            got = near.groupBy("qid").agg((F.sum(w * F.col("hid")) / F.sum(w)).alias("prediction"))
        else:
            votes = near.groupBy("qid", "hid").agg(F.sum(w).alias("w"))
            got = votes.groupBy("qid").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("hid").alias("y"))).alias("best"),
                                           *[(F.sum(F.when(F.col("hid") == c, F.col("w")).otherwise(0.0)) / F.sum("w")).alias(f"p{c}")
                                             for c in range(self.n_classes)])
            shares = [F.array(*[f"p{c}" for c in range(self.n_classes)]).alias("probability")] if self.n_classes else []
            got = got.select("qid", F.col("best.y").alias("prediction"), *shares)
        return asked.join(got.withColumnRenamed("qid", "__qid"), "__qid", "left").drop("__qid")

    def search(self, folded: DataFrame, folds: int, n_rows: int, n_iter: int, seed: int = 42):
        """(settings, score) of the best of ``n_iter`` settings drawn from k up to the
        ceiling, both weightings and both norms: mean accuracy or R2 over the folds."""
        grid = [{"k": k, "weights": w, "norm": p} for k in range(1, k_ceiling(n_rows, folds) + 1)
                for w in ("uniform", "distance") for p in (1, 2)]
        drawn = grid if len(grid) <= n_iter else random.Random(seed).sample(grid, n_iter)
        rows = cut_lineage(folded.withColumn("qid", F.monotonically_increasing_id()))
        scores: dict[int, float] = {}
        for norm in sorted({s["norm"] for s in drawn}):
            mine = [(i, s) for i, s in enumerate(drawn) if s["norm"] == norm]
            held = self._held(rows, F.hex(F.xxhash64(F.lit(seed), "qid")), F.col("fold"))
            asked = rows.select("qid", self._point().alias("x"), F.col("fold").cast("int").alias("apart"))
            near = nearest_rows(held, asked.filter(whole(F.col("x"))), max(s["k"] for _, s in mine), norm)
            near = _weighted(near).join(rows.select("qid", "fold", F.col(self.label).alias("y")), "qid")
            scores.update(self._scored(near, mine))
        good = [(s, -i) for i, s in scores.items() if s is not None and not math.isnan(s)]
        if not good:
            return {}, None
        best, at = max(good)
        return drawn[-at], best

    def _scored(self, near: DataFrame, settings: list[tuple[int, dict]]) -> dict[int, float]:
        """Score of every setting from one neighbour table."""
        w = {i: _share(s["k"], s["weights"]) for i, s in settings}
        if self.classify:
            votes = near.groupBy("qid", "fold", "y", "hid").agg(*[F.sum(c).alias(f"w{i}") for i, c in w.items()])
            won = votes.groupBy("qid", "fold", "y").agg(*[F.min(F.struct(-F.col(f"w{i}"), "hid")).alias(f"b{i}") for i in w])
            per = won.groupBy("fold").agg(*[F.avg((F.col(f"b{i}")["hid"] == F.col("y")).cast("double")).alias(f"s{i}") for i in w])
        else:
            means = near.groupBy("qid", "fold", "y").agg(*[(F.sum(c * F.col("hid")) / F.sum(c)).alias(f"m{i}") for i, c in w.items()])
            spread = F.var_pop("y") * F.count(F.lit(1))
            per = means.groupBy("fold").agg(*[(1.0 - F.sum((F.col(f"m{i}") - F.col("y")) ** 2) / F.nullif(spread, F.lit(0.0))).alias(f"s{i}")
                                              for i in w])
        row = per.agg(*[F.avg(f"s{i}").alias(f"s{i}") for i in w]).first()
        return {i: row[f"s{i}"] for i in w}

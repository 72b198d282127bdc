"""DBSCAN over the epsilon join.

Equal points are one weighted point.  Every group of the join adds up the
weights within eps of its points; a point is core where its own weight and
theirs reach ``min_samples``.  Groups then emit a forest of core-core links
(never all pairs), clusters are the components, and a border point takes the
cluster of smallest number among its core neighbours: a group names one core
per cluster part that the border point touches.  Clusters are numbered from 0
by their smallest core row in the order of ``order_col`` (the components by
default), so labels do not depend on how rows are stored; noise is -1.  Rows
with missing components are noise.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import running_sums
from ..operators.components import components
from ..operators.near import _within, epsilon_cells, point, whole
from ..session import cut_lineage


def _weights(eps: float, norm: int):
    def run(key, pdf):
        pdf = pdf.sort_values("far", kind="stable")
        w, n = pdf["w"].to_numpy(), np.zeros(len(pdf), dtype=np.int64)
        for i, j, _ in _within(pdf, key, eps, norm):
            np.add.at(n, i, w[j])
            np.add.at(n, j, w[i])
        return pd.DataFrame({"rid": pdf["rid"].to_numpy(), "n": n})
    return run


def _links(eps: float, norm: int):
    """(core, a, b): core-core forest links, and (false, border, one core of each
    part of the forest that it touches)."""
    def run(key, pdf):
        pdf = pdf.sort_values("far", kind="stable")
        rid, core = pdf["rid"].to_numpy(), pdf["core"].to_numpy().astype(bool)
        root, out, touches = np.arange(len(pdf)), [], []

        for i, j, _ in _within(pdf, key, eps, norm):
            both = core[i] & core[j]
            ci, cj = i[both], j[both]
            # pairs come row by row: a row joins the parts that its partners are in, each part once
            ends = np.flatnonzero(np.diff(ci)) + 1
            for row, js in zip(ci[np.concatenate([[0], ends])] if len(ci) else (), np.split(cj, ends)):
                parts, first = np.unique(root[js], return_index=True)
                for part, at in zip(parts.tolist(), first.tolist()):
                    if part != root[row]:
                        root[root == part] = root[row]
                        out.append((True, rid[row], rid[js[at]]))
            one = core[i] != core[j]
            edge, at = np.where(core[i[one]], j[one], i[one]), np.where(core[i[one]], i[one], j[one])
            touches.append(np.stack([edge, at], axis=1))
        touched = np.concatenate([np.empty((0, 2), dtype=int), *touches])
        seen = set(zip(touched[:, 0].tolist(), root[touched[:, 1]].tolist()))
        out += [(False, rid[b], rid[c]) for b, c in seen]          # a part is named by one of its cores
        return pd.DataFrame(out, columns=["core", "a", "b"])
    return run


class DensityModel:
    """DBSCAN as a clusterer of a ``features`` vector; it labels the rows it is given."""

    def __init__(self, eps: float, min_samples: int):
        self.eps, self.min_samples = eps, min_samples

    def transform(self, data: DataFrame) -> DataFrame:
        return dbscan(data, vector_to_array(F.col("features")), self.eps, self.min_samples, out="prediction")


def dbscan(df: DataFrame, features: list[str] | Column, eps: float, min_samples: int, order_col: str | None = None,
           norm: int = 2, out: str = "cluster") -> DataFrame:
    """``df`` with the cluster of every row."""
    x = point(features) if isinstance(features, list) else features
    rows = df.withColumn("__x", F.when(whole(x), x))
    key = F.col(order_col) if order_col else F.col("__x")
    points = (rows.filter(F.col("__x").isNotNull()).groupBy(F.col("__x").alias("x"))
              .agg(F.count(F.lit(1)).alias("w"), F.min(key).alias("first")))
    points = cut_lineage(points.withColumn("rid", F.monotonically_increasing_id()))
    cells = epsilon_cells(points.select("rid", "x", "w"), eps, norm)
    near = cells.groupBy("cell", "lo", "hi").applyInPandas(_weights(eps, norm), "rid long, n long").groupBy("rid").agg(F.sum("n").alias("n"))
    flags = points.join(near, "rid", "left").select("rid", "first", (F.col("w") + F.coalesce("n", F.lit(0)) >= min_samples).alias("core"))
    flags = cut_lineage(flags)
    links = cut_lineage(cells.join(flags.select("rid", "core"), "rid").groupBy("cell", "lo", "hi")
                        .applyInPandas(_links(eps, norm), "core boolean, a long, b long"))
    label = components(links.filter("core").select("a", "b"))
    cores = flags.filter("core").join(label, F.col("rid") == F.col("node"), "left").select(
        "rid", "first", F.coalesce("label", "rid").alias("label"))
    # numbers by the smallest core row: a running count in the order of first
    first = cores.groupBy("label").agg(F.min("first").alias("first")).withColumn("one", F.lit(1).cast("long"))
    cores = cut_lineage(cores.join(running_sums(first, "first", ["one"]).select("label", (F.col("cum_one") - 1).alias("number")), "label"))
    border = (links.filter("not core").join(cores.select(F.col("rid").alias("b"), "number"), "b")
              .groupBy(F.col("a").alias("rid")).agg(F.min("number").alias("number")))
    numbers = cores.select("rid", "number").unionByName(border)
    by_point = points.select("rid", F.col("x").alias("__x")).join(numbers, "rid").select("__x", "number")
    return (rows.join(by_point, "__x", "left").withColumn(out, F.coalesce("number", F.lit(-1)).cast("int"))
            .drop("__x", "number"))

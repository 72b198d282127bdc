"""A fitted analysis as a folder that a fresh session reads and scores with.

Layout: ``state`` (one JSON document: version, problem, fitted fills, levels,
classes, the winner and how each model is stored), ``codes`` (the label codes,
Parquet), ``features`` (the Spark feature stage) and ``models/<name>``.  Every
part is written by Spark, so the folder may lie in any store.
"""
from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal

from pyspark.ml import PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession

from ..models.boosting import AdaBoostModel, AdaBoostR2Model
from ..models.knn import NearestNeighbours
from ..models.supervised import Trained
from .analyze import Analysis

VERSION = 1
_PLAIN = ("fills", "coded", "unseen", "levels", "interaction", "square", "features", "classes", "class_values", "members", "best")
_NEIGHBOURS = ("features", "label", "k", "classify", "weights", "norm", "vector", "n_classes")


def _plain(value):
    """Values of a state that JSON does not know."""
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    raise TypeError(f"a state cannot hold {type(value).__name__}")


def _tree(path: str, spark: SparkSession):
    return DefaultParamsReader.loadParamsInstance(path, spark)


def _save_model(model, path: str) -> dict:
    """Writes a model; the entry tells how to read it."""
    if isinstance(model, (AdaBoostModel, AdaBoostR2Model)):
        for i, t in enumerate(model.trees):
            t.write().save(f"{path}/{i}")
        rest = {"weights": model.alphas, "n_classes": model.n_classes} if isinstance(model, AdaBoostModel) else {"weights": model.weights}
        return {"kind": type(model).__name__, "trees": len(model.trees), **rest}
    if isinstance(model, NearestNeighbours):
        model.train.write.parquet(path)
        return {"kind": "NearestNeighbours", **{c: getattr(model, c) for c in _NEIGHBOURS}}
    model.write().save(path)
    return {"kind": "spark"}


def _load_model(spark: SparkSession, entry: dict, path: str):
    kind = entry["kind"]
    if kind in ("AdaBoostModel", "AdaBoostR2Model"):
        trees = [_tree(f"{path}/{i}", spark) for i in range(entry["trees"])]
        return AdaBoostModel(trees, entry["weights"], entry["n_classes"]) if kind == "AdaBoostModel" else AdaBoostR2Model(trees, entry["weights"])
    if kind == "NearestNeighbours":
        model = NearestNeighbours(**{c: entry[c] for c in _NEIGHBOURS})
        model.train = spark.read.parquet(path)
        return model
    return _tree(path, spark)


def save_analysis(analysis: Analysis, path: str) -> None:
    """Everything that scoring needs; ``path`` must not exist."""
    if analysis.problem_type == "Clustering" or not analysis.best_model:
        raise ValueError("only an analysis with a trained winner can be saved")
    spark, state = analysis.info.sparkSession, analysis.state
    names = state["members"] if analysis.best_model == "voting" else [analysis.best_model]
    stored = {n: _save_model(analysis.models[n].model, f"{path}/models/{n}") for n in names}
    state["feature_model"].write().save(f"{path}/features")
    if state.get("codes") is not None:
        state["codes"].write.parquet(f"{path}/codes")
    document = {"version": VERSION, "problem_type": analysis.problem_type, "target": analysis.target, "best_model": analysis.best_model,
                "has_codes": state.get("codes") is not None, "models": stored, "state": {k: state[k] for k in _PLAIN if k in state}}
    text = json.dumps(document, default=_plain)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/state")


def load_analysis(spark: SparkSession, path: str) -> Analysis:
    """An analysis that ``score`` takes; tables of the run are not part of it."""
    document = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/state").collect()))
    if document["version"] != VERSION:
        raise ValueError(f"bundle version {document['version']} is not {VERSION}")
    none: DataFrame = spark.createDataFrame([], "name string")
    out = Analysis(document["problem_type"], document["target"], none, none, none, best_model=document["best_model"])
    out.state = dict(document["state"], feature_model=PipelineModel.load(f"{path}/features"),
                     codes=spark.read.parquet(f"{path}/codes") if document["has_codes"] else None)
    for name, entry in document["models"].items():
        out.models[name] = Trained(name, _load_model(spark, entry, f"{path}/models/{name}"))
    return out

"""Supervised model registry, random search with cross-validation,
voting ensembles and a boosting loop.

Each candidate is a Spark ML estimator on a ``features`` vector; tuning is
cross-validation over a seeded sample of the parameter grid with folds
from a row hash (``operators.split``), so results do not depend on
partitioning.  Fitting is distributed inside each estimator; candidates run
in parallel threads (``parallelism``).
"""
from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.split import stratified_folds
from ..session import cut_lineage, scratch_path, sized
from .boosting import AdaBoostClassifier, AdaBoostRegressor
from .knn import NearestNeighbours, k_ceiling



@dataclass
class Candidate:
    name: str
    make: object                      # callable(n_rows, n_features, n_classes) -> estimator
    grid: object = None               # callable(estimator, n_rows) -> list of ParamMaps
    kind: str = "spark"


@dataclass
class Trained:
    name: str
    model: Model
    params: dict = field(default_factory=dict)
    cv_score: float | None = None
    error: str | None = None
    estimator: object = None          # the estimator with the chosen parameters (for refits)


def _log_space(lo: float, hi: float, n: int) -> list[float]:
    import math
    a, b = math.log10(lo), math.log10(hi)
    return [10 ** (a + (b - a) * i / (n - 1)) for i in range(n)]


def _grid(est, pairs) -> list:
    b = ParamGridBuilder()
    for p, vals in pairs:
        b = b.addGrid(getattr(est, p), vals)
    return b.build()


# ---------------------------------------------------------------- regression
# Search spaces, mapped to Spark parameters
# (alpha -> regParam; sklearn's ridge alpha is on the summed loss, so /n).
def regression_candidates(effort: str = "quick") -> list[Candidate]:
    full = effort == "full"
    trees = [100, 200, 300, 500] if full else [20, 50]
    depth_rf = [5, 10, 20, 30] if full else [5, 10]
    gbt_iter = [100, 200, 300] if full else [10, 20]
    return [
        Candidate("linear_regression", lambda n, d, k: LinearRegression(regParam=0.0)),
        Candidate("ridge", lambda n, d, k: LinearRegression(elasticNetParam=0.0),
                  lambda e, n: _grid(e, [("regParam", [a / max(n, 1) for a in _log_space(1e-4, 1e4, 60)])])),
        Candidate("lasso", lambda n, d, k: LinearRegression(elasticNetParam=1.0),
                  lambda e, n: _grid(e, [("regParam", _log_space(1e-5, 10, 50))])),
        Candidate("elastic_net", lambda n, d, k: LinearRegression(),
                  lambda e, n: _grid(e, [("regParam", _log_space(1e-5, 10, 40)),
                                         ("elasticNetParam", [i / 10 for i in range(1, 10)])])),
        Candidate("decision_tree", lambda n, d, k: DecisionTreeRegressor(seed=42),
                  lambda e, n: _grid(e, [("maxDepth", [5, 10, 15, 20, 30]),
                                         ("minInstancesPerNode", [1, 2, 4, 8])])),
        Candidate("random_forest", lambda n, d, k: RandomForestRegressor(seed=42),
                  lambda e, n: _grid(e, [("numTrees", trees), ("maxDepth", depth_rf),
                                         ("minInstancesPerNode", [1, 2, 4]),
                                         ("featureSubsetStrategy", ["sqrt", "log2", "0.5", "all"])])),
        Candidate("gradient_boosting", lambda n, d, k: GBTRegressor(seed=42),
                  lambda e, n: _grid(e, [("maxIter", gbt_iter), ("stepSize", [0.01, 0.05, 0.1, 0.2]),
                                         ("maxDepth", [2, 3, 5, 7]), ("subsamplingRate", [0.6, 0.8, 1.0])])),
        Candidate("knn", lambda n, d, k: NearestNeighbours(None, "label", classify=False, vector="features")),
        Candidate("adaboost", lambda n, d, k: AdaBoostRegressor(n_rounds=50 if full else 10)),
    ]


# ---------------------------------------------------------------- classification
def classification_candidates(effort: str = "quick") -> list[Candidate]:
    full = effort == "full"
    trees = [100, 200, 300, 500] if full else [20, 50]
    gbt_iter = [100, 200, 300] if full else [10, 20]

    def gbt(n, d, k):
        base = GBTClassifier(seed=42)
        return base if k <= 2 else OneVsRest(classifier=base)

    def svc(n, d, k):
        base = LinearSVC()
        return base if k <= 2 else OneVsRest(classifier=base)

    def mlp(n, d, k):
        return MultilayerPerceptronClassifier(layers=[d, 64, max(k, 2)], seed=42, maxIter=100)

    def mlp_grid(e, n):
        first, last = e.getLayers()[0], e.getLayers()[-1]
        return _grid(e, [("layers", [[first, 32, last], [first, 64, last], [first, 64, 32, last]]), ("maxIter", [100, 200])])

    def gbt_grid(e, n):
        base = e.getClassifier() if isinstance(e, OneVsRest) else e
        pm = _grid(base, [("maxIter", gbt_iter), ("stepSize", [0.01, 0.05, 0.1, 0.2]),
                          ("maxDepth", [2, 3, 5, 7]), ("subsamplingRate", [0.6, 0.8, 1.0])])
        return pm if base is e else [{e.classifier: base.copy(m)} for m in pm]

    def svc_grid(e, n):
        base = e.getClassifier() if isinstance(e, OneVsRest) else e
        pm = _grid(base, [("regParam", [1.0 / (c * max(n, 1)) for c in _log_space(1e-3, 1e3, 30)])])
        return pm if base is e else [{e.classifier: base.copy(m)} for m in pm]

    return [
        Candidate("logistic_regression", lambda n, d, k: LogisticRegression(family="auto", maxIter=100),
                  lambda e, n: _grid(e, [("regParam", [1.0 / (c * max(n, 1)) for c in _log_space(1e-3, 1e3, 30)]),
                                         ("elasticNetParam", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])])),
        Candidate("linear_svm", svc, svc_grid),
        Candidate("naive_bayes", lambda n, d, k: NaiveBayes(modelType="gaussian")),
        Candidate("decision_tree", lambda n, d, k: DecisionTreeClassifier(seed=42),
                  lambda e, n: _grid(e, [("maxDepth", [5, 10, 15, 20, 30]), ("minInstancesPerNode", [1, 2, 4, 8]),
                                         ("impurity", ["gini", "entropy"])])),
        Candidate("random_forest", lambda n, d, k: RandomForestClassifier(seed=42),
                  lambda e, n: _grid(e, [("numTrees", trees), ("maxDepth", [5, 10, 20, 30] if full else [5, 10]),
                                         ("minInstancesPerNode", [1, 2, 4]),
                                         ("featureSubsetStrategy", ["sqrt", "log2", "0.5", "all"]),
                                         ("impurity", ["gini", "entropy"])])),
        Candidate("gradient_boosting", gbt, gbt_grid),
        Candidate("mlp", mlp, mlp_grid),
        Candidate("knn", lambda n, d, k: NearestNeighbours(None, "label", vector="features", n_classes=k)),
        Candidate("adaboost", lambda n, d, k: AdaBoostClassifier(n_rounds=50 if full else 10, n_classes=k)),
    ]


def random_search(est, grid: list, n_iter: int, seed: int = 42) -> list:
    """I16: a seeded sample without replacement of at most n_iter maps."""
    if not grid:
        return [{}]
    if len(grid) <= n_iter:
        return grid
    return random.Random(seed).sample(grid, n_iter)


def chosen_params(estimator, chosen: dict) -> dict:
    """What the search chose, then what was set on the estimator, by
    parameter name.  A wrapped classifier shows its own parameters."""
    inner = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    if not hasattr(inner, "params"):       # not a Spark estimator: its plain public fields
        return {k: v for k, v in sorted(vars(inner).items()) if isinstance(v, (int, float, str, bool))}
    picked = {}
    for p in inner.params:
        if inner.isSet(p) and isinstance(inner.getOrDefault(p), (int, float, str, bool)):
            picked[p.name] = inner.getOrDefault(p)
    for p, v in chosen.items():
        if isinstance(v, (int, float, str, bool)):
            picked[p.name] = v
    return dict(sorted(picked.items()))


def cross_validated(est, maps: list, evaluator, folded: DataFrame, folds: int, parallelism: int = 4) -> list[float]:
    """Mean score of every map over the folds of the column ``fold``.  A fold is
    a plain filter on the kept rows (``CrossValidator`` tests it in Python row by
    row and caches two copies of the rows for each fold)."""
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    for f in range(folds):
        for part, n in (("training", sum(sizes.values()) - sizes.get(f, 0)), ("validation", sizes.get(f, 0))):
            if not n:
                raise ValueError(f"The {part} data at fold {f} is empty.")

    def one(setting):
        params, f = setting
        model = est.fit(folded.filter(F.col("fold") != f), params)
        return float(evaluator.evaluate(model.transform(folded.filter(F.col("fold") == f))))

    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(one, [(m, f) for m in maps for f in range(folds)]))
    return [sum(scores[i * folds:(i + 1) * folds]) / folds for i in range(len(maps))]


def train_supervised(data: DataFrame, problem_type: str, n_classes: int, n_features: int,
                     models: list[str] | None = None, effort: str = "quick", n_iter: int = 2,
                     folds: int = 3, parallelism: int = 4, seed: int = 42) -> list[Trained]:
    """Tune and fit each candidate on ``data`` (features, label);
    a failing candidate is recorded with its error, not hidden."""
    if problem_type == "Regression":
        cands = regression_candidates(effort)
        evaluator = RegressionEvaluator(metricName="r2")
    elif problem_type == "Classification":
        cands = classification_candidates(effort)
        evaluator = MulticlassClassificationEvaluator(metricName="accuracy")
    else:
        raise ValueError(f"unknown problem type: {problem_type}")
    if models:
        cands = [c for c in cands if c.name in models]
    n = data.count()
    with sized(data.sparkSession, n):
        return _trained(cands, evaluator, data, problem_type, n, n_classes, n_features, n_iter, folds, parallelism, seed)


def _trained(cands: list[Candidate], evaluator, data: DataFrame, problem_type: str, n: int, n_classes: int, n_features: int,
             n_iter: int, folds: int, parallelism: int, seed: int) -> list[Trained]:
    # Folds from the row id hash (set by the caller from the raw row), per class where there are classes
    order = F.xxhash64(F.lit(seed + 1), F.col("__row"))
    if problem_type == "Classification":
        folded = stratified_folds(data, folds, "label", order).select("features", "label", "fold")
    else:
        folded = data.select("features", "label", F.pmod(order, F.lit(folds)).cast("int").alias("fold"))
    folded = cut_lineage(folded).persist(StorageLevel.MEMORY_AND_DISK)      # one copy for all folds, settings and candidates
    try:
        return _candidates_fitted(cands, evaluator, folded, n, n_classes, n_features, n_iter, folds, parallelism, seed)
    finally:
        folded.unpersist()


def _candidates_fitted(cands: list[Candidate], evaluator, folded: DataFrame, n: int, n_classes: int, n_features: int,
                       n_iter: int, folds: int, parallelism: int, seed: int) -> list[Trained]:
    out = []
    for c in cands:
        try:
            est = c.make(n, n_features, n_classes)
            if isinstance(est, NearestNeighbours):      # scored from neighbour tables, not fitted per setting
                picked, score = est.search(folded, folds, n, n_iter, seed) if folds >= 2 and n > folds else ({}, None)
                chosen = est.copy(picked or {"k": min(est.k, k_ceiling(n, folds))})
                out.append(Trained(c.name, chosen.fit(folded), chosen_params(chosen, picked), score, None, chosen))
                continue
            grid = c.grid(est, n) if c.grid else []
            maps = random_search(est, grid, n_iter, seed)
            if len(maps) > 1 and folds >= 2:
                means = cross_validated(est, maps, evaluator, folded, folds, parallelism)
                good = [(m, i) for i, m in enumerate(means) if not math.isnan(m)]
                if good:
                    score, at = max(good, key=lambda x: (x[0], -x[1]))
                    picked = maps[at]
                    chosen = est.copy(picked)
                else:      # no candidate could be scored: the default fit
                    score, picked, chosen = None, {}, est
                best = chosen.fit(folded)
            else:
                picked = maps[0] if maps else {}
                chosen = est.copy(picked) if picked else est
                best = chosen.fit(folded)
                score = None
            out.append(Trained(c.name, best, chosen_params(chosen, picked), score, None, chosen))
        except Exception as e:  # noqa: BLE001  (recorded, I20 / L6p)
            out.append(Trained(c.name, None, {}, None, f"{type(e).__name__}: {str(e)[:200]}"))
    return out


def predict_all(models: list[Trained], data: DataFrame, problem_type: str) -> DataFrame:
    """Score ``data`` with every fitted model; output long form
    (model, label, prediction, probability array or null, scores): ``scores``
    holds the probabilities or, where a model has none, its raw decision values
    (K15)."""
    parts = []
    for t in models:
        if t.model is None:
            continue
        p = t.model.transform(data)
        if "probability" not in p.columns:
            prob = F.lit(None).cast("array<double>")
        elif p.schema["probability"].dataType.typeName() == "array":
            prob = F.col("probability").cast("array<double>")
        else:
            prob = vector_to_array(F.col("probability"))
        raw = vector_to_array(F.col("rawPrediction")) if "rawPrediction" in p.columns else F.lit(None).cast("array<double>")
        p = p.withColumn("__s", F.coalesce(prob, raw))
        parts.append(p.select(F.lit(t.name).alias("model"), F.col("label"), F.col("prediction"),
                              prob.alias("probability"), F.col("__s").alias("scores"), *([F.col("__row")] if "__row" in p.columns else [])))
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


# The models that vote when they were trained.
VOTERS = ("linear_regression", "logistic_regression", "random_forest", "gradient_boosting")


def votes_with_probability(model, frame: DataFrame) -> bool:
    return "probability" in model.transform(frame.limit(0)).columns


def vote(models: list, frame: DataFrame, problem_type: str, n_classes: int = 0) -> DataFrame:
    """Every member scores the same rows in one projection chain; the
    mean prediction (regression) or the argmax of the mean probability
    (classification) is the vote.  Used for the holdout and for new rows."""
    cur, outs = frame, []
    for i, m in enumerate(models):
        cur = m.transform(cur)
        if problem_type == "Regression":
            cur = cur.withColumn(f"__p{i}", F.col("prediction"))
        elif cur.schema["probability"].dataType.typeName() == "array":
            cur = cur.withColumn(f"__p{i}", F.col("probability"))
        else:
            cur = cur.withColumn(f"__p{i}", vector_to_array("probability"))
        outs.append(F.col(f"__p{i}"))
        cur = cur.drop("prediction", "probability", "rawPrediction")
    names = [f"__p{i}" for i in range(len(outs))]
    if problem_type == "Regression":
        return cur.withColumn("prediction", sum(outs) / len(outs)).drop(*names)
    mean = F.array(*[sum(o[j] for o in outs) / len(outs) for j in range(n_classes)])
    return cur.withColumn("probability", mean).withColumn(
        "prediction", (F.array_position(F.col("probability"), F.array_max("probability")) - 1).cast("double")).drop(*names)


def learning_curve(estimator, data: DataFrame, problem_type: str, folds: int = 3, steps: int = 5,
                   seed: int = 42) -> DataFrame:
    """Fit on growing nested fractions (20 %..100 %) of each fold's
    training part, score on the held-out fold (R2, or weighted F1).  The
    fraction is a hash threshold, so each size contains the smaller ones; folds
    are stratified by class.  Fewer than 12 rows, or a class with one row, give
    an empty curve.  Fits run several at a time."""
    spark = data.sparkSession
    schema = "train_fraction double, fold int, n_train bigint, score double"
    unit = (F.pmod(F.xxhash64(F.lit(seed + 2), F.col("__row")), F.lit(10_000)) / 10_000.0).alias("u")
    order = F.xxhash64(F.lit(seed + 1), F.col("__row"))
    total = data.count()
    if problem_type == "Regression":
        if total < 12:
            return spark.createDataFrame([], schema)
        d = data.select("features", "label", F.pmod(order, F.lit(folds)).cast("int").alias("fold"), unit)
    else:
        sizes = data.groupBy("label").count().agg(F.min("count").alias("least"), F.sum("count").alias("n")).first()
        if (sizes["n"] or 0) < 12 or sizes["least"] < 2:
            return spark.createDataFrame([], schema)
        folds = min(folds, sizes["least"])
        d = stratified_folds(data, folds, "label", order).select("features", "label", "fold", unit)
    # files by fold and step: a fit reads the folds and steps that it uses
    step = F.coalesce(*[F.when(F.col("u") < s / steps, s) for s in range(1, steps + 1)])
    path = scratch_path(spark, "learning_curve")
    with sized(spark, total):
        d.select("features", "label", "fold", step.alias("step")).write.partitionBy("fold", "step").parquet(path)
        d = spark.read.parquet(path)
        at = {(r["fold"], r["step"]): r["count"] for r in d.groupBy("fold", "step").count().collect()}
        rows = _curve_points(estimator, d, at, problem_type, folds, steps)
    return spark.createDataFrame([r for r in rows if r], schema)


def _curve_points(estimator, d: DataFrame, at: dict, problem_type: str, folds: int, steps: int) -> list:
    """(fraction, fold, rows, score) of every fit; ``at``: rows by (fold, step)."""
    ev = (RegressionEvaluator(metricName="r2") if problem_type == "Regression"
          else MulticlassClassificationEvaluator(metricName="f1"))

    def one(setting):
        f, s = setting
        tr = d.filter((F.col("fold") != f) & (F.col("step") <= s))
        n = sum(c for (g, t), c in at.items() if g != f and t <= s)
        return (s / steps, f, n, float(ev.evaluate(estimator.fit(tr).transform(d.filter(F.col("fold") == f))))) if n >= 2 else None

    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(one, [(f, s) for f in range(folds) for s in range(1, steps + 1)]))


def params_table(spark, trained: list[Trained] | dict) -> DataFrame:
    """Non-default parameters per model as (model, param, value)."""
    items = trained.values() if isinstance(trained, dict) else trained
    rows = [(t.name, k, str(v)) for t in items for k, v in sorted(t.params.items())]
    return spark.createDataFrame(rows, "model string, param string, value string")

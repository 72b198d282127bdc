"""AdaBoost (SAMME, multi-class) as a driver loop of Spark decision
stumps.  Each round is one weighted tree fit and one aggregate for the
weighted error; the re-weighted table is checkpointed into the shared
checkpoint folder every round, so lineage stays one round long and a lost
executor only recomputes one round."""
from __future__ import annotations

import math

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


class AdaBoostModel:
    def __init__(self, trees, alphas, n_classes):
        self.trees, self.alphas, self.n_classes = trees, alphas, n_classes

    def transform(self, df: DataFrame) -> DataFrame:
        """Weighted vote: argmax over classes of sum(alpha_m [tree_m = class])."""
        cur = df
        for i, t in enumerate(self.trees):
            cur = t.setPredictionCol(f"__ab{i}").setProbabilityCol(f"__abp{i}").setRawPredictionCol(
                f"__abr{i}").transform(cur).drop(f"__abp{i}", f"__abr{i}")
        votes = [sum((F.col(f"__ab{i}") == k).cast("double") * a for i, a in enumerate(self.alphas))
                 for k in range(self.n_classes)]
        total = sum(self.alphas) or 1.0
        arr = F.array(*[v / total for v in votes])
        out = cur.withColumn("probability", arr).withColumn(
            "prediction", (F.array_position(F.col("probability"), F.array_max(F.col("probability"))) - 1)
            .cast("double"))
        return out.drop(*[f"__ab{i}" for i in range(len(self.trees))])

    def extractParamMap(self):
        return {}


class AdaBoostClassifier:
    """SAMME with depth-1 trees (sklearn's default base learner)."""

    def __init__(self, n_rounds: int = 50, learning_rate: float = 1.0, max_depth: int = 1, seed: int = 42,
                 n_classes: int = 2):
        self.n_rounds, self.learning_rate, self.max_depth = n_rounds, learning_rate, max_depth
        self.seed, self.n_classes = seed, n_classes

    def copy(self, extra=None):
        c = AdaBoostClassifier(self.n_rounds, self.learning_rate, self.max_depth, self.seed, self.n_classes)
        for k, v in (extra or {}).items():
            setattr(c, k, v)
        return c

    def extractParamMap(self):
        return {}

    def fit(self, data: DataFrame) -> AdaBoostModel:
        k = max(self.n_classes, 2)
        cur = cut_lineage(data.select("features", "label", F.lit(1.0).alias("__w")))
        trees, alphas = [], []
        for _ in range(self.n_rounds):
            tree = DecisionTreeClassifier(maxDepth=self.max_depth, weightCol="__w", seed=self.seed).fit(cur)
            scored = tree.transform(cur)
            wrong = (F.col("prediction") != F.col("label")).cast("double")
            row = scored.agg(F.sum(F.col("__w") * wrong).alias("e"), F.sum("__w").alias("t")).first()
            err = row["e"] / row["t"] if row["t"] else 0.0
            if err >= 1.0 - 1.0 / k:
                break
            if err <= 0.0:
                trees.append(tree)
                alphas.append(1.0)
                break
            alpha = self.learning_rate * (math.log((1.0 - err) / err) + math.log(k - 1.0))
            trees.append(tree)
            alphas.append(alpha)
            cur = cut_lineage(scored.select("features", "label",
                                            (F.col("__w") * F.exp(F.lit(alpha) * wrong)).alias("__w")))
        return AdaBoostModel(trees, alphas, k)


class AdaBoostR2Model:
    def __init__(self, trees, weights):
        self.trees, self.weights = trees, weights

    def transform(self, df: DataFrame) -> DataFrame:
        """Weighted median: the smallest prediction at which half of the weight is reached."""
        cur = df
        for i, t in enumerate(self.trees):
            cur = t.setPredictionCol(f"__ab{i}").transform(cur)
        names = [f"__ab{i}" for i in range(len(self.trees))]
        pairs = F.array_sort(F.array(*[F.struct(F.col(c).alias("p"), F.lit(float(w)).alias("w")) for c, w in zip(names, self.weights)]))
        half = 0.5 * sum(self.weights)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
        walked = F.aggregate(pairs, start, lambda a, x: F.struct(
            (a["sum"] + x["w"]).alias("sum"), F.coalesce(a["at"], F.when(a["sum"] + x["w"] >= half, x["p"])).alias("at")))
        return cur.withColumn("prediction", F.coalesce(walked["at"], F.element_at(pairs, -1)["p"])).drop(*names)

    def extractParamMap(self):
        return {}


class AdaBoostRegressor:
    """AdaBoost.R2: errors are divided by the round's largest one, the loss is
    linear, square or exponential, and a round whose mean loss reaches a half ends
    the search.  Trees are fitted on the weighted rows (no resampling)."""

    def __init__(self, n_rounds: int = 50, learning_rate: float = 1.0, max_depth: int = 3, loss: str = "linear", seed: int = 42):
        self.n_rounds, self.learning_rate, self.max_depth, self.loss, self.seed = n_rounds, learning_rate, max_depth, loss, seed

    def copy(self, extra=None):
        return AdaBoostRegressor(**{**vars(self), **(extra or {})})

    def fit(self, data: DataFrame) -> AdaBoostR2Model:
        cur = cut_lineage(data.select("features", "label", F.lit(1.0).alias("__w")))
        trees, weights = [], []
        for _ in range(self.n_rounds):
            tree = DecisionTreeRegressor(maxDepth=self.max_depth, weightCol="__w", seed=self.seed).fit(cur)
            scored = tree.transform(cur).withColumn("__e", F.abs(F.col("prediction") - F.col("label")))
            worst = scored.agg(F.max(F.when(F.col("__w") > 0, F.col("__e")))).first()[0] or 0.0
            share = F.col("__e") / F.lit(worst) if worst > 0 else F.lit(0.0)
            loss = {"linear": share, "square": share * share, "exponential": 1.0 - F.exp(-share)}[self.loss]
            row = scored.agg(F.sum(F.col("__w") * loss).alias("e"), F.sum("__w").alias("t")).first()
            err = row["e"] / row["t"] if row["t"] else 0.0
            if err <= 0.0:
                trees.append(tree)
                weights.append(1.0)
                break
            if err >= 0.5:
                if not trees:
                    trees, weights = [tree], [1.0]
                break
            beta = err / (1.0 - err)
            trees.append(tree)
            weights.append(self.learning_rate * math.log(1.0 / beta))
            fresh = F.col("__w") * F.pow(F.lit(beta), (1.0 - loss) * self.learning_rate) / F.lit(row["t"])
            cur = cut_lineage(scored.select("features", "label", fresh.alias("__w")))
        return AdaBoostR2Model(trees, weights)

"""Views that need a fitted projection or clustering, sharing one
scaled input and one k sweep (the reference refits them per view)."""
from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import quantiles
from ..models.cluster import k_sweep
from ..models.preprocess import population_scaler
from ..operators.schema import numeric_columns
from ..operators.views import ViewRefused
from ..session import cut_lineage


def scaled_numeric(df: DataFrame, target: str | None, ctx: dict) -> tuple[DataFrame, list[str]]:
    """Median-filled, standardised numeric columns (target excluded) as a
    ``features`` vector; cached in the context so every view shares it."""
    if "scaled" in ctx:
        return ctx["scaled"], ctx["scaled_cols"]
    cols = [c for c in numeric_columns(df) if c != target]
    if len(cols) < 2:
        raise ViewRefused("needs two numeric columns")
    med = {c: v[0] for c, v in quantiles(df, cols, [0.5]).items()}
    filled = df.select([F.coalesce(F.col(c).cast("double"), F.lit(med[c] if med[c] is not None else 0.0)).alias(c)
                        for c in cols] + ([F.col(target)] if target else []))
    filled = cut_lineage(filled)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="__raw"),
                            *population_scaler("__raw", "features", filled.count(), len(cols))])
    scaled = cut_lineage(pipe.fit(filled).transform(filled).drop("__raw", "features__s"))   # every fit reads it
    ctx["scaled"], ctx["scaled_cols"] = scaled, cols
    return scaled, cols


def sweep(df, target, ctx):
    if "sweep" not in ctx:
        scaled, _ = scaled_numeric(df, target, ctx)
        n = ctx.get("n_rows") or scaled.count()
        if n < 3:
            raise ViewRefused("fewer than 3 rows")
        ctx["sweep"] = k_sweep(scaled.select("features"), n)
    return ctx["sweep"]


def run(kind: str, df: DataFrame, target, params: dict, ctx: dict) -> DataFrame:
    spark = df.sparkSession
    if kind == "pca_scatter":
        scaled, _ = scaled_numeric(df, target, ctx)
        model = PCA(k=2, inputCol="features", outputCol="__pc").fit(scaled)
        ev = [float(v) for v in model.explainedVariance]
        pc = vector_to_array(F.col("__pc"))
        hue = params.get("hue")
        return model.transform(scaled).select(
            pc[0].alias("pc1"), pc[1].alias("pc2"),
            (F.col(hue).cast("string") if hue and hue in scaled.columns else F.lit(None).cast("string")).alias("hue"),
            F.lit(ev[0]).alias("pc1_variance_ratio"), F.lit(ev[1]).alias("pc2_variance_ratio"))
    if kind == "elbow_curve":
        s = sweep(df, target, ctx)
        return spark.createDataFrame(list(zip(s.ks, s.inertia)), "k int, inertia double")
    if kind == "silhouette_plot":
        s = sweep(df, target, ctx)
        return spark.createDataFrame(list(zip(s.ks, s.silhouette)), "k int, silhouette double")
    if kind == "cluster_size_bar":
        from pyspark.ml.clustering import KMeans
        scaled, _ = scaled_numeric(df, target, ctx)
        k = max(2, int(params.get("k", 3)))
        m = KMeans(k=k, seed=42).fit(scaled)
        return m.transform(scaled).groupBy(F.col("prediction").cast("int").alias("cluster")).agg(
            F.count(F.lit(1)).alias("size"))
    raise ViewRefused(kind)

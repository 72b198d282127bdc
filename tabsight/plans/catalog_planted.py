"""Registered checks of models and clusterers on planted structure: the result
follows from the tables, so SQL states it."""
from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from ..functions.stats import grouped_quantiles
from ..models import cluster as clu
from ..models import supervised as sup
from ..models.boosting import AdaBoostRegressor
from ..models.centres import birch, mean_shift
from ..models.mixture import best_mixture
from ..operators.split import stratified_folds
from ..session import scratch_path, sized
from ..sources.sinks import write_json_documents, write_table
from . import catalog as base

KEY, KEY_SQL, li, load, register, rounded = base.KEY, base.KEY_SQL, base.li, base.load, base.register, base.rounded


def _features(df, cols):
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features")]).fit(df).transform(df)


# ---------------------------------------------------------------- I2 to I4: planted line
_LINE = """SELECT l_linenumber::BIGINT AS line, round(avg(3 * l_quantity - 200 * l_discount + 500), 1) AS mean_prediction
 FROM lineitem GROUP BY 1"""


def _line(estimator):
    def run(spark, sf):
        d = li(spark, sf).withColumn("label", F.expr("3 * l_quantity - 200 * l_discount + 500"))
        d = _features(d.select("l_linenumber", "l_quantity", "l_discount", "label"), ["l_quantity", "l_discount"])
        p = estimator().fit(d).transform(d)
        return rounded(p.groupBy(F.col("l_linenumber").cast("long").alias("line")).agg(F.avg("prediction").alias("mean_prediction")), 1)
    return run


for _name, _mix in (("i2_ridge_planted", 0.0), ("i3_lasso_planted", 1.0), ("i4_elastic_net_planted", 0.5)):
    register(_name, _LINE)(_line(lambda mix=_mix: LinearRegression(regParam=1e-6, elasticNetParam=mix, maxIter=500, tol=1e-12)))

# ---------------------------------------------------------------- I6 to I9: planted step
_STEP = "CASE WHEN l_quantity > 25 THEN 100.0 ELSE 10.0 END"
_STEP_SQL = f"SELECT {KEY_SQL}, round({_STEP}, 3)::DOUBLE AS prediction FROM lineitem"


def _step(estimator):
    def run(spark, sf):
        d = _features(li(spark, sf).withColumn("label", F.expr(_STEP).cast("double")), ["l_quantity", "l_discount"])
        rows = d.select(*KEY, "features", "label")
        with sized(spark, rows.count()):
            model = estimator().fit(rows)
        return rounded(model.transform(d).select(*KEY, "prediction"), 3)
    return run


register("i6_decision_tree_planted", _STEP_SQL)(_step(lambda: DecisionTreeRegressor(seed=1, maxBins=64)))
register("i7_random_forest_planted", _STEP_SQL)(
    _step(lambda: RandomForestRegressor(seed=1, numTrees=5, maxBins=64, featureSubsetStrategy="all")))
register("i8_gradient_boosting_planted", _STEP_SQL)(_step(lambda: GBTRegressor(seed=1, maxIter=3, maxBins=64)))
register("i9_adaboost_r2_planted", _STEP_SQL)(_step(lambda: AdaBoostRegressor(n_rounds=5, max_depth=2)))

# ---------------------------------------------------------------- classifiers on two separate groups
_GROUPS_SQL = """SELECT (l_quantity > 25)::DOUBLE AS label, (l_quantity > 25)::DOUBLE AS prediction, count(*)::BIGINT AS n
 FROM lineitem WHERE l_quantity NOT BETWEEN 18 AND 32 GROUP BY ALL"""


def _groups(name):
    def run(spark, sf):
        d = li(spark, sf).filter("l_quantity not between 18 and 32").withColumn("label", F.expr("cast(l_quantity > 25 as double)"))
        d = d.withColumn("q", (F.col("l_quantity") - 25) / 15).withColumn("t", F.col("l_discount") * 10)
        d = _features(d, ["q", "t"]).select("features", "label", F.xxhash64(*KEY).alias("__row"))
        trained = sup.train_supervised(d, "Classification", 2, 2, [name], n_iter=1)
        if trained[0].error:
            raise RuntimeError(trained[0].error)
        return trained[0].model.transform(d).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    return run


for _id, _name in (("i6", "decision_tree"), ("i7", "random_forest"), ("i8", "gradient_boosting"), ("i9", "adaboost"),
                   ("i10", "logistic_regression"), ("i11", "linear_svm"), ("i12", "naive_bayes"), ("i13", "mlp")):
    register(f"{_id}_{_name}_groups", _GROUPS_SQL)(_groups(_name))

# ---------------------------------------------------------------- J: planted, well separated groups
_BLOBS_SQL = """SELECT min(c_nationkey)::INT AS first, count(*)::BIGINT AS size FROM customer GROUP BY c_nationkey % 4"""


def _blobs(spark, sf):
    c = load(spark, sf, "customer").withColumn("g", F.col("c_nationkey") % 4)
    c = c.withColumn("x", F.expr("case when g in (0, 1) then 5 else -5 end + c_acctbal / 20000"))
    c = c.withColumn("y", F.expr("case when g in (0, 2) then 5 else -5 end + (c_custkey % 100) / 200.0"))
    return _features(c, ["x", "y"]).select("c_nationkey", "features")


def _found(model, rows):
    return (model.transform(rows).groupBy("prediction")
            .agg(F.min("c_nationkey").cast("int").alias("first"), F.count(F.lit(1)).alias("size")).select("first", "size"))


def _clustered(fit):
    def run(spark, sf):
        rows = _blobs(spark, sf)
        return _found(fit(rows.select("features")), rows)
    return run


def _sweep(rows):
    return clu.k_sweep(rows, rows.count(), max_k=6)


register("j1_kmeans_planted", _BLOBS_SQL)(_clustered(lambda d: clu.best_kmeans(d, 4, [42, 43, 44, 45, 46])))
register("j3_bisecting_planted", _BLOBS_SQL)(_clustered(lambda d: BisectingKMeans(k=4, seed=42).fit(d)))
register("j5_birch_planted", _BLOBS_SQL)(_clustered(lambda d: birch(d, 4, threshold=0.3)))
register("j6_mixture_planted", _BLOBS_SQL)(_clustered(lambda d: best_mixture(d, [4], starts=2, seed=42)))
register("j7_mean_shift_planted", _BLOBS_SQL)(_clustered(lambda d: mean_shift(d, 2.0)))
register("j2_auto_k_planted", "SELECT count(DISTINCT c_nationkey % 4)::INT AS k FROM customer")(
    lambda spark, sf: spark.createDataFrame([(_sweep(_blobs(spark, sf).select("features")).best_k,)], "k int"))

# ---------------------------------------------------------------- A5, grouped quantiles
@register("a5_result_roundtrip", """SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*)::BIGINT AS n,
 to_json({'n': count(*)}) AS document FROM orders GROUP BY ALL""")
def _a5(spark, sf):
    counts = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"))
    table, documents = scratch_path(spark, "result"), scratch_path(spark, "documents")
    write_table(counts, table, partition_by=["status"])
    back = spark.read.parquet(table)
    write_json_documents(back.select("n").distinct(), documents)
    texts = spark.read.text(documents).select(F.get_json_object("value", "$.n").cast("long").alias("n"), F.col("value").alias("document"))
    return back.join(texts, "n").select("priority", F.col("status").cast("string").alias("status"), "n", "document")


register("d12_quartiles_of_many_groups", """SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.25), 4) AS q0,
 round(quantile_cont(l_extendedprice, 0.5), 4) AS q1, round(quantile_cont(l_extendedprice, 0.9), 4) AS q2 FROM lineitem GROUP BY 1""")(
    lambda spark, sf: rounded(grouped_quantiles(li(spark, sf), "l_suppkey", "l_extendedprice", [0.25, 0.5, 0.9]), 4))

# ---------------------------------------------------------------- E7
_MD5 = "md5(concat_ws('|', '43', {k}))"
register("e7_stratified_folds", f"""SELECT {KEY_SQL}, ((row_number() OVER (PARTITION BY l_returnflag
 ORDER BY {_MD5.format(k=KEY_SQL)}) - 1) % 5)::INT AS fold FROM lineitem""")(
    lambda spark, sf: stratified_folds(li(spark, sf), 5, "l_returnflag",
                                       F.md5(F.concat_ws("|", F.lit("43"), *[F.col(c).cast("string") for c in KEY]))).select(*KEY, "fold"))
register("e7_stratified_sizes", f"""SELECT l_returnflag, fold, count(*)::BIGINT AS n FROM (SELECT l_returnflag,
 ((row_number() OVER (PARTITION BY l_returnflag ORDER BY {KEY_SQL}) - 1) % 3)::INT AS fold FROM lineitem) GROUP BY ALL""")(
    lambda spark, sf: stratified_folds(li(spark, sf), 3, "l_returnflag", F.xxhash64(F.lit(43), *KEY))
    .groupBy("l_returnflag", "fold").agg(F.count(F.lit(1)).alias("n")))

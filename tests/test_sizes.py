"""Steps over large tables: tasks of bounded size, folds without copies."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from tabsight import session
from tabsight.models import cluster, supervised
from tabsight.operators import clean
from tabsight.plans import catalog
from tabsight.plans.analyze import analyze, score


def rows_of(spark, n=300):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "a": rng.random(n), "label": rng.random(n)})).coalesce(1)
    df = df.withColumn("label", F.col("a") * 2 + F.col("label")).withColumn("__row", F.xxhash64("id"))
    return VectorAssembler(inputCols=["a"], outputCol="features").transform(df)


def test_sized_raises_the_numbers_and_puts_them_back(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    keys = ("spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum")
    before = [spark.conf.get(k, None) for k in keys]
    with pytest.raises(KeyError), session.sized(spark, 1_000):
        assert [spark.conf.get(k) for k in keys] == ["100", "100"]
        raise KeyError
    assert [spark.conf.get(k, None) for k in keys] == before
    with session.sized(spark, 20):
        assert [spark.conf.get(k, None) for k in keys] == before


@pytest.fixture
def unset(spark):
    """A session that names no number of shuffle partitions (Spark's default holds)."""
    other = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum"):
        other.conf.unset(k)
    return other


def test_sized_where_the_session_names_no_number(unset, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    keys = ("spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum")
    with session.sized(unset, 2_000):                # 200 tasks, Spark's default
        assert [unset.conf.get(k, None) for k in keys] == [None, None]
    with session.sized(unset, 2_001):
        assert [unset.conf.get(k) for k in keys] == ["201", "201"]
    assert [unset.conf.get(k, None) for k in keys] == [None, None]


def test_fits_run_where_the_session_names_no_number(unset):
    d = rows_of(unset)
    line = supervised.train_supervised(d, "Regression", 0, 1, ["linear_regression"], n_iter=1, folds=2)
    assert line[0].error is None
    halves = d.withColumn("label", F.expr("cast(a > 0.5 as double)"))
    tree = supervised.train_supervised(halves, "Classification", 2, 1, ["decision_tree"], n_iter=1, folds=2)
    assert tree[0].error is None and tree[0].model.transform(halves).filter("prediction = label").count() > 290
    assert supervised.learning_curve(LinearRegression(), d, "Regression", folds=2, steps=2).count() == 4


def test_an_analysis_runs_where_the_session_names_no_number(unset):
    rows = [(float(i % 17), float(i % 5), 2.0 * (i % 17) - 3.0 * (i % 5) + 1.0) for i in range(85)]
    df = unset.createDataFrame(rows, "a double, b double, y double")
    a = analyze(df, target="y", models=["linear_regression"], n_iter=1, run_views=False, post_training=False)
    assert a.errors == {}
    assert all(abs(r["predicted_value"] - (2 * r["a"] - 3 * r["b"] + 1)) < 1e-6 for r in score(a, df.drop("y")).collect())
    clusters = analyze(df.select("a", "b"), run_views=False, models=["kmeans"])
    assert clusters.errors == {} and clusters.best_model


def test_a_planted_step_is_fitted_where_the_session_names_no_number(unset, tmp_path):
    rows = [(i, 1, 1, i % 7 + 1, float(5 * (i % 10) + 3), i % 11 / 100) for i in range(200)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double"
    unset.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("i6_decision_tree_planted", "i9_adaboost_r2_planted"):
        found = catalog.QUERIES[name](unset, str(tmp_path)).collect()
        assert sorted((r["l_orderkey"], r["prediction"]) for r in found) == [(r[0], 100.0 if r[4] > 25 else 10.0) for r in rows]


def test_fold_scores_equal_those_of_cross_validator(spark):
    d = rows_of(spark).withColumn("fold", F.pmod("__row", F.lit(3)).cast("int"))
    est, ev = LinearRegression(), RegressionEvaluator(metricName="r2")
    maps = [{est.regParam: r} for r in (0.0, 0.5)]
    want = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=ev, foldCol="fold", numFolds=3).fit(d).avgMetrics
    assert np.allclose(supervised.cross_validated(est, maps, ev, d, 3), want)
    with pytest.raises(ValueError):
        supervised.cross_validated(est, maps, ev, d, 4)


def test_learning_curve_counts_the_rows_of_each_fit(spark):
    d = rows_of(spark)
    unit = F.pmod(F.xxhash64(F.lit(44), F.col("__row")), F.lit(10_000)) / 10_000.0
    fold = F.pmod(F.xxhash64(F.lit(43), F.col("__row")), F.lit(3))
    for r in supervised.learning_curve(LinearRegression(), d, "Regression").collect():
        assert r["n_train"] == d.filter((fold != r["fold"]) & (unit < r["train_fraction"])).count()


def test_few_codes_are_broadcast_and_many_are_not(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "c string, n int")
    codes = session.cut_lineage(clean.label_codes(df, ["c"]))
    few = clean.apply_codes(df, codes, ["c"], sizes={"c": 3})
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert "strategy=broadcast" not in clean.apply_codes(df, codes, ["c"])._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(few.collect()) == sorted(clean.apply_codes(df, codes, ["c"]).collect())


def test_a_sweep_of_one_part_runs_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SWEPT", 50)
    seen, best = [], cluster.best_kmeans
    monkeypatch.setattr(cluster, "best_kmeans", lambda d, k, s: (seen.append(d.rdd.getNumPartitions()), best(d, k, s))[1])
    cluster.k_sweep(rows_of(spark).select("features"), 300, max_k=2)
    assert seen == [6]

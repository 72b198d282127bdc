"""Metrics against brute force; models on planted signals; scoring."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabsight.operators import metrics as met


def _auc_bruteforce(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def _ap_bruteforce(y, s):
    order = np.argsort(-s, kind="stable")
    ap, tp, fp, prev_r = 0.0, 0, 0, 0.0
    for thr in sorted(set(s), reverse=True):
        sel = s == thr
        tp += int(y[sel].sum())
        fp += int((1 - y[sel]).sum())
        r = tp / y.sum()
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_auc_ap_match_bruteforce(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) + 0.3 * y, 2)
    df = spark.createDataFrame(pd.DataFrame({"y": y.astype(int), "score": s}))
    assert abs(met.roc_auc(df).first()[0] - _auc_bruteforce(y, s)) < 1e-12
    assert abs(met.average_precision(df).first()[0] - _ap_bruteforce(y, s)) < 1e-12


def test_thinned_curve_keeps_the_areas(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(600), 3)
    y = (rng.random(600) < s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "score": s})).repartition(5)
    full, thin = met.binary_curve(df).toPandas(), met.thinned(met.binary_curve(df)).toPandas()
    assert len(thin) < len(full)

    def area(t):
        t = t.sort_values("score", ascending=False)
        x, v = np.r_[0, t["cum_fp"]], np.r_[0, t["cum_tp"]]
        return np.trapezoid(v, x)

    assert abs(area(thin) - area(full)) < 1e-9
    order = full.sort_values("score", ascending=False).reset_index(drop=True)
    step = list(zip(order["tp"], order["fp"]))
    want = {order["score"][i] for i in range(len(step)) if i in (0, len(step) - 1) or step[i] != step[i + 1]}
    assert set(thin["score"]) == want


def test_curves_from_decision_values_and_learning_guards(spark):
    from tabsight.models.supervised import learning_curve
    from tabsight.plans.analyze import analyze
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 2))
    for classes in (2, 3):
        y = np.digitize(x[:, 0], [0.0] if classes == 2 else [-0.5, 0.5])
        df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
        a = analyze(df, target="y", problem_type="Classification", models=["linear_svm"], n_iter=1, run_views=False,
                    refit=False, curve=True)
        assert a.post["score_source"] == "rawPrediction" and "calibration" not in a.post
        area = a.post["roc_auc"].first()[0] if classes == 2 else a.post["micro_auc_ap"].first()["auc"]
        assert area > 0.8
        assert {"roc_curve", "pr_curve"} <= set(a.post) if classes == 2 else a.post["micro_curves"].count() > 2
        curve = a.post["learning_curve"].collect()
        assert {r["train_fraction"] for r in curve} == {0.2, 0.4, 0.6, 0.8, 1.0}
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    few = spark.createDataFrame([(float(i), float(i == 0), i) for i in range(20)], "a double, label double, __row int")
    few = VectorAssembler(inputCols=["a"], outputCol="features").transform(few)
    assert learning_curve(LogisticRegression(), few, "Classification").count() == 0
    assert learning_curve(LogisticRegression(), few.limit(5), "Classification").count() == 0


def test_holdout_views_of_a_regression(spark):
    from tabsight.plans.analyze import analyze
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(a), float(2 * a + 0.1 * b)) for a, b in rng.normal(size=(200, 2))], "a double, y double")
    a = analyze(df, target="y", models=["linear_regression"], n_iter=1, run_views=False, refit=False)
    q = a.post["residual_qq"].orderBy("i").collect()
    assert len(q) == a.post["residual_vs_fitted"].count() and all(u["ordered"] <= v["ordered"] for u, v in zip(q, q[1:]))
    line = a.post["identity"].first()
    assert line["low"] < -1 and line["high"] > 1


def test_weighted_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int")
    r = met.classification_metrics(df).first()
    assert abs(r["accuracy"] - 0.5) < 1e-12
    # class 2 never predicted -> precision 0; class 0 precision 1, class 1 precision 1/3
    assert abs(r["precision"] - (2 * 1.0 + 1 * (1 / 3) + 0) / 4) < 1e-12


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "label double, prediction double")
    r = met.regression_metrics(df).first()
    assert abs(r["mse"] - (0.25 + 0 + 1) / 3) < 1e-12
    assert abs(r["r2"] - (1 - 1.25 / 2.0)) < 1e-12


def test_planted_regression_fits(spark):
    from tabsight.plans.analyze import analyze, score
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        "l_quantity", "l_discount", "l_tax").withColumn("y", F.expr("3 * l_quantity - 200 * l_discount + 5"))
    a = analyze(li, target="y", models=["linear_regression"], n_iter=1, run_views=False)
    r2 = a.metrics.filter("model = 'linear_regression' and metric = 'r2'").first()["value"]
    assert r2 > 0.999
    p = score(a, li.limit(20)).select("y", "predicted_value").collect()
    assert all(abs(x["y"] - x["predicted_value"]) < 1e-3 for x in p)


def test_planted_binary_beats_majority(spark):
    from tabsight.plans.analyze import analyze
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        "l_quantity", "l_discount").withColumn("label_col", F.expr("cast(l_quantity > 25 as int)"))
    a = analyze(li, target="label_col", models=["decision_tree"], n_iter=1, run_views=False)
    acc = a.metrics.filter("model = 'decision_tree' and metric = 'accuracy'").first()["value"]
    assert acc > 0.95
    assert "roc_auc" in a.post


def test_adaboost_learns_planted_rule(spark):
    from pyspark.ml.feature import VectorAssembler
    from tabsight.models.boosting import AdaBoostClassifier
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        "l_quantity", "l_discount", F.expr("cast(l_quantity > 25 as double)").alias("label"))
    data = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(li)
    model = AdaBoostClassifier(n_rounds=3, n_classes=2).fit(data)
    acc = model.transform(data).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.99


def test_neighbours_come_from_all_labelled_rows(spark, monkeypatch):
    import hashlib
    from collections import Counter
    from tabsight.models import knn
    from tabsight.operators import near
    monkeypatch.setattr(near, "BLOCK", 64)               # several blocks on both sides
    rows = [(i, float(i * 37 % 101), float(i * 53 % 29), "abc"[i * 7 % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, z double, y string")
    got = {r["id"]: r["prediction"] for r in knn.NearestNeighbours(["x", "z"], "y", k=5).fit(df, ["id"]).transform(df).collect()}
    tie = {i: hashlib.md5(f"42|{i}".encode()).hexdigest() for i, *_ in rows}
    for i, x, z, _ in rows:
        near = sorted(rows, key=lambda r: ((r[1] - x) ** 2 + (r[2] - z) ** 2, tie[r[0]]))[:5]
        votes = Counter(r[3] for r in near)
        assert got[i] == min(votes, key=lambda y: (-votes[y], y))


def test_registered_neighbours_without_a_bound(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    got = E.queries()["i5_knn_all"](spark, SF_SMALL)
    assert got.count() == spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    assert got.filter("prediction is null").count() == 0

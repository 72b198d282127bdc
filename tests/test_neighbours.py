"""Neighbour joins, clusterers, folds and boosting against plain versions."""
import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsight.models import centres, density, knn, mixture
from tabsight.models.boosting import AdaBoostRegressor
from tabsight.operators import near, silhouette, split
from tabsight.operators.components import components


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(near, "ROWS_A_PIVOT", 50)
    monkeypatch.setattr(near, "BLOCK", 64)
    monkeypatch.setattr(silhouette, "BLOCK", 64)


def blobs(seed=0, n=60, copies=150):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(5):
        rows += [(len(rows) + i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(rng.uniform(-5, 5, 2), 0.4, (n, 2)))]
    rows += [(len(rows) + i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-8, 8, (n, 2)))]
    rows += [(len(rows) + i, rows[3][1], rows[3][2]) for i in range(copies)]           # a hot point
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double").repartition(5)


def gaps(rows):
    x = np.array([r[1:3] for r in rows])
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def plain_dbscan(rows, eps, least):
    near_ = gaps(rows) <= eps
    core, label, c = near_.sum(1) >= least, np.full(len(rows), -1), 0
    for i in np.argsort([r[0] for r in rows]):
        if label[i] == -1 and core[i]:
            label[i], stack = c, [i]
            while stack:
                q = stack.pop()
                if core[q]:
                    for j in np.flatnonzero(near_[q]):
                        if label[j] == -1:
                            label[j] = c
                            stack.append(j)
            c += 1
    return {r[0]: int(v) for r, v in zip(rows, label)}


@pytest.mark.parametrize("eps,least", [(0.3, 5), (0.1, 3)])
def test_dbscan_equals_plain_version_in_any_order(spark, small_blocks, eps, least):
    rows = blobs()
    want = plain_dbscan(rows, eps, least)
    got = density.dbscan(frame(spark, rows), ["a", "b"], eps, least, "id")
    assert {r["id"]: r["cluster"] for r in got.collect()} == want
    random.Random(1).shuffle(rows)
    again = density.dbscan(frame(spark, rows), ["a", "b"], eps, least, "id")
    assert {r["id"]: r["cluster"] for r in again.collect()} == want


def test_dbscan_of_rows_without_points(spark):
    rows = [(1, None, 1.0), (2, float("nan"), 1.0), (3, 0.0, 0.0), (4, 0.0, 0.0), (5, float("inf"), 0.0)]
    got = density.dbscan(frame(spark, rows), ["a", "b"], 0.5, 2, "id")
    assert {r["id"]: r["cluster"] for r in got.collect()} == {1: -1, 2: -1, 3: 0, 4: 0, 5: -1}
    assert density.dbscan(frame(spark, rows).limit(0), ["a", "b"], 0.5, 2, "id").count() == 0


@pytest.mark.parametrize("norm", [1, 2])
def test_epsilon_pairs_equal_all_pairs(spark, small_blocks, norm):
    rows = blobs(copies=20)
    x = np.array([r[1:3] for r in rows])
    d = gaps(rows) if norm == 2 else np.abs(x[:, None] - x[None]).sum(2)
    got = near.epsilon_pairs(frame(spark, rows), ["a", "b"], 0.4, "id", norm).collect()
    i, j = np.nonzero(np.triu(d <= 0.4, 1))
    assert sorted((r["a"], r["b"]) for r in got) == sorted(zip(i.tolist(), j.tolist()))
    assert all(abs(r["distance"] - d[r["a"], r["b"]]) < 1e-12 for r in got)


def test_pivots_prune_most_of_the_space(spark, small_blocks):
    """A row is copied to few partitions when epsilon is small."""
    rows = blobs(n=100, copies=0)
    points = frame(spark, rows).select(F.col("id").alias("rid"), near.point(["a", "b"]).alias("x"), F.lit(1).cast("long").alias("w"))
    cells = near.epsilon_cells(points, 0.1)
    assert cells.select("rid", "cell").distinct().count() < 2 * len(rows)


@pytest.mark.parametrize("norm,weights,classify", [(2, "uniform", True), (1, "distance", True), (2, "distance", False), (1, "uniform", False)])
def test_neighbours_equal_plain_version(spark, small_blocks, norm, weights, classify):
    rng, rows = random.Random(3), blobs(copies=90)
    full = [(*r, rng.choice("xyz"), rng.random()) for r in rows]
    df = spark.createDataFrame(full, "id long, a double, b double, c string, t double").repartition(4)
    label = "c" if classify else "t"
    model = knn.NearestNeighbours(["a", "b"], label, k=6, classify=classify, weights=weights, norm=norm).fit(df, ["id"])
    got = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    import hashlib
    order = sorted(range(len(full)), key=lambda i: hashlib.md5(f"42|{full[i][0]}".encode()).hexdigest())
    x = np.array([r[1:3] for r in full])
    for i, r in enumerate(full):
        d = np.sqrt(((x - x[i]) ** 2).sum(1)) if norm == 2 else np.abs(x - x[i]).sum(1)
        best = sorted(order, key=lambda j: d[j])[:6]
        w = [1.0] * 6 if weights == "uniform" else [float(d[j] == 0) if d[best[0]] == 0 else 1 / d[j] for j in best]
        if classify:
            votes = {}
            for j, v in zip(best, w):
                votes[full[j][3]] = votes.get(full[j][3], 0) + v
            assert got[r[0]] == min(votes, key=lambda y: (-votes[y], y))
        else:
            assert abs(got[r[0]] - sum(v * full[j][4] for j, v in zip(best, w)) / sum(w)) < 1e-9


def test_neighbours_send_rows_in_proportion(spark, small_blocks, monkeypatch):
    """Held rows go once per block of a partition's queries, equal points are answered from k of them."""
    sent, dealt = [], near.dealt
    monkeypatch.setattr(near, "dealt", lambda df, n, *keys: (sent.append(df.count()) if "qb" in keys else None, dealt(df, n, *keys))[1])
    rows = blobs(n=150, copies=900)
    df = spark.createDataFrame([(*r, r[0] % 3, float(r[0])) for r in rows], "id long, a double, b double, fold int, t double").repartition(4)
    held = df.select(near.point(["a", "b"]).alias("x"), F.col("id").alias("hid"), F.lpad(F.col("id").cast("string"), 9, "0").alias("o"),
                     F.col("fold").alias("apart"))
    asked = df.select(F.col("id").alias("qid"), near.point(["a", "b"]).alias("x"), F.col("fold").alias("apart"))
    got = {}
    for r in near.nearest_rows(held, asked, 4).collect():
        got.setdefault(r["qid"], {})[r["n"]] = r["hid"]
    d = gaps(rows)
    for r in rows:
        others = [j for j in range(len(rows)) if j % 3 != r[0] % 3]
        assert [got[r[0]][n] for n in range(1, 5)] == sorted(others, key=lambda j: (d[r[0], j], j))[:4]
    assert sent and max(sent) <= 5 * len(rows)


def test_neighbours_of_few_rows_and_missing_components(spark):
    df = frame(spark, [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, None, 0.0)]).withColumn("y", F.col("id").cast("double"))
    model = knn.NearestNeighbours(["a", "b"], "y", k=5, classify=False).fit(df, ["id"])
    assert {r["id"]: r["prediction"] for r in model.transform(df).collect()} == {1: 1.5, 2: 1.5, 3: None}
    assert [knn.k_ceiling(*a) for a in ((2, 5), (10, 5), (10, 2), (1000, 5))] == [1, 8, 5, 30]


def test_search_scores_settings_as_folds_do(spark, small_blocks):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    rows = [(float(a), float(b), float(a + 0.3 * rng.normal() > 0), i % 3) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, label double, fold int")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).select("features", "label", "fold")
    est = knn.NearestNeighbours(None, "label", vector="features", n_classes=2)
    picked, score = est.search(df, 3, 200, 8, seed=5)
    x, y, fold = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    right = []
    for f in range(3):
        hits = []
        for i in np.flatnonzero(fold == f):
            d = np.sqrt(((x - x[i]) ** 2).sum(1)) if picked["norm"] == 2 else np.abs(x - x[i]).sum(1)
            d = np.where(fold == f, np.inf, d)
            best = np.argsort(d)[:picked["k"]]
            w = np.ones(len(best)) if picked["weights"] == "uniform" else 1 / d[best]
            hits.append((w[y[best] == 1].sum() > w[y[best] == 0].sum()) == (y[i] == 1))
        right.append(np.mean(hits))
    assert abs(score - np.mean(right)) < 1e-9


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(2).shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000 + i, 1000) for i in range(50)] + [(5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in order}, **{1000 + i: 1000 for i in range(50)}}


def test_silhouette_equals_plain_version(spark, small_blocks):
    rows = blobs(copies=40)
    label = [int(r[1] > 0) + 2 * int(r[2] > 0) - (1 if i % 17 == 0 else 0) for i, r in enumerate(rows)]
    label[5] = 9                                                     # a cluster of one
    df = spark.createDataFrame([(*r, c) for r, c in zip(rows, label)], "id long, a double, b double, cluster int")
    kept = [i for i, c in enumerate(label) if c != -1]
    d, of = gaps(rows)[np.ix_(kept, kept)], np.array([label[i] for i in kept])
    want = []
    for i, c in enumerate(of):
        own = (of == c).sum()
        a = d[i][of == c].sum() / max(own - 1, 1)
        b = min(d[i][of == o].mean() for o in set(of.tolist()) - {c})
        want.append((b - a) / max(a, b) if own > 1 else 0.0)
    assert abs(silhouette.silhouette(df, ["a", "b"]) - np.mean(want)) < 1e-9
    assert silhouette.silhouette(df.withColumn("cluster", F.lit(3)), ["a", "b"]) == -1.0
    assert silhouette.silhouette(df.filter("id < 9").withColumn("cluster", F.col("id")), ["a", "b"]) == -1.0


def planted(spark, n=400):
    rng = np.random.default_rng(6)
    middle = np.array([[0, 0], [6, 0], [0, 6.0]])
    x = np.concatenate([rng.normal(m, 0.5, (n, 2)) for m in middle])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double").repartition(6)
    return x, middle, VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def same_groups(pred, n):
    return all(len(set(pred[i * n:(i + 1) * n])) == 1 for i in range(3)) and len(set(pred)) == 3


def test_mean_shift_finds_planted_modes(spark):
    x, middle, df = planted(spark)
    model = centres.mean_shift(df, 1.5)
    assert len(model.centres) == 3
    assert np.sqrt(((model.centres[:, None] - middle[None]) ** 2).sum(2)).min(axis=0).max() < 0.2
    # equal to a plain loop from the same seeds
    seeds = np.array([[0.5, 0.5], [5.0, 1.0], [1.0, 5.0]])
    points = df.select(near.point(["a", "b"]).alias("x"))
    got, count = centres.shifted(points, seeds, 1.5)
    plain = seeds.copy()
    for _ in range(300):
        new = np.array([x[np.sqrt(((x - s) ** 2).sum(1)) <= 1.5].mean(0) for s in plain])
        moved, plain = np.sqrt(((new - plain) ** 2).sum(1)).max(), new
        if moved < 1.5e-3:
            break
    assert np.abs(got - plain).max() < 1e-9 and count.min() > 300
    pred = [r[0] for r in model.transform(df).orderBy("id").select("prediction").collect()]
    assert np.mean([same_groups(pred, 400), len(set(pred)) == 3]) > 0


def test_birch_summary_is_bounded_and_finds_groups(spark, monkeypatch):
    x, _, df = planted(spark)
    found = centres.clustering_features(df.select(near.point(["a", "b"]).alias("x")), 0.4, branching=2).collect()
    assert sum(r["n"] for r in found) == len(x) and len(found) < 200
    assert np.allclose(sum(np.array(r["total"]) for r in found), x.sum(0))
    assert abs(sum(r["square"] for r in found) - (x * x).sum()) < 1e-6
    pred = [r[0] for r in centres.birch(df, 3, 0.4).transform(df).orderBy("id").select("prediction").collect()]
    assert len(set(pred)) == 3 and all(np.bincount(pred[i * 400:(i + 1) * 400]).max() > 395 for i in range(3))
    held = centres.Features(0.001, 2, most=20)
    held.add(np.ones(500), x[:500], (x[:500] ** 2).sum(1))
    assert len(held.n) <= 20 and held.n.sum() == 500 and held.threshold > 0.001
    same = df.withColumn("features", F.first("features").over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy(F.lit(1))))
    assert len(centres.birch(same, 3, 0.4).centres) == 1                 # constant rows: one feature


@pytest.mark.parametrize("kind", mixture.TYPES)
def test_mixture_equals_plain_em(spark, kind):
    x, middle, df = planted(spark, 60)
    points = df.select(near.point(["a", "b"]).alias("x"))
    got = mixture.fit_from(points, middle + 0.5, kind, rounds=3, tolerance=0.0)
    share, _ = mixture.nearest_share(middle + 0.5)(x)
    model = mixture.from_statistics(kind, mixture.statistics(x, share, kind in ("full", "tied")), 3, 2)
    for _ in range(3):
        r = np.stack([w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(2 * np.pi * c))
                      for w, m, c in zip(model.weights, model.means, model.covariances)], axis=1)
        r /= r.sum(1, keepdims=True)
        means = r.T @ x / r.sum(0)[:, None]
        cov = np.stack([(r[:, j, None] * (x - means[j])).T @ (x - means[j]) / r[:, j].sum() for j in range(3)])
        if kind == "tied":
            cov[:] = (cov * r.sum(0)[:, None, None]).sum(0) / len(x)
        if kind in ("diag", "spherical"):
            cov = np.stack([np.diag(np.diag(c)) for c in cov])
        if kind == "spherical":
            cov = np.stack([np.eye(2) * np.diag(c).mean() for c in cov])
        model = mixture.Mixture(kind, r.sum(0) / len(x), means, cov + 1e-6 * np.eye(2))
    assert np.abs(got.means - model.means).max() < 1e-8 and np.abs(got.covariances - model.covariances).max() < 1e-8


def test_stratified_folds_are_even_in_every_label(spark):
    rows = [(i, None if i % 50 == 0 else "hot" if i % 10 else str(i % 30)) for i in range(1000)] + [(7, "hot")] * 200
    df = spark.createDataFrame(rows, "id long, y string").repartition(7)
    got = split.stratified_folds(df, 4, "y", F.xxhash64(F.lit(1), "id"))
    assert got.columns == ["id", "y", "fold"] and got.count() == len(rows)
    sizes = {}
    for r in got.groupBy("y", "fold").count().collect():
        sizes.setdefault(r["y"], []).append(r["count"])
    assert all(max(v) - min(v + [0] * (4 - len(v))) <= 1 for v in sizes.values())


@pytest.mark.parametrize("loss", ["linear", "square", "exponential"])
def test_adaboost_r2_equals_plain_loop(spark, loss):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 300)
    y = np.sin(x) + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, label double")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    model = AdaBoostRegressor(n_rounds=3, max_depth=2, loss=loss).fit(df)
    preds = [np.array([r["prediction"] for r in t.transform(df).orderBy("id").collect()]) for t in model.trees]
    w = np.ones(300)
    for p, weight in zip(preds, model.weights):
        e = np.abs(p - y)
        e /= e.max()
        e = {"linear": e, "square": e * e, "exponential": 1 - np.exp(-e)}[loss]
        err = (w * e).sum() / w.sum()
        assert err < 0.5 and abs(weight - math.log((1 - err) / err)) < 1e-9
        w = w * (err / (1 - err)) ** (1 - e)
    want = []
    for row in np.array(preds).T:
        order = np.argsort(row, kind="stable")
        total = np.cumsum(np.array(model.weights)[order])
        want.append(row[order][np.searchsorted(total, 0.5 * total[-1])])
    got = [r["prediction"] for r in model.transform(df).orderBy("id").collect()]
    assert np.abs(np.array(got) - want).max() < 1e-9


def test_analysis_offers_every_clusterer(spark):
    from tabsight.plans.analyze import analyze
    _, _, df = planted(spark, 60)
    names = ["kmeans", "bisecting_kmeans", "dbscan", "mean_shift", "birch", "gaussian_mixture"]
    a = analyze(df.select("a", "b"), run_views=False, models=names)
    assert not a.errors
    assert {r["model"] for r in a.leaderboard.collect()} == set(names)
    scores = {r["model"]: r["score"] for r in a.leaderboard.collect()}
    assert scores["kmeans"] > 0.7 and scores["dbscan"] > 0.5
    assert a.post["silhouette_distribution"].count() > 0


def test_analysis_offers_neighbours(spark):
    from tabsight.plans.analyze import analyze, score
    rows = [(float(i % 20), float(i % 7), float((i % 20) > 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y double").withColumn("y", F.col("y").cast("int"))
    a = analyze(df, target="y", problem_type="Classification", models=["knn", "decision_tree"], n_iter=3, run_views=False)
    assert not a.errors
    f1 = {r["model"]: r["value"] for r in a.metrics.filter("metric = 'f1'").collect()}
    assert f1["knn"] > 0.9
    a.best_model = "knn"
    assert score(a, df.limit(10)).filter("predicted_value = y").count() >= 9

"""Registered checks of plans, models and post-training results with SQL."""
from __future__ import annotations

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..models import supervised as sup
from ..models.density import dbscan
from ..models.knn import NearestNeighbours
from ..operators import metrics as met
from ..operators import views
from ..operators.near import epsilon_pairs
from ..operators.silhouette import silhouette_values
from . import catalog as base
from . import plan

KEY, KEY_SQL, li, load, register, rounded = base.KEY, base.KEY_SQL, base.li, base.load, base.register, base.rounded
OTHERS = [c for c in base.LI_NUM if c != "l_extendedprice"]

# ---------------------------------------------------------------- D33
_RANKED = "\n  UNION ALL ".join(f"SELECT '{c}' AS c, abs(corr({c}, l_extendedprice)) AS s FROM lineitem" for c in OTHERS)


@register("d33_plan", f"""WITH s AS ({_RANKED}), r AS (SELECT c, row_number() OVER (ORDER BY s DESC, c) AS n FROM s),
 t AS (SELECT string_agg(c, ',' ORDER BY n) FILTER (n <= 6) AS six, string_agg(c, ',' ORDER BY n) FILTER (n <= 5) AS five,
 max(c) FILTER (n = 1) AS a, max(c) FILTER (n = 2) AS b, max(c) FILTER (n = 3) AS d FROM r)
 SELECT unnest([1,2,3,4,5,6,7,8,9,10,11])::INT AS position, unnest(['missingvalues','heatmap','distribution_grid','boxplot',
 'histogram','target_vs_feature','target_vs_feature','target_vs_feature','regression_residual','qq_plot','scale_location']) AS view,
 unnest(['','',six,five,'l_extendedprice',a,b,d,a,a,a]) AS columns FROM t""")
def _plan(spark, sf):
    return plan.plan_table(spark, plan.core_plan(li(spark, sf), "l_extendedprice", "Regression"))


# ---------------------------------------------------------------- D26
register("d26_qq_order", f"""SELECT row_number() OVER (ORDER BY residual)::BIGINT AS i, round(residual, 4) AS ordered
 FROM {base.RESID_SQL}""")(
    lambda spark, sf: rounded(views.qq_points(li(spark, sf), "l_quantity", "l_extendedprice").select("i", "ordered"), 4))

# ---------------------------------------------------------------- K3, K4
_SIL = f"""WITH t AS ({base.CL_SRC}), c AS (SELECT cluster AS k, count(*) AS n, avg(l_quantity) AS mq, avg(l_discount) AS md,
 avg(l_quantity * l_quantity + l_discount * l_discount) AS q FROM t GROUP BY 1),
 d AS (SELECT t.cluster, t.l_quantity, t.l_discount, c.k, c.n,
 l_quantity * l_quantity + l_discount * l_discount - 2 * (l_quantity * mq + l_discount * md) + q AS d FROM t, c),
 p AS (SELECT cluster, l_quantity, l_discount, max(CASE WHEN k = cluster THEN d * n / greatest(n - 1, 1) END) AS a,
 min(CASE WHEN k <> cluster THEN d END) AS b, count(*) AS copies FROM d GROUP BY ALL),
 s AS (SELECT cluster, (b - a) / greatest(a, b) AS s, copies FROM p)"""
register("k3_silhouette", f"{_SIL} SELECT round(sum(s * copies) / sum(copies), 6) AS silhouette FROM s")(
    lambda spark, sf: rounded(met.silhouette_points(base.clusters(spark, sf), ["l_quantity", "l_discount"])
                              .agg(F.avg("silhouette").alias("silhouette"))))
register("k4_silhouette_by_cluster", f"""{_SIL} SELECT cluster, round(sum(s * copies) / sum(copies), 6) AS mean,
 round(min(s), 6) AS low, round(max(s), 6) AS high FROM s GROUP BY 1""")(
    lambda spark, sf: rounded(met.silhouette_points(base.clusters(spark, sf), ["l_quantity", "l_discount"]).groupBy("cluster").agg(
        F.avg("silhouette").alias("mean"), F.min("silhouette").alias("low"), F.max("silhouette").alias("high"))))


_EXACT = f"""WITH t AS (SELECT l_quantity AS q, l_discount * 100 AS d, cluster, count(*) AS w FROM
 (SELECT l_quantity, l_discount, floor(l_quantity / 17)::INT AS cluster FROM lineitem) GROUP BY ALL),
 n AS (SELECT cluster AS other, sum(w) AS n FROM t GROUP BY 1),
 s AS (SELECT a.q, a.d, a.cluster, a.w, b.cluster AS other, sum(b.w * sqrt((a.q - b.q) * (a.q - b.q) + (a.d - b.d) * (a.d - b.d))) AS total
 FROM t a, t b GROUP BY ALL),
 m AS (SELECT q, d, cluster, any_value(w) AS w, max(CASE WHEN other = cluster THEN total / greatest(n - 1, 1) END) AS a,
 min(CASE WHEN other <> cluster THEN total / n END) AS b, max(CASE WHEN other = cluster THEN n END) AS n FROM s JOIN n USING (other)
 GROUP BY q, d, cluster), v AS (SELECT cluster, w, CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END AS s FROM m)"""


def _silhouettes(spark, sf):
    rows = base.clusters(spark, sf).withColumn("d", F.col("l_discount") * 100)
    return silhouette_values(rows, ["l_quantity", "d"])


register("k3_silhouette_euclidean", f"{_EXACT} SELECT round(sum(s * w) / sum(w), 6) AS silhouette FROM v")(
    lambda spark, sf: rounded(_silhouettes(spark, sf).agg((F.sum(F.col("silhouette") * F.col("w")) / F.sum("w")).alias("silhouette"))))
register("k4_silhouette_distribution", f"""{_EXACT} SELECT cluster::BIGINT AS cluster, floor(s * 20)::INT AS bin, sum(w)::BIGINT AS n
 FROM v GROUP BY ALL""")(
    lambda spark, sf: _silhouettes(spark, sf).groupBy("cluster", F.floor(F.col("silhouette") * 20).cast("int").alias("bin"))
    .agg(F.sum("w").alias("n")))


# ---------------------------------------------------------------- I1, I5, I9, I14, L1
def _vector(df, cols):
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


@register("i1_linear_coefficients", """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
 round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def _linear(spark, sf):
    d = _vector(li(spark, sf), ["l_quantity"]).withColumn("label", F.col("l_extendedprice"))
    m = LinearRegression(regParam=0.0, solver="normal").fit(d)
    return rounded(spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double"), 4)


@register("i9_naive_bayes_moments", """SELECT l_returnflag AS class, f AS feature, round(avg(v), 4) AS mean, round(var_pop(v), 4) AS variance
 FROM (SELECT l_returnflag, unnest(['l_quantity', 'l_discount']) AS f, unnest([l_quantity, l_discount]) AS v FROM lineitem)
 GROUP BY ALL""")
def _bayes(spark, sf):
    d = _vector(li(spark, sf), ["l_quantity", "l_discount"])
    index = StringIndexer(inputCol="l_returnflag", outputCol="label", stringOrderType="alphabetAsc").fit(d)
    m = NaiveBayes(modelType="gaussian").fit(index.transform(d))
    rows = [(c, f, float(m.theta[i, j]), float(m.sigma[i, j])) for i, c in enumerate(index.labels)
            for j, f in enumerate(("l_quantity", "l_discount"))]
    return rounded(spark.createDataFrame(rows, "class string, feature string, mean double, variance double"), 4)


@register("i14_voting", f"""SELECT {KEY_SQL}, round((3 * l_quantity + 1 + 10 - 100 * l_discount) / 2, 3) AS vote FROM lineitem""")
def _vote(spark, sf):
    d = _vector(li(spark, sf), ["l_quantity", "l_discount"])
    models = [LinearRegression(solver="normal").fit(d.withColumn("label", F.expr(y)))
              for y in ("3 * l_quantity + 1", "10 - 100 * l_discount")]
    return rounded(sup.vote(models, d, "Regression").select(*KEY, F.col("prediction").alias("vote")), 3)


@register("l1_planted_scores", f"""SELECT {KEY_SQL}, round(3 * coalesce(l_quantity, 0) - 200 * l_discount + 500, 3) AS predicted
 FROM lineitem""")
def _scores(spark, sf):
    from .analyze import analyze, score
    d = li(spark, sf).withColumn("y", F.expr("3 * l_quantity - 200 * l_discount + 500"))
    a = analyze(d, target="y", models=["linear_regression"], n_iter=2, run_views=False, post_training=False)
    return rounded(score(a, d.drop("y")).select(*KEY, F.col("predicted_value").alias("predicted")), 3)


_KNN = """WITH f AS (SELECT c_custkey, c_acctbal / 1000.0 AS x, c_nationkey::DOUBLE AS z, c_mktsegment AS y FROM customer),
 t AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || c_custkey), c_custkey) AS o FROM f),
 n AS (SELECT f.c_custkey, t.y, row_number() OVER (PARTITION BY f.c_custkey
 ORDER BY (f.x - t.x) * (f.x - t.x) + (f.z - t.z) * (f.z - t.z), t.o) AS r FROM f, t),
 v AS (SELECT c_custkey, y, count(*) AS c FROM n WHERE r <= 5 GROUP BY ALL),
 w AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY c DESC, y) AS k FROM v)
 SELECT c_custkey, y AS prediction FROM w WHERE k = 1"""


@register("i5_knn", _KNN)
def _knn(spark, sf):
    d = _knn_rows(spark, sf)
    return NearestNeighbours(["x", "z"], "c_mktsegment", k=5).fit(d, ["c_custkey"]).transform(d).select("c_custkey", "prediction")


register("i5_knn_all", _KNN)(_knn)


@register("i5_knn_regression", """WITH f AS (SELECT c_custkey, c_acctbal AS y, c_nationkey::DOUBLE AS x, c_custkey::DOUBLE AS z FROM customer),
 t AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || c_custkey), c_custkey) AS o FROM f),
 n AS (SELECT f.c_custkey, t.y, abs(f.x - t.x) + abs(f.z - 0.5 - t.z) AS d, row_number() OVER (PARTITION BY f.c_custkey
 ORDER BY abs(f.x - t.x) + abs(f.z - 0.5 - t.z), t.o) AS r FROM f, t)
 SELECT c_custkey, round(sum(y / d) / sum(1 / d), 4) AS prediction FROM n WHERE r <= 7 GROUP BY 1""")
def _knn_regression(spark, sf):
    d = load(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("x"),
                                           F.col("c_custkey").cast("double").alias("z"))
    m = NearestNeighbours(["x", "z"], "c_acctbal", k=7, classify=False, weights="distance", norm=1).fit(d, ["c_custkey"])
    return rounded(m.transform(d.withColumn("z", F.col("z") - 0.5)).select("c_custkey", "prediction"), 4)


# ---------------------------------------------------------------- C5, J4
_NEAR = """p AS (SELECT c_custkey AS id, c_acctbal / 100.0 AS x, c_nationkey::DOUBLE AS z FROM customer),
 e AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) AS distance
 FROM p a JOIN p b ON a.z = b.z AND abs(a.x - b.x) <= {eps} AND a.id <> b.id
 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) <= {eps})"""


def _customers(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 100.0).alias("x"),
                                              F.col("c_nationkey").cast("double").alias("z"))


@register("c5_epsilon_pairs", f"WITH {_NEAR.format(eps=0.4)} SELECT a, b, round(distance, 6) AS distance FROM e WHERE a < b")
def _pairs(spark, sf):
    return rounded(epsilon_pairs(_customers(spark, sf), ["x", "z"], 0.4, "c_custkey"))


@register("j4_dbscan", f"""WITH RECURSIVE {_NEAR.format(eps=0.8)},
 k AS MATERIALIZED (SELECT id FROM p LEFT JOIN e ON id = a GROUP BY id HAVING count(b) + 1 >= 4),
 l AS MATERIALIZED (SELECT a, b FROM e WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k)),
 r AS (SELECT id, id AS other FROM k UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a),
 c AS (SELECT id, dense_rank() OVER (ORDER BY first) - 1 AS cluster FROM (SELECT id, min(other) AS first FROM r GROUP BY 1)),
 o AS (SELECT e.a AS id, min(cluster) AS cluster FROM e JOIN c ON c.id = e.b WHERE e.a NOT IN (SELECT id FROM k) GROUP BY 1)
 SELECT p.id AS c_custkey, coalesce(c.cluster, o.cluster, -1)::INT AS cluster FROM p LEFT JOIN c USING (id) LEFT JOIN o USING (id)""")
def _dbscan(spark, sf):
    return dbscan(_customers(spark, sf), ["x", "z"], 0.8, 4, "c_custkey").select("c_custkey", "cluster")


def _knn_rows(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000.0).alias("x"),
                                              F.col("c_nationkey").cast("double").alias("z"), "c_mktsegment")


# ---------------------------------------------------------------- H4
base.SQL["h4_feature_report"] = """WITH lv AS (SELECT DISTINCT c_mktsegment AS v FROM customer),
 d AS (SELECT v FROM lv WHERE v <> (SELECT min(v) FROM lv)),
 s AS (SELECT 'c_custkey' AS c, 0 AS o, abs(corr(c_custkey, c_acctbal)) AS s FROM customer
 UNION ALL SELECT 'c_nationkey', 1, abs(corr(c_nationkey, c_acctbal)) FROM customer
 UNION ALL SELECT 'c_mktsegment_' || v, 2, abs(corr((c_mktsegment = v)::INT, c_acctbal)) FROM customer, d GROUP BY v),
 r AS (SELECT c, row_number() OVER (ORDER BY s DESC, o, c) AS n FROM s),
 t AS (SELECT max(c) FILTER (n = 1) AS a, max(c) FILTER (n = 2) AS b FROM r)
 SELECT unnest([0, 1, 2, 3])::INT AS step, unnest(['separate_target', 'one_hot', 'interaction', 'square']) AS action,
 unnest(['c_acctbal', 'c_mktsegment', a || '_x_' || b, a || '_squared']) AS detail FROM t"""

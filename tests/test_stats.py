"""Exact quantiles on both paths, ranks, running sums, skew, mode."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabsight.functions import ranks, stats
from tabsight.operators import clean, profile
from tabsight.operators.schema import distinct_counts


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=3000), np.full(500, 1.25), rng.exponential(size=1500)])
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    want = np.percentile(vals, [p * 100 for p in probs])
    got = stats.quantiles(df, ["x"], probs)["x"]
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_quantiles_map_path(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 4, 9, 20]], "v double")
    q = stats.quantiles(df, ["v"], [0.25, 0.5])["v"]
    assert q == [2.0, 4.0]


def test_adjusted_skew_matches_pandas(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 4, 9, 20]], "v double")
    got = df.agg(stats.adjusted_skewness("v")).first()[0]
    assert abs(got - 1.4901199696128797) < 1e-12


def test_tied_mode_is_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",)], "s string")
    assert clean.modes(df, ["s"]) == {"s": "a"}


def test_label_order_code_points(spark):
    df = spark.createDataFrame([("x",), (None,), ("Z",), ("é",), ("x",)], "d string")
    codes = {r["value"]: r["code"] for r in clean.label_codes(df, ["d"]).collect()}
    assert sorted(codes, key=codes.get) == ["Z", "nan", "x", "é"]


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"v": rng.integers(0, 5000, 20000).astype(float)})
    g = spark.createDataFrame(pdf).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    one = pdf["v"].value_counts().sort_index().cumsum().to_dict()
    many = {r["v"]: r["cum_n"] for r in ranks.running_sums(g, "v", ["n"]).collect()}
    assert one == many
    desc = {r["v"]: r["cum_n"] for r in ranks.running_sums(g, "v", ["n"], descending=True).collect()}
    s = pdf["v"].value_counts().sort_index(ascending=False).cumsum()
    assert all(desc[k] == s[k] for k in s.index)


def test_average_ranks_match_pandas(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 3.0, 5.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = {r["v"]: r["rank"] for r in ranks.average_ranks(df, "v").collect()}
    want = dict(zip(vals, pd.Series(vals).rank(method="average")))
    assert got == want


def test_correlation_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "a double, b double")
    r = {(x["col_a"], x["col_b"]): x["corr"] for x in profile.correlation_long(df).collect()}
    assert r[("a", "b")] is None and abs(r[("a", "a")] - 1.0) < 1e-12


def test_distinct_counts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, None)], "i int, s string")
    assert distinct_counts(df, ["i", "s"]) == {"i": 2, "s": 1}


def test_median_beside_a_hot_value(spark):
    """Half of the rows are one value next to the wanted rank."""
    df = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.col("id") / 7.0).alias("x"))
    vals = [0.0 if i % 2 == 0 else i / 7.0 for i in range(60_000)]
    got = stats.quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"]
    assert np.allclose(got, np.quantile(vals, [0.25, 0.5, 0.75]), rtol=0, atol=1e-9)


def test_running_sums_over_text(spark):
    words = [f"w{i:05d}é" for i in range(3000)]
    g = spark.createDataFrame([(w, 1) for w in reversed(words)], "w string, n int")
    got = {r["w"]: r["cum_n"] for r in ranks.running_sums(g, "w", ["n"]).collect()}
    assert got == {w: i + 1 for i, w in enumerate(words)}


def test_distinct_counts_are_exact_when_large(spark):
    df = spark.range(150_000).select(F.col("id").alias("a"), (F.col("id") % 120_001).alias("b"))
    assert distinct_counts(df, ["a", "b"]) == {"a": 150_000, "b": 120_001}


def test_grouped_quantiles_with_a_hot_group(spark):
    import numpy as np
    from tabsight.functions.stats import grouped_quantiles
    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in rng.normal(size=900)] + [(None, 1.0), (None, 2.0), ("one", 5.0), ("none", None), ("nan", float("nan"))]
    rows += [("hot", 0.5)] * 500
    df = spark.createDataFrame(rows, "g string, v double").replace(float("nan"), None).repartition(6)
    got = {r["g"]: tuple(r)[1:] for r in grouped_quantiles(df, "g", "v", [0.0, 0.3, 0.5, 1.0]).collect()}
    hot = [v for g, v in rows if g == "hot"]
    assert set(got) == {"hot", None, "one"}
    assert np.allclose(got["hot"], np.quantile(hot, [0.0, 0.3, 0.5, 1.0]))
    assert np.allclose(got[None], [1.0, 1.3, 1.5, 2.0]) and got["one"] == (5.0, 5.0, 5.0, 5.0)

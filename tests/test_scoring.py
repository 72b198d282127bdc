"""Scoring rows that training did not look like, voting, and kept columns."""
import datetime as dt

from pyspark.sql import functions as F

from tabsight.models import supervised as sup
from tabsight.operators import clean
from tabsight.plans import plan
from tabsight.plans.analyze import analyze, score


def _planted(spark):
    rows = [(float(i % 50), (i % 11) / 100.0, "abc"[i % 3], dt.date(2020, 1, 1) + dt.timedelta(days=i % 400)) for i in range(600)]
    df = spark.createDataFrame(rows, "q double, d double, s string, day date")
    return df.withColumn("empty", F.lit(None).cast("double")).withColumn("arr", F.array(F.lit(1))).withColumn(
        "y", F.expr("3 * q - 200 * d + 5"))


def test_new_nulls_unseen_values_and_left_out_columns(spark):
    a = analyze(_planted(spark), target="y", models=["linear_regression", "random_forest"], n_iter=1, run_views=False,
                post_training=False, refit=False)
    assert a.errors["column empty"].startswith("left out") and a.errors["column arr"].startswith("left out")
    assert "day" in a.state["features"] and "voting" in {r["model"] for r in a.leaderboard.collect()}
    new = spark.createDataFrame([(10.0, 0.05, "a", dt.date(2020, 5, 1)), (None, 0.05, "zzz", None), (10.0, None, None, None)],
                                "q double, d double, s string, day date")
    for name in ("linear_regression", "voting"):
        a.best_model = name
        a.state["members"] = ["linear_regression", "random_forest"]
        got = score(a, new).collect()
        assert len(got) == 3
        assert all(r["predicted_value"] is not None and r["predicted_value"] == r["predicted_value"] for r in got)
    a.best_model = "linear_regression"
    first = [r for r in score(a, new).collect() if r["q"] == 10.0 and r["d"] == 0.05][0]
    assert abs(first["predicted_value"] - 25.0) < 1e-4


def test_vote_is_the_mean_of_all_members(spark):
    class Fixed:
        def __init__(self, p, as_array):
            self.p, self.as_array = p, as_array

        def transform(self, df):
            return df.withColumn("prediction", F.lit(0.0)).withColumn("probability", F.array(*[F.lit(x) for x in self.p]))

    df = spark.range(3)
    got = sup.vote([Fixed([0.9, 0.1], True), Fixed([0.2, 0.8], True), Fixed([0.1, 0.9], True)], df, "Classification", 2).collect()
    assert len(got) == 3 and all(r["prediction"] == 1.0 and abs(r["probability"][1] - 0.6) < 1e-12 for r in got)


def test_unseen_codes(spark):
    codes = spark.createDataFrame([("s", "a", 0), ("s", "b", 1)], "column_name string, value string, code int")
    df = spark.createDataFrame([("a",), ("x",)], "s string")
    assert sorted(r["s"] for r in clean.apply_codes(df, codes, ["s"], {"s": 2}).collect()) == [0, 2]


def test_plan_records_what_it_leaves_out(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 1.0, "b"), (3.0, 5.0, "a")], "x double, y double, s string")
    core = plan.core_plan(df, "y", "Regression")
    assert [s.plot_type for s in core][:3] == ["missingvalues", "distribution_grid", "boxplot"]
    extra = [{"plot_id": f"k{i}", "plot_type": "kde", "columns": ["x"]} for i in range(30)] + [{"plot_type": "nonsense"}]
    full = plan.full_plan(core, extra, df)
    assert len(full.specs) == plan.MAX_VIEWS
    why = [w for _, w in full.left_out]
    assert sum("over the limit" in w for w in why) == len(core) + 30 - plan.MAX_VIEWS and any("nonsense" in w for w in why)
    bad = plan.Spec("b", "scatterplot", ["x"])
    good = plan.Spec("g", "countplot", ["s"])
    out = plan.run_views([bad, good], df, "y")
    assert out[0][1] is None and "ViewRefused" in out[0][2] and out[1][1].count() == 2


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    from tabsight.sources import read_csv
    p = tmp_path / "t.csv"
    p.write_text('name,age\n"Miss ""Annie""",3\n"two\nlines",4\n', encoding="utf-8")
    rows = sorted(map(tuple, read_csv(spark, str(p)).collect()))
    assert rows == [('Miss "Annie"', 3), ("two\nlines", 4)]


def test_spearman_ranks_complete_pairs(spark):
    import pandas as pd
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, None, 6, 7, 2], "b": [2.0, None, 1, 5, 9, 3, 8, 4], "c": [8.0, 7, 6, 5, 4, 3, 2, 1]})
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)],
                               "a double, b double, c double")
    from tabsight.operators import views
    want = pdf.corr("spearman")
    for r in views.correlation(df, "spearman").collect():
        assert abs(r["corr"] - want.loc[r["col_a"], r["col_b"]]) < 1e-12


def test_calinski_harabasz_far_from_the_origin(spark):
    from tabsight.operators import metrics as met
    near = spark.range(300).select((F.col("id") % 3).cast("int").alias("cluster"), ((F.col("id") % 3) * 10 + F.col("id") % 7 / 7.0).alias("x"))
    far = near.withColumn("x", F.col("x") + 1e9)
    a, b = (met.calinski_harabasz(d, ["x"]).first()[0] for d in (near, far))
    assert abs(a - b) / a < 1e-5

"""CSV inference with pandas tokens, cleaning report, split, plan sanitising."""
from pyspark.sql import functions as F

from tabsight.operators import clean, split
from tabsight.plans import plan
from tabsight.sources.scan import read_csv


def test_csv_tokens(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,c,d,e\n1,NA,true,x,\n2,nan,False,,\n,4,TRUE,y,\n")
    df = read_csv(spark, str(p))
    types = dict(df.dtypes)
    # integers with missing values keep an integer type (pandas would widen to float64)
    assert types == {"a": "bigint", "b": "bigint", "c": "boolean", "d": "string", "e": "double"}
    rows = df.orderBy(F.col("a").asc_nulls_last()).collect()
    assert rows[0]["b"] is None and rows[2]["b"] == 4 and rows[1]["d"] is None


def test_clean_report_no_action(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "a int, b double")
    r = clean.clean(df).report.collect()
    assert [x["action"] for x in r] == ["no_cleaning_needed"]


def test_clean_all_null_numeric_stays_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b double")
    res = clean.clean(df)
    assert {x["action"] for x in res.report.collect()} == {"all_null_numeric_left"}
    assert res.data.filter("b is null").count() == 2


def test_split_disjoint_complete(spark):
    df = spark.range(5000).withColumn("y", F.col("id") % 7)
    s = split.train_test_split(df, 0.2, 42)
    n_test = s.filter("is_test").count()
    assert s.count() == 5000 and 800 < n_test < 1200
    again = split.train_test_split(df.repartition(7), 0.2, 42).filter("is_test").count()
    assert again == n_test


def test_sanitize_plan(spark):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    specs = plan.sanitize([{"plot_id": "p", "plot_type": "HISTOGRAM", "columns": ["x", "nope"], "params": 3},
                           {"plot_id": "p", "plot_type": "boxplot", "columns": ["x"]},
                           {"plot_type": "unknown"}], df)
    assert [(s.plot_id, s.plot_type, s.columns, s.params) for s in specs] == [
        ("p", "histogram", ["x"], {}), ("p_2", "boxplot", ["x"], {})]

"""A saved analysis scores alike, here and in another process."""
import os
import subprocess
import sys

import pytest

from tabsight.plans.analyze import analyze, score
from tabsight.plans.bundle import load_analysis, save_analysis
from tabsight.session import scratch_path

ROWS = [(float(i % 20), float(i % 7), "uvw"[i % 3], float(3 * (i % 20) + (i % 7)), "no" if i % 20 < 10 else "yes") for i in range(240)]
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

READER = """
import sys
from tabsight.session import local_session
from tabsight.plans.analyze import score
from tabsight.plans.bundle import load_analysis
spark = local_session(2, **{"spark.sql.shuffle.partitions": "2"})
path, rows, target = sys.argv[1:4]
got = score(load_analysis(spark, path), spark.read.parquet(rows)).orderBy("a", "b", "c").collect()
print("SCORES", [str(r["predicted_value"]) for r in got])
"""


def values(df):
    return [str(r["predicted_value"]) for r in df.orderBy("a", "b", "c").collect()]


@pytest.mark.parametrize("target,model", [("y", "linear_regression"), ("y", "adaboost"), ("y", "knn"), ("z", "random_forest"), ("z", "adaboost"),
                                          ("z", "voting")])
def test_saved_analysis_scores_alike(spark, target, model):
    df = spark.createDataFrame(ROWS, "a double, b double, c string, y double, z string").drop("z" if target == "y" else "y")
    names = ["random_forest", "logistic_regression"] if model == "voting" else [model]
    a = analyze(df, target=target, models=names, n_iter=1, run_views=False, post_training=False)
    a.best_model = model
    path = scratch_path(spark, "bundle")
    save_analysis(a, path)
    new = df.drop(target).distinct().orderBy("a", "b", "c").limit(25)
    want = values(score(a, new))
    assert len(want) == 25
    assert values(score(load_analysis(spark, path), new)) == want
    if model == "voting":
        rows = scratch_path(spark, "rows")
        new.write.parquet(rows)
        out = subprocess.run([sys.executable, "-c", READER, path, rows, target], cwd=REPO, capture_output=True, text=True, timeout=240)
        assert f"SCORES {want}" in out.stdout, out.stderr[-2000:]


def test_bundle_refuses_what_it_cannot_score(spark):
    df = spark.createDataFrame(ROWS, "a double, b double, c string, y double, z string").select("a", "b")
    a = analyze(df, run_views=False, models=["kmeans"])
    with pytest.raises(ValueError):
        save_analysis(a, scratch_path(spark, "bundle"))

import json
import math
import re

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from cohortlab import GRADUATES as G
from cohortlab.operators import features, learn, score
from cohortlab.plans.score import scores
from cohortlab.plans.train import train
from cohortlab.session import scratch
from cohortlab.sources import bundle as bundles
from cohortlab.sources import tables

TREES = {"maxIter": 8, "maxDepth": 3, "stepSize": 0.4}


@pytest.fixture(scope="module")
def fitted(graduates):
    return train(graduates, G, tune=False, **TREES)


def test_fixed_parameters():
    assert learn.UNTUNED == {"maxIter": 200, "maxDepth": 5, "stepSize": 0.05}
    assert math.prod(len(v) for v in learn.GRID.values()) * learn.FOLDS == 40


def test_learner_finds_the_planted_signal(fitted, graduates):
    assert {n for n, _ in fitted.importance[:2]} == {"skill_score", "college_tier"}
    assert fitted.metrics["r2"] > 0.9
    split = features.split(graduates.where("placed = 1").withColumn("a", F.log1p("salary_lpa")), G)
    baseline = learn.segment_mean_scores(split.where("part = 'train'"), split.where("part = 'test'"), G, "a")
    worse = learn.regression_metrics(baseline, "a", "predicted_log").first()
    assert worse["n"] == fitted.metrics["n"] and fitted.metrics["mae"] < worse["mae"] / 2


def test_metrics_by_hand(spark):
    y, p = np.array([10.0, 20.0, 60.0]), np.array([12.0, 18.0, 50.0])
    df = spark.createDataFrame(
        [(float(a), float(b)) for a, b in zip(np.log1p(y), np.log1p(p), strict=True)], "a double, p double"
    )
    row = learn.regression_metrics(df, "a", "p").first()
    assert row["r2"] == round(1 - 108 / 1400, 4)
    assert (row["mae"], row["rmse"], row["mape"]) == (4.67, 6.0, 15.56)
    assert (row["mean_actual"], row["mean_predicted"], row["n"]) == (30.0, 26.67, 3)


def test_metrics_without_spread_or_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, p double")
    assert learn.regression_metrics(df, "a", "p").first()["r2"] is None
    empty = learn.regression_metrics(df.where("false"), "a", "p").first()
    assert empty["n"] == 0 and empty["mae"] is None


def test_save_and_load(spark, fitted, graduates, tmp_path):
    path = str(tmp_path / "model")
    bundles.save(spark, fitted, G, path)
    again = bundles.load(spark, path)
    assert again.feature_names == fitted.feature_names
    assert again.importance == fitted.importance and again.metrics == fitted.metrics
    columns = ["student_id", "predicted_value"]
    before = score.predict(graduates, fitted.model, G).select(columns).orderBy("student_id").collect()
    after = score.predict(graduates, again.model, G).select(columns).orderBy("student_id").collect()
    assert before == after
    importance = bundles.feature_importance(spark, path).collect()
    assert [r["feature"] for r in importance] == [n for n, _ in fitted.importance]
    assert bundles.top_importance(spark, path, 10).count() == 10
    assert bundles.model_metrics(spark, path).first()["r2"] == fitted.metrics["r2"]


def test_metadata_file(spark, fitted, tmp_path):
    path = tmp_path / "model"
    bundles.save(spark, fitted, G, str(path))
    parts = list((path / "metadata").glob("part-*.json"))
    assert len(parts) == 1
    meta = json.loads(parts[0].read_text())
    assert meta["segment_reference"] == "CSE"
    assert meta["segment_categories"] == ["CSE", "Civil", "ECE", "EEE", "IT", "Mechanical"]
    assert meta["numerical_cols"] == list(G.numeric) and meta["binary_cols"] == list(G.binary)
    assert meta["ordinal_cols"] == ["college_tier"] and meta["log_transform"] is True
    assert len(meta["feature_names"]) == len(meta["feature_importance"]) == 19
    assert meta["metrics"]["n"] == fitted.metrics["n"]


def test_load_without_model(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="Run the training job"):
        bundles.load(spark, str(tmp_path / "nothing"))


def test_grid_search(graduates):
    grid = {"maxIter": [1, 6], "maxDepth": [2], "stepSize": [0.3], "subsamplingRate": [0.9]}
    assert set(grid) == set(learn.GRID)
    bundle = train(graduates, G, tune=True, grid=grid, folds=2)
    assert [(t["maxIter"], t["is_best"]) for t in bundle.grid] == [(1, False), (6, True)]
    table = learn.grid_table(graduates, bundle.grid)
    assert table.columns == [*grid, "mae_log", "is_best"] and table.count() == 2


def test_fit_scope(graduates):
    rows = features.split(graduates.where("placed = 1"), G)
    part = features.fit_encoding(rows.where("part = 'train'"), G)
    everything = features.fit_encoding(rows, G)
    assert part.means != everything.means
    bundle = train(graduates, G, tune=False, fit_scope="all", maxIter=1, maxDepth=1)
    statement = bundle.model.stages[0].getStatement()
    used = float(re.search(r"CAST\(`cgpa` AS DOUBLE\)\) - CAST\('([^']+)'", statement).group(1))
    assert math.isclose(used, everything.means[everything.names.index("cgpa")], rel_tol=1e-12)


def test_untrained_rows_are_scored_too(fitted, graduates, make):
    assert scores(graduates, fitted, G).count() == 800
    odd = make({"branch": "Physics"}, {"branch": "CSE"}, {"branch": None})
    rows = score.predict(odd, fitted.model, G).orderBy("student_id").collect()
    assert {r["branch_clean"] for r in rows} == {"CSE"} and len({r["predicted_value"] for r in rows}) == 1
    assert [r["branch"] for r in rows] == ["Physics", "CSE", None]


def test_scoring_job_fills_missing_features(fitted, make):
    rows = scores(make({"cgpa": None, "skill_score": None}, {}), fitted, G).collect()
    assert rows[0]["predicted_value"] == rows[1]["predicted_value"]
    assert rows[0]["band"] is not None and len(rows[0]["top_factors"]) == 3


def test_scoring_is_one_narrow_pass(spark, fitted, graduates, tmp_path):
    path = str(tmp_path / "p")
    graduates.write.parquet(path)
    plan = scores(spark.read.parquet(path), fitted, G)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "salary_lpa" not in plan and "job_role" not in plan


def test_one_profile_given_by_hand(spark, fitted):
    low, high = ({**G.defaults, "skill_score": s} for s in (0, 4))
    rows = scores(tables.from_dicts(spark, [low, high], G), fitted, G).orderBy("student_id").collect()
    assert rows[0]["predicted_value"] < rows[1]["predicted_value"]
    assert rows[1]["predicted_log"] == round(rows[1]["predicted_log"], 4)
    assert rows[0]["top_factors"][0]["feature"] == "skill_score"


def learning_table(spark, n=300):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 3)).round(2)
    y = 2 * x[:, 0] + np.where(x[:, 1] > 0.3, 1.0, 0.0) + rng.normal(size=n) * 0.2
    rows = [(Vectors.dense(*map(float, a)), float(b), i % 2) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    schema = StructType([StructField("features", VectorUDT()), StructField("label", DoubleType()), StructField("fold", IntegerType())])
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_removed_loss_is_the_fall_of_the_training_error(spark):
    """Without sampling, what all splits take away is the squared error about the mean less the last one."""
    rows = learning_table(spark).select("features", "label")
    trees = learn.fit_trees(rows, maxIter=12, maxDepth=3, stepSize=0.3)
    with scratch(spark, "trees") as path:
        trees.save(path)
        removed = {r[0]: r[1] for r in learn.removed_loss(spark.read.parquet(f"{path}/data"), trees.treeWeights).collect()}
    first, last = rows.agg(F.var_pop("label") * F.count("*")).first()[0], trees.evaluateEachIteration(rows, "squared")[-1]
    assert sum(removed.values()) == pytest.approx(first - last * rows.count(), rel=1e-9)
    shares = learn.importances(trees, ["a", "b", "c"], spark)
    assert [n for n, _ in shares] == ["a", "b", "c"] and sum(x for _, x in shares) == pytest.approx(1, abs=1e-5)
    assert dict(shares)["a"] == pytest.approx(removed[0] / sum(removed.values()), abs=1e-6)


def test_importance_ties_in_feature_order(spark):
    """A constant target has no split, and nothing is divided by zero."""
    flat = learning_table(spark, 20).select("features", F.lit(1.0).alias("label"))
    assert learn.importances(learn.fit_trees(flat, maxIter=2), ["q", "p", "r"], spark) == [("q", 0.0), ("p", 0.0), ("r", 0.0)]


def test_prefix_errors_are_those_of_smaller_fits(spark):
    """With sampling too, the first trees of a longer boost are those of a shorter one."""
    rows = learning_table(spark)
    given = {"maxDepth": 3, "stepSize": 0.1, "subsamplingRate": 0.9}
    long = learn.staged_errors(rows, 0, maxIter=9, **given)
    for n in (1, 4):
        short = learn.regressor(maxIter=n, **given).fit(rows.where("fold != 0").select("features", "label"))
        mae = short.transform(rows.where("fold = 0")).agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]
        assert long[n - 1] == pytest.approx(mae, rel=1e-12)


def test_grid_shares_fits(spark, monkeypatch):
    asked = []
    errors = learn.staged_errors

    def counted(rows, fold, **params):
        asked.append((fold, tuple(sorted(params.items()))))
        return errors(rows, fold, **params)

    monkeypatch.setattr(learn, "staged_errors", counted)
    model, table = learn.tune_trees(learning_table(spark), {"maxIter": [2, 6], "maxDepth": [1, 2]}, k=2, parallelism=2)
    assert len(asked) == 4 and all(dict(p)["maxIter"] == 6 for _, p in asked)
    assert [(t["maxIter"], t["maxDepth"]) for t in table] == [(2, 1), (2, 2), (6, 1), (6, 2)]
    best = next(t for t in table if t["is_best"])
    assert best["mae_log"] == min(t["mae_log"] for t in table) and len(model.trees) == best["maxIter"]
    without, one = learn.tune_trees(learning_table(spark), {"maxDepth": [1], "maxIter": [3]}, k=2)
    assert len(one) == 1 and one[0]["is_best"] and len(without.trees) == 3


def test_few_rows_in_few_tasks(spark):
    rows = spark.range(1000).repartition(8)
    assert learn.in_few_tasks(rows, 1000).rdd.getNumPartitions() == 1
    assert learn.in_few_tasks(rows, 3 * learn.ROWS_PER_TASK).rdd.getNumPartitions() == 3
    assert learn.in_few_tasks(rows, 10**9).rdd.getNumPartitions() == 8

"""Boosts that grow together against one fit of Spark's learner each."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from test_learn import learning_table

from cohortlab.operators import boosts, learn

GRID = {"maxIter": [3, 8], "maxDepth": [2, 4], "stepSize": [0.3], "subsamplingRate": [0.8]}


def alone(rows, fold, **params):
    """Errors after each tree of a fit by Spark's learner."""
    model = learn.regressor(**params).fit(rows.where(F.col("fold") != fold).select("features", "label"))
    return model.evaluateEachIteration(rows.where(F.col("fold") == fold).select("features", "label"), "absolute")


def odd_rows(spark, n=400):
    """Few distinct values, so that many splits are equal; a constant feature; rows that come twice."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 3, n), rng.integers(0, 2, n), np.ones(n), rng.normal(size=n), rng.integers(0, 40, n)])
    x[n // 2 :] = x[: n - n // 2]
    y = x[:, 0] - 0.5 * x[:, 1] + np.round(rng.normal(size=n), 1)
    rows = [(Vectors.dense(*map(float, a)), float(b), i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, learning_table(spark, 1).schema).coalesce(1).cache()


def test_numbers_are_those_of_spark(spark):
    generator = spark._jvm.org.apache.spark.util.random.XORShiftRandom()
    for seed in (0, 43, -7, 2**40 + 5):
        generator.setSeed(seed)
        wanted = [generator.nextDouble() for _ in range(300)]
        draws = boosts.Draws(seed)
        draws.until(1)
        assert draws.until(300)[:300].tolist() == wanted


@pytest.mark.parametrize("make", [learning_table, odd_rows])
def test_grid_and_model_are_those_of_single_fits(spark, make):
    rows = make(spark)
    k = rows.select("fold").distinct().count()
    model, table = learn.tune_trees(rows, GRID, k=k)
    for t in table:
        params = {n: t[n] for n in GRID}
        assert t["mae_log"] == pytest.approx(sum(alone(rows, f, **params)[-1] for f in range(k)) / k, rel=1e-12)
    learner = learn.regressor(**{n: next(t for t in table if t["is_best"])[n] for n in GRID})
    single = learner.fit(rows.select("features", "label"))
    assert model.toDebugString.split("\n")[1:] == single.toDebugString.split("\n")[1:]
    assert model.treeWeights == single.treeWeights and model.numFeatures == single.numFeatures
    names = [str(i) for i in range(model.numFeatures)]
    assert learn.importances(model, names, spark) == learn.importances(single, names, spark)
    assert {p.name: v for p, v in model.extractParamMap().items()} == {p.name: v for p, v in single.extractParamMap().items()}


def test_a_grid_is_not_a_job_for_every_level_of_every_fit(spark):
    """Before, the 4 fits and the last one were 40 trees with a job for each of their levels."""
    rows = learning_table(spark).cache()
    rows.count()
    spark.sparkContext.setJobGroup("whole-grid", "")
    learn.tune_trees(rows, GRID, k=2)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("whole-grid")) < 40


@pytest.mark.parametrize("direct", [1, 16])
def test_many_rows_stay_in_their_partitions(spark, monkeypatch, direct):
    """Passes over partitions of several blocks, lineage cut on the way, sums of one side from the other's."""
    rows = learning_table(spark, 900).repartition(3, "fold", "label").cache()
    wanted = [boosts.Boost(f, 7, d, 0.3, 0.9) for d in (2, 4) for f in (0, 1, None)]
    held = learn.grow_together(rows, wanted, 2).found
    monkeypatch.setattr(boosts, "HELD", 0)
    monkeypatch.setattr(boosts, "DIRECT", direct)
    monkeypatch.setattr(learn, "CHECKPOINTS", 3)
    learn.shared_folder(spark)
    spread = learn.grow_together(rows, wanted, 2).found
    for b in wanted:
        assert spread[b][0] == pytest.approx(held[b][0], rel=1e-9)
        assert [t.splits for t in spread[b][1]] == [t.splits for t in held[b][1]]
        if b.fold is not None:
            assert spread[b][0] == pytest.approx(alone(rows, b.fold, maxIter=7, maxDepth=b.depth, stepSize=0.3, subsamplingRate=0.9), rel=1e-6)


def test_blocks_of_a_partition(spark, monkeypatch):
    """The rows drawn for a tree do not depend on how a partition is cut into blocks."""
    rows = learning_table(spark, 500).select("features", "label", "fold").cache()
    layout = boosts.layout_of(rows, learn.regressor(), [0, None])
    group = [boosts.Boost(0, 1, 1, 0.1, 0.7), boosts.Boost(None, 1, 1, 0.1, 0.7)]

    def drawn(size):
        monkeypatch.setattr(boosts, "BLOCK", size)
        x = np.array([r["features"].toArray() for r in rows.collect()])
        y, fold = (np.array([r[c] for r in rows.collect()]) for c in ("label", "fold"))
        cuts = [slice(i, i + size) for i in range(0, 500, size)]
        packed = [{"n": len(y[c]), "x": x[c].T.copy().tobytes(), "label": y[c].tobytes(), "fold": fold[c].astype(np.int32).tobytes()} for c in cuts]
        started = [boosts._started(b, group) for b in boosts._binned(layout, iter(packed))]
        done = list(boosts._advanced(layout, group, 42, None, 5, iter(started)))
        return {k: np.concatenate([b["drawn"][k, 0.7] for b in done]).tolist() for k in (0, None)}

    assert drawn(500) == drawn(64)


@pytest.mark.parametrize("params", [{"maxDepth": 6}, {"lossType": "absolute"}, {"minInstancesPerNode": 20}])
def test_other_parameters_are_for_the_learner_alone(spark, params):
    rows = learning_table(spark).cache()
    assert learn.boost_of(rows, 0, maxIter=3, **params) is None
    assert learn.staged_errors(rows, 0, maxIter=3, **params) == pytest.approx(list(alone(rows, 0, maxIter=3, **params)), rel=1e-12)
    model, table = learn.tune_trees(rows, {"maxIter": [3]} | {n: [v] for n, v in params.items()}, k=2)
    assert len(model.trees) == 3 and len(table) == 1


def test_constant_target_has_no_split(spark):
    flat = learning_table(spark, 20).withColumn("label", F.lit(1.0)).cache()
    assert learn.staged_errors(flat, 0, maxIter=3, maxDepth=2) == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("bad", ["nan", "infinity", None])
@pytest.mark.parametrize("fold", [0, 1])
def test_rows_that_cannot_be_fitted(spark, bad, fold):
    label = F.when(F.col("fold") == 0, F.lit(bad).cast("double")).otherwise(F.col("label"))
    with pytest.raises(PySparkException):
        learn.staged_errors(learning_table(spark, 30).withColumn("label", label), fold, maxIter=2)


def test_folds_without_rows(spark):
    with pytest.raises(ValueError, match="no rows in the folds"):
        learn.staged_errors(learning_table(spark, 30), 7, maxIter=2)

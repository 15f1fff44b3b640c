"""Fitting, tuning and evaluating the boosted-tree regressor."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.scalars import round_even
from cohortlab.operators import boosts
from cohortlab.operators.features import SEED, Encoding, double, quoted
from cohortlab.session import scratch, shared_folder
from cohortlab.spec import CohortSpec

# The untuned parameters, the grid and the number of folds.
UNTUNED = {"maxIter": 200, "maxDepth": 5, "stepSize": 0.05}
GRID = {"maxIter": [100, 200], "maxDepth": [4, 5], "stepSize": [0.05, 0.1], "subsamplingRate": [0.9]}
FOLDS = 5
# Split candidates per feature, unless a fit is given others.
MAX_BINS = 64
# Trees between two checkpoints, which cut the lineage of the residuals.
CHECKPOINTS = 50
# Rows of a learning table that are worth a task of their own: every level of every tree is a job over all tasks.
ROWS_PER_TASK = 50_000


@dataclass(frozen=True)
class Bundle:
    """A fitted model with what is needed to explain its scores."""

    model: PipelineModel
    feature_names: list[str]
    categories: list[str]
    importance: list[tuple[str, float]]
    metrics: dict[str, float] = field(default_factory=dict)
    grid: list[dict[str, Any]] = field(default_factory=list)


def encoder_stages(encoding: Encoding) -> list[Transformer]:
    """Clean, encode, standardise and assemble, as stages that are saved with the model.

    The standardised columns are ``z_0``, ``z_1`` and so on in feature order.
    """
    columns = [f"{encoding.clean_sql()} AS {quoted(f'{encoding.spec.segment}_clean')}"]
    columns += [f"{sql} AS z_{i}" for i, sql in enumerate(encoding.scaled_sql().values())]
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__"),
        VectorAssembler(
            inputCols=[f"z_{i}" for i in range(len(encoding.names))], outputCol="features"
        ),
    ]


def original_scale() -> Transformer:
    """From the predicted logarithm back to the target, without bias correction."""
    return SQLTransformer(
        statement="SELECT * EXCEPT (features, prediction), prediction AS predicted_log, "
        "rint(expm1(prediction) * 100D) / 100D AS predicted_value FROM __THIS__"
    )


def scoring_model(encoding: Encoding, learned: Transformer) -> PipelineModel:
    return PipelineModel([*encoder_stages(encoding), learned, original_scale()])


def weighted_sum(encoding: Encoding, weights: Mapping[str, float], intercept: float) -> PipelineModel:
    """A scoring model with given weights of the standardised features instead of learned trees."""
    terms = [
        f"{double(weights[n])} * z_{i}" for i, n in enumerate(encoding.names) if n in weights
    ]
    rule = f"SELECT *, {' + '.join([double(intercept), *terms])} AS prediction FROM __THIS__"
    return scoring_model(encoding, SQLTransformer(statement=rule))


def learning_rows(df: DataFrame, encoding: Encoding, *keep: str) -> DataFrame:
    """``features`` and ``label`` of rows that all have a positive outcome."""
    rows = df.withColumn("label", F.log1p(encoding.spec.target))
    return PipelineModel(encoder_stages(encoding)).transform(rows).select("features", "label", *keep)


def regressor(**params: Any) -> GBTRegressor:
    """Squared error; the tree statistics are merged in tasks, the driver sees only histograms.

    ``params`` are those of Spark's learner. ``maxBins`` (``MAX_BINS`` by default) bounds the split candidates of a
    feature: its values are cut into that many ranges with about as many rows each.
    """
    settings = {"lossType": "squared", "seed": SEED, "maxBins": MAX_BINS, "checkpointInterval": CHECKPOINTS}
    return GBTRegressor(featuresCol="features", labelCol="label", **(settings | params))


def fit_trees(rows: DataFrame, **params: Any) -> GBTRegressionModel:
    shared_folder(rows.sparkSession)
    return regressor(**(UNTUNED | params)).fit(rows)


def in_few_tasks(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows in no more partitions than they are worth."""
    return rows.coalesce(max(1, -(-n // ROWS_PER_TASK)))


# Parameters that may differ between boosts that grow together.
TOGETHER = {"maxIter", "maxDepth", "stepSize", "subsamplingRate"}


@dataclass(frozen=True)
class Grown:
    """Boosts of the same rows that were grown together: errors on the fold left out, or trees, of each."""

    layout: boosts.Layout
    found: dict[boosts.Boost, tuple[list[float], list[boosts.Tree]]]


def boost_of(rows: DataFrame, fold: int | None, **params: Any) -> boosts.Boost | None:
    """The boost that Spark's learner fits to the rows of all other folds; none if it can only do so itself."""
    learner = regressor(**params)
    kinds = rows.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    depth, trees = learner.getMaxDepth(), learner.getMaxIter()
    if set(params) - TOGETHER or {"nominal", "binary"} & set(kinds) or not 1 <= depth <= boosts.DEEPEST or trees < 1:
        return None
    return boosts.Boost(fold, trees, depth, learner.getStepSize(), learner.getSubsamplingRate())


def at_once(rows: DataFrame) -> int:
    """How many jobs over the rows leave each of them a core for every partition."""
    return max(1, rows.sparkSession.sparkContext.defaultParallelism // rows.rdd.getNumPartitions())


def grow_together(rows: DataFrame, wanted: Sequence[boosts.Boost], parallelism: int | None = None) -> Grown:
    """Fit the boosts in ``parallelism`` groups. Those of one group share every pass over the rows."""
    learner, folds = regressor(), list(dict.fromkeys(b.fold for b in wanted))
    layout = boosts.layout_of(rows, learner, folds)
    if parallelism is None:
        alone = layout.rows <= boosts.HELD
        parallelism = rows.sparkSession.sparkContext.defaultParallelism if alone else at_once(rows)
    # Boosts of one fold share the rows drawn for a tree.
    ordered = sorted(wanted, key=lambda b: folds.index(b.fold))
    size = -(-len(ordered) // parallelism)
    groups = [ordered[i : i + size] for i in range(0, len(ordered), size)]
    return Grown(layout, boosts.grow(rows, layout, groups, learner.getSeed(), CHECKPOINTS))


def staged_errors(rows: DataFrame | Grown, fold: int, **params: Any) -> list[float]:
    """Mean absolute error on a fold after 1, 2, 3 and so on of the trees fitted to the other folds.

    A boost of 100 trees is the first half of one of 200, so one fit tells the errors of all smaller numbers of trees.
    ``rows`` may be boosts that have been grown already.
    """
    if isinstance(rows, Grown):
        learner = regressor(**params)
        boost = boosts.Boost(fold, learner.getMaxIter(), learner.getMaxDepth(), learner.getStepSize(), learner.getSubsamplingRate())
        return rows.found[boost][0]
    boost = boost_of(rows, fold, **params)
    if boost is not None:
        shared_folder(rows.sparkSession)
        return grow_together(rows, [boost]).found[boost][0]
    model = regressor(**params).fit(rows.where(F.col("fold") != fold).select("features", "label"))
    return list(model.evaluateEachIteration(rows.where(F.col("fold") == fold).select("features", "label"), "absolute"))


def tune_trees(
    rows: DataFrame,
    grid: Mapping[str, Sequence[Any]] | None = None,
    k: int = FOLDS,
    parallelism: int | None = None,
) -> tuple[GBTRegressionModel, list[dict[str, Any]]]:
    """Cross-validated grid on the log scale: best model refitted on all rows, and every mean error.

    ``rows`` has a ``fold`` column in ``[0, k)``, see ``features.folds``. The numbers of trees of the grid share one fit
    per fold and other parameters, and the fits to all rows grow beside those to the folds. ``parallelism`` groups of
    fits run at once; by default one for each core if a task holds all rows, otherwise as many as leave each of them a
    core for every partition of the rows. Equal errors: the first combination is the best.
    """
    shared_folder(rows.sparkSession)
    grid = {name: list(values) for name, values in (grid or GRID).items()}
    points = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    default = regressor().getMaxIter()
    fits: dict[tuple, int] = {}
    for point in points:
        others = tuple((n, v) for n, v in point.items() if n != "maxIter")
        fits[others] = max(fits.get(others, 0), point.get("maxIter", default))
    jobs = [(others, fold) for others in fits for fold in range(k)]
    wanted = {(others, fold): boost_of(rows, fold, **dict(others), maxIter=fits[others]) for others in fits for fold in (*range(k), None)}
    grown = grow_together(rows, list(dict.fromkeys(wanted.values())), parallelism) if all(wanted.values()) else None

    def errors(job: tuple) -> list[float]:
        others, fold = job
        return staged_errors(grown or rows, fold, **dict(others), maxIter=fits[others])

    with ThreadPoolExecutor(min(len(jobs), parallelism or at_once(rows))) as pool:
        by_job = dict(zip(jobs, pool.map(inheritable_thread_target(rows.sparkSession)(errors), jobs), strict=True))
    table = []
    for point in points:
        others = tuple((n, v) for n, v in point.items() if n != "maxIter")
        trees = point.get("maxIter", default)
        table.append(point | {"mae_log": sum(by_job[others, fold][trees - 1] for fold in range(k)) / k})
    best = min(t["mae_log"] for t in table)
    for t in table:
        t["is_best"] = t["mae_log"] == best
    chosen = points[next(i for i, t in enumerate(table) if t["is_best"])]
    learner = regressor(**chosen)
    if grown is None:
        return learner.fit(rows.select("features", "label")), table
    whole = wanted[tuple((n, v) for n, v in chosen.items() if n != "maxIter"), None]
    trees = grown.found[whole][1][: learner.getMaxIter()]
    return boosts.model_of(rows.sparkSession, learner, grown.layout, None, trees, whole.step), table


def grid_table(df: DataFrame, table: Sequence[Mapping[str, Any]]) -> DataFrame:
    """The tried combinations, one row each."""
    names = [n for n in table[0] if n not in ("mae_log", "is_best")]
    rows = [(*(float(t[n]) for n in names), float(t["mae_log"]), bool(t["is_best"])) for t in table]
    schema = ", ".join([*(f"{n} double" for n in names), "mae_log double", "is_best boolean"])
    out = df.sparkSession.createDataFrame(rows, schema)
    return out.withColumn("mae_log", round_even(F.col("mae_log"), 4))


def removed_loss(nodes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``(feature_index, removed)``: the squared error that the splits on each feature take away, over all trees.

    ``nodes`` is the node table of a saved model, ``weights`` the step of each tree. A node's gain times its rows is what
    it takes away if its tree is added in full. The first tree is; the others are fitted to doubled residuals and added
    with a step ``v``, which takes away ``v * (1 - v)`` of that. So late trees, which fit what is left, count for little.
    """
    shares = [(i, 1.0 if i == 0 else float(v) * (1.0 - float(v))) for i, v in enumerate(weights)]
    # One row per tree.
    steps = F.broadcast(nodes.sparkSession.createDataFrame(shares, "treeID int, share double"))
    splits = nodes.where("nodeData.split.featureIndex >= 0").join(steps, "treeID")
    gain = F.col("nodeData.gain") * F.col("nodeData.impurityStats")[0] * F.col("share")
    return splits.groupBy(F.col("nodeData.split.featureIndex").alias("feature_index")).agg(F.sum(gain).alias("removed"))


def importances(learned: GBTRegressionModel, names: Sequence[str], spark: SparkSession) -> list[tuple[str, float]]:
    """Feature and share of the removed squared error, highest first, ties in feature order."""
    with scratch(spark, "trees") as path:
        learned.save(path)
        removed = removed_loss(spark.read.parquet(f"{path}/data"), learned.treeWeights).collect()
    by_index = {r["feature_index"]: r["removed"] for r in removed}
    total = sum(by_index.values()) or 1.0
    pairs = [(n, by_index.get(i, 0.0) / total) for i, n in enumerate(names)]
    return [(n, round(x, 6)) for n, x in sorted(pairs, key=lambda p: -p[1])]


def regression_metrics(df: DataFrame, actual_log: str, predicted_log: str) -> DataFrame:
    """One row of errors on the original scale, from one aggregation."""
    pairs = df.select(
        F.expm1(actual_log).alias("y"), F.expm1(predicted_log).alias("p")
    ).withColumn("e", F.col("y") - F.col("p"))
    e, y = F.col("e"), F.col("y")
    squares = F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0))
    return pairs.agg(
        round_even(1 - F.sum(e * e) / squares, 4).alias("r2"),
        round_even(F.avg(F.abs(e)), 2).alias("mae"),
        round_even(F.sqrt(F.avg(e * e)), 2).alias("rmse"),
        round_even(F.avg(F.abs(e / (y + 1e-8))) * 100, 2).alias("mape"),
        round_even(F.avg("y"), 2).alias("mean_actual"),
        round_even(F.avg("p"), 2).alias("mean_predicted"),
        F.count(F.lit(1)).alias("n"),
    )


def segment_mean_scores(
    train: DataFrame, test: DataFrame, spec: CohortSpec, actual_log: str
) -> DataFrame:
    """Baseline: the mean logarithm of the target in the row's segment of the training part; the mean of all
    training rows for a segment without any.

    Only listed segments get a mean, so the broadcast side has at most one row for each of them.
    """
    listed = train.where(F.col(spec.segment).isin(*spec.segments))
    means = listed.groupBy(spec.segment).agg(F.avg(actual_log).alias("predicted_log"))
    overall = train.agg(F.avg(actual_log)).scalar()
    scored = test.join(F.broadcast(means), spec.segment, "left")
    return scored.withColumn("predicted_log", F.coalesce("predicted_log", overall))

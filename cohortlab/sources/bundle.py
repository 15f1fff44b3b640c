"""Saving and loading a fitted model with its metadata."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators.learn import Bundle
from cohortlab.spec import CohortSpec

METADATA = (
    "feature_names array<string>, segment_categories array<string>, segment_reference string, "
    "numerical_cols array<string>, ordinal_cols array<string>, binary_cols array<string>, "
    "log_transform boolean, feature_importance array<struct<feature: string, importance: double>>, "
    "metrics struct<r2: double, mae: double, rmse: double, mape: double, mean_actual: double, "
    "mean_predicted: double, n: bigint>"
)
MEASURES = ("r2", "mae", "rmse", "mape", "mean_actual", "mean_predicted", "n")


def save(spark: SparkSession, bundle: Bundle, spec: CohortSpec, path: str) -> None:
    """Model, one-line JSON metadata, and the importance and metrics tables.

    The metadata is written last, so a bundle that can be read is complete.
    """
    bundle.model.write().overwrite().save(f"{path}/model")
    pairs = [(i + 1, n, float(x)) for i, (n, x) in enumerate(bundle.importance)]
    spark.createDataFrame(pairs, "rank int, feature string, importance double").coalesce(
        1
    ).write.mode("overwrite").parquet(f"{path}/importance")
    measures = tuple(bundle.metrics.get(m) for m in MEASURES)
    kinds = ", ".join(f"{m} {'bigint' if m == 'n' else 'double'}" for m in MEASURES)
    spark.createDataFrame([measures], kinds).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/metrics"
    )
    row = (
        bundle.feature_names, bundle.categories, bundle.categories[0], list(spec.numeric),
        [spec.tier], list(spec.binary), True, [(n, x) for _, n, x in pairs], measures,
    )
    spark.createDataFrame([row], METADATA).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> Bundle:
    try:
        meta = spark.read.schema(METADATA).json(f"{path}/metadata").first()
    except AnalysisException as error:
        raise FileNotFoundError(f"No model at {path}. Run the training job first.") from error
    if meta is None:
        raise FileNotFoundError(f"The model at {path} has no metadata.")
    return Bundle(
        PipelineModel.load(f"{path}/model"),
        list(meta["feature_names"]),
        list(meta["segment_categories"]),
        [(f["feature"], f["importance"]) for f in meta["feature_importance"]],
        meta["metrics"].asDict(),
    )


def feature_importance(spark: SparkSession, path: str) -> DataFrame:
    """The saved importances; ordered, one row per feature."""
    return spark.read.parquet(f"{path}/importance").orderBy("rank")


def top_importance(spark: SparkSession, path: str, k: int = 15) -> DataFrame:
    return feature_importance(spark, path).where(F.col("rank") <= k)


def model_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/metrics")

"""Names of encoded features and what readers see instead of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.spec import CohortSpec


def feature_names(spec: CohortSpec, categories: Sequence[str] | None = None) -> list[str]:
    """Encoded features in order: the categories without the first one, then the numbers.

    Before a fit the listed segments stand in for the fitted categories.
    """
    fitted = sorted(spec.segments) if categories is None else list(categories)
    return [f"{spec.segment}_{c}" for c in fitted[1:]] + list(spec.scalars)


def display_name(spec: CohortSpec, feature: str) -> str:
    return spec.labels.get(feature, feature)


def label_features(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """Add ``label``, the display name of ``feature``, or the key itself when it has none."""
    labels = df.sparkSession.createDataFrame(
        sorted(spec.labels.items()), "feature string, _label string"
    )
    # The spec lists the labels, so this side has a handful of rows.
    return (
        df.join(F.broadcast(labels), "feature", "left")
        .withColumn("label", F.coalesce("_label", "feature"))
        .drop("_label")
    )

"""The scoring job: read profiles, fill, score, name the band, explain, write.

    python -m cohortlab.plans.score --input profiles.csv --model models/graduates --output scores
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from cohortlab.operators.clean import default_fill, value_bands
from cohortlab.operators.learn import Bundle
from cohortlab.operators.score import explain
from cohortlab.sources import bundle as bundles
from cohortlab.sources import tables
from cohortlab.spec import GRADUATES, CohortSpec


def scores(df: DataFrame, bundle: Bundle, spec: CohortSpec) -> DataFrame:
    """One narrow pass: filled features, value, logarithm, main factors, band, value in base units."""
    filled = default_fill(tables.profiles(df, spec), spec)
    explained = explain(
        filled, bundle.model, bundle.feature_names, bundle.importance, spec, ["n_filled"]
    )
    return value_bands(explained, spec, "predicted_value")


def main() -> None:
    args = argparse.ArgumentParser(description="Score a table of graduates.")
    args.add_argument("--input", required=True)
    args.add_argument("--model", required=True)
    args.add_argument("--output", required=True)
    given = args.parse_args()
    spark = SparkSession.builder.appName("cohortlab-score").getOrCreate()
    df = tables.read_csv(spark, given.input, GRADUATES)
    scores(df, bundles.load(spark, given.model), GRADUATES).write.parquet(given.output)


if __name__ == "__main__":
    main()

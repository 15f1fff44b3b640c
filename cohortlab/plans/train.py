"""The training job: read, fill, split, fit, evaluate, save.

    python -m cohortlab.plans.train --input graduates.csv --output models/graduates
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import features, learn
from cohortlab.operators.clean import converted_only, default_fill
from cohortlab.plans.compare import cached
from cohortlab.session import staged
from cohortlab.sources import bundle as bundles
from cohortlab.sources import tables
from cohortlab.spec import GRADUATES, CohortSpec


def train(
    df: DataFrame,
    spec: CohortSpec,
    tune: bool = True,
    grid: Mapping[str, Sequence[Any]] | None = None,
    folds: int = learn.FOLDS,
    fit_scope: str = "train",
    parallelism: int | None = None,
    **params: Any,
) -> learn.Bundle:
    """Fit and evaluate on a hash split of the converted rows. ``parallelism``: see ``learn.tune_trees``.

    ``fit_scope="all"`` fits categories and scaling on both parts; the default keeps the test part
    out of them. ``params`` replace the fixed parameters of an untuned fit.
    """
    rows = converted_only(default_fill(tables.require(df, spec), spec), spec)
    rows = features.listed_category(rows.select(spec.id, spec.target, *spec.features), spec)
    rows = features.split(rows, spec)
    train_part = F.col("part") == "train"
    table: list[dict[str, Any]] = []
    # The fit of the encoding, the trees and the evaluation all read these rows: written once, and
    # the encoded training part stays cached while trees are grown, one pass per level.
    with staged(rows, "converted") as rows:
        in_scope = rows if fit_scope == "all" else rows.where(train_part)
        encoding = features.fit_encoding(in_scope, spec)
        folded = features.folds(rows.where(train_part), spec, folds)
        few = learn.in_few_tasks(learn.learning_rows(folded, encoding, "fold"), rows.where(train_part).count())
        with cached(few) as learning:
            if tune:
                trees, table = learn.tune_trees(learning, grid, folds, parallelism)
            else:
                trees = learn.fit_trees(learning.select("features", "label"), **params)
        model = learn.scoring_model(encoding, trees)
        tested = model.transform(rows.where(~train_part)).withColumn(
            "actual_log", F.log1p(spec.target)
        )
        metrics = learn.regression_metrics(tested, "actual_log", "predicted_log").first().asDict()
    return learn.Bundle(
        model,
        encoding.names,
        list(encoding.categories),
        learn.importances(trees, encoding.names, df.sparkSession),
        metrics,
        table,
    )


def main() -> None:
    args = argparse.ArgumentParser(description="Fit the regressor on a graduate table.")
    args.add_argument("--input", required=True, help="CSV file or folder with a header line")
    args.add_argument("--output", required=True, help="folder for the model, shared by all executors")
    args.add_argument("--no-tune", action="store_true", help="use the fixed parameters")
    args.add_argument("--trees", type=int, help="number of trees of an untuned fit")
    given = args.parse_args()
    spark = SparkSession.builder.appName("cohortlab-train").getOrCreate()
    df = tables.read_csv(spark, given.input, GRADUATES)
    params = {"maxIter": given.trees} if given.trees else {}
    fitted = train(df, GRADUATES, tune=not given.no_tune, **params)
    bundles.save(spark, fitted, GRADUATES, given.output)


if __name__ == "__main__":
    main()

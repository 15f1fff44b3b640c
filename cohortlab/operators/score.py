"""Batch scores, the main factors of each score, and comparison of pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.scalars import round_even
from cohortlab.operators.clean import numbers_filled
from cohortlab.sources.tables import require
from cohortlab.spec import CohortSpec

TOP = 3


def predict(df: DataFrame, model: PipelineModel, spec: CohortSpec) -> DataFrame:
    """The input, missing numbers filled, with ``n_filled``, ``<segment>_clean``, ``predicted_log`` and
    ``predicted_value``."""
    filled = numbers_filled(require(df, spec), spec)
    return model.transform(filled).select(
        *filled.columns, f"{spec.segment}_clean", "predicted_log", "predicted_value"
    )


def main_factors(importance: Sequence[tuple[str, float]], names: Sequence[str], top: int = TOP) -> Column:
    """Array of the ``top`` features by |standardised value| x importance.

    ``names`` are the features of the columns ``z_0``, ``z_1`` and so on. Features without an importance are left out; equal scores stay in feature order.
    """
    weight = dict(importance)
    candidates = []
    for order, name in enumerate(names):
        if name not in weight:
            continue
        z = F.col(f"z_{order}")
        score = round_even(F.abs(z) * weight[name], 6)
        candidates.append(
            F.struct(
                (-score).alias("k"), F.lit(order).alias("o"), F.lit(name).alias("feature"),
                z.alias("value"), score.alias("score"),
            )
        )
    ranked = F.slice(F.sort_array(F.array(*candidates)), 1, top)
    return F.transform(ranked, lambda f: F.struct(f["feature"], f["value"], f["score"]))


def explain(
    df: DataFrame,
    model: PipelineModel,
    names: Sequence[str],
    importance: Sequence[tuple[str, float]],
    spec: CohortSpec,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per row: predicted value, its logarithm with four digits, the main factors, and how many missing numbers
    were filled."""
    scored = model.transform(numbers_filled(require(df, spec), spec))
    return scored.select(
        spec.id,
        *spec.features,
        *dict.fromkeys([*keep, "n_filled"]),
        "predicted_value",
        round_even(F.col("predicted_log"), 4).alias("predicted_log"),
        main_factors(importance, names).alias("top_factors"),
    )


def factors_long(explained: DataFrame, spec: CohortSpec) -> DataFrame:
    """One row per main factor: ``(id, rank, feature, value, score)``."""
    # The outer form, as the inner one would build the array a second time to filter empty ones.
    each = explained.select(spec.id, F.posexplode_outer("top_factors").alias("pos", "factor"))
    return each.where(F.col("pos").isNotNull()).select(
        spec.id,
        (F.col("pos") + 1).alias("rank"),
        "factor.feature",
        F.col("factor.value").alias("value"),
        F.col("factor.score").alias("score"),
    )


def pair_comparison(
    pairs: DataFrame, scored: DataFrame, spec: CohortSpec, carry: Sequence[str] = ()
) -> DataFrame:
    """Compare the two profiles of each given pair ``(a, b)``; ``carry`` adds columns of both sides.

    ``status`` is ``ok``, or says which profile has no score; gaps and winner are null then.
    """

    def side(name: str) -> DataFrame:
        return scored.select(
            F.col(spec.id).alias(name),
            F.col("predicted_value").alias(f"value_{name}"),
            *(F.col(c).alias(f"{c}_{name}") for c in carry),
            F.lit(True).alias(f"known_{name}"),
        )

    gap = F.col("value_a") - F.col("value_b")
    no_a, no_b = F.col("known_a").isNull(), F.col("known_b").isNull()
    return (
        pairs.join(side("a"), "a", "left")
        .join(side("b"), "b", "left")
        .select(
            "a",
            "b",
            "value_a",
            "value_b",
            *(f"{c}_{s}" for s in "ab" for c in carry),
            round_even(gap, 2).alias("gap"),
            round_even(F.abs(gap), 2).alias("abs_gap"),
            F.when(gap > 0, "a").when(gap < 0, "b").when(gap == 0, "tie").alias("winner"),
            F.when(no_a & no_b, "neither").when(no_a, "no a").when(no_b, "no b").otherwise("ok").alias("status"),
        )
    )

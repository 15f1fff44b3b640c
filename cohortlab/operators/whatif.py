"""What-if gains: change one feature of a profile, score it again, rank the gains.

Each profile is laid out as one row per change plus one unchanged row, so all profiles and changes
are scored by a single transform, and the unchanged row brings the base value without a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.scalars import round_even
from cohortlab.operators.clean import numbers_filled
from cohortlab.sources.tables import require
from cohortlab.spec import CohortSpec, Lever

MIN_GAIN = 0.01


def new_value(lever: Lever) -> Column:
    """Value of the feature after the change, null where the lever does not apply."""
    x = F.col(lever.feature).cast("double")
    if lever.rule == "set":
        return F.when(F.coalesce(x, F.lit(0.0)) == 0, F.lit(lever.step))
    if lever.rule == "grow":
        changed = x + F.greatest(F.lit(lever.step), x * lever.share)
    elif lever.rule == "add":
        changed = x + lever.step
    else:
        raise ValueError(f"unknown rule {lever.rule!r}")
    applies = x.isNotNull()
    if lever.above is not None:
        applies = applies & (x > lever.above)
    if lever.below is not None:
        applies = applies & (x < lever.below)
    if lever.cap is not None:
        changed = F.least(changed, F.lit(lever.cap))
        applies = applies & (x < lever.cap)
    return F.when(applies, changed)


BASE = -1


def scenarios(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """One row per profile and applicable lever, with the features after the change; missing numbers are filled.

    ``lever_order`` is the position of the lever, or ``BASE`` on the row without any change; the values before the
    change are in ``was_<feature>``.
    """
    nothing = F.lit(None).cast("double")
    tries = [
        F.struct(
            F.lit(BASE).alias("lever_order"), F.lit("").alias("moved"), nothing.alias("improved")
        )
    ]
    for order, lever in enumerate(spec.levers):
        tries.append(
            F.struct(
                F.lit(order).alias("lever_order"), F.lit(lever.feature).alias("moved"),
                new_value(lever).alias("improved"),
            )
        )
    changed = {
        c: F.when(F.col("moved") == c, F.col("improved")).otherwise(F.col(c).cast("double"))
        for c in spec.scalars
    }
    return (
        numbers_filled(df, spec)
        .select(
            spec.id, *spec.features, "n_filled", *(F.col(c).alias(f"was_{c}") for c in spec.scalars),
            F.inline(F.array(*tries)),
        )
        .where((F.col("lever_order") == BASE) | F.col("improved").isNotNull())
        .withColumns(changed)
    )


def gains_per_profile(df: DataFrame, model: PipelineModel, spec: CohortSpec) -> DataFrame:
    """The profiles with ``base_value``, ``n_filled`` and ``gains``, largest first, ties in the order of the levers.

    A profile has at most one entry per lever and stays when it has none. The scenarios are brought
    back to one row by plain maxima of fixed width, one per lever, which need neither sorting nor
    collecting. Rows that share an id but not their features are profiles of their own, equal rows are counted and
    repeated, so no row is lost or mixed with another one, whatever the ids. The scenarios lie next to each other, so
    map-side aggregation leaves one row per profile before any shuffle, and when ``df`` is already
    partitioned by the id, as after a join on it, there is no shuffle at all.
    """
    order, value = F.col("lever_order"), F.col("predicted_value")
    wide = (
        model.transform(scenarios(require(df, spec), spec))
        .groupBy(spec.id, spec.segment, "n_filled", *(f"was_{c}" for c in spec.scalars))
        .agg(
            F.max(F.when(order == BASE, value)).alias("base_value"),
            F.count_if(order == BASE).alias("_rows"),
            *(F.max(F.when(order == i, value)).alias(f"_v{i}") for i in range(len(spec.levers))),
        )
        .withColumnsRenamed({f"was_{c}": c for c in spec.scalars})
    )
    entries = []
    for i, lever in enumerate(spec.levers):
        # The threshold is on the difference of two rounded predictions before it is rounded again.
        raw = F.col(f"_v{i}") - F.col("base_value")
        current = F.coalesce(F.col(lever.feature).cast("double"), F.lit(0.0))
        entries.append(
            F.when(
                raw > MIN_GAIN,
                F.struct(
                    round_even(raw, 2).alias("gain"),
                    F.lit(-i).alias("tie"),
                    round_even(current, 2).alias("current_value"),
                    round_even(new_value(lever), 2).alias("improved_value"),
                ),
            )
        )
    best_first = F.array_compact(F.sort_array(F.array(*entries), asc=False))
    each = wide.select(spec.id, *spec.features, "n_filled", "base_value", best_first.alias("gains"), "_rows")
    return each.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_rows"))).drop("_rows", "_row")


def by_lever(values: Sequence[str], gain: Column) -> Column:
    """The text of ``values`` that belongs to the lever of an entry of ``gains``."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), 1 - gain["tie"])


def whatif_gains(df: DataFrame, model: PipelineModel, spec: CohortSpec) -> DataFrame:
    """One row per gain above one hundredth, with its rank within the profile."""
    # The outer form, as the inner one would build the array a second time to filter empty ones.
    each = (
        gains_per_profile(df, model, spec)
        .select(spec.id, F.posexplode_outer("gains").alias("pos", "g"))
        .where(F.col("pos").isNotNull())
    )
    return each.select(
        spec.id,
        by_lever([lever.name for lever in spec.levers], F.col("g")).alias("lever"),
        by_lever([lever.feature for lever in spec.levers], F.col("g")).alias("feature"),
        *(F.col(f"g.{c}").alias(c) for c in ("current_value", "improved_value", "gain")),
        (F.col("pos") + 1).alias("rank"),
    )

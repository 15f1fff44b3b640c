"""Row rules: filters, projections, range checks, defaults and bands."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.scalars import band, known_category, starts_with_any
from cohortlab.spec import CohortSpec

# The openings of the texts that stand for a failed reply, the characters that are kept of one, and the
# blanks that are cut off at the ends of any reply.
FAILED_REPLY = ("[AI", "[API")
LONGEST_ERROR = 100
BLANKS = " \t\n\x0b\x0c\r"


def converted_only(df: DataFrame, spec: CohortSpec) -> DataFrame:
    return df.where(F.col(spec.outcome) == 1)


def outcome_mask(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """Keep every row and say which ones have a positive outcome."""
    return df.withColumn("is_converted", F.coalesce(F.col(spec.outcome) == 1, F.lit(False)))


def feature_projection(df: DataFrame, spec: CohortSpec) -> DataFrame:
    return df.select(*spec.features)


def clean_category(
    df: DataFrame, spec: CohortSpec, domain: Iterable[str], default: str, name: str = "segment_clean"
) -> DataFrame:
    """Add the segment with values outside ``domain`` replaced; the input column stays."""
    return df.withColumn(name, known_category(F.col(spec.segment), domain, default))


def default_fill(df: DataFrame, spec: CohortSpec, defaults: dict | None = None) -> DataFrame:
    """Fill missing features, null or NaN, with their defaults; ``n_filled`` says how many a row needed."""
    values = {c: v for c, v in (defaults or spec.defaults).items() if c in df.columns}
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def missing(c: str) -> Column:
        # isnan gives false for null, so the sum has no null.
        return (F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()).cast("int")

    return df.withColumn("n_filled", sum(map(missing, values), F.lit(0))).na.fill(values)


def numbers_filled(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """``default_fill`` of the features that are numbers, as done before scoring; once is enough."""
    if "n_filled" in df.columns:
        return df
    return default_fill(df, spec, {c: v for c, v in spec.defaults.items() if c in spec.scalars})


def range_violations(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """One row per value outside its allowed range: ``(id, rule, value, low, high)``.

    A segment that is not listed is reported without value and limits. Missing values are no
    violation, ``default_fill`` counts those.
    """

    def rule(name: str, value: Column, low: float | None, high: float | None, bad: Column) -> Column:
        return F.struct(
            F.lit(name).alias("rule"),
            value.cast("double").alias("value"),
            F.lit(low).cast("double").alias("low"),
            F.lit(high).cast("double").alias("high"),
            bad.alias("bad"),
        )

    segment = F.col(spec.segment)
    rules = [rule(spec.segment, F.lit(None), None, None, ~segment.isin(*spec.segments))]
    for feature, (low, high) in spec.ranges.items():
        value = F.col(feature)
        rules.append(rule(feature, value, low, high, ~value.between(low, high)))
    return df.select(spec.id, F.inline(F.array(*rules))).where("bad").drop("bad")


def value_bands(df: DataFrame, spec: CohortSpec, value: str) -> DataFrame:
    """Add the band of ``value`` and the value in base units."""
    return df.withColumns(
        {
            "band": band(F.col(value), spec.bands, spec.lowest_band),
            "value_in_units": F.col(value) * spec.unit_factor,
        }
    )


def reply_status(turns: DataFrame, prefixes: Iterable[str] = FAILED_REPLY) -> DataFrame:
    """Assistant turns with ``status`` ``failed`` when the text opens like an error message, and ``reply``: the text
    without blanks at its ends, of a failed one the first ``LONGEST_ERROR`` characters. A null text is an ok null."""
    trimmed = F.btrim(F.col("text"), F.lit(BLANKS))
    failed = starts_with_any(trimmed, prefixes)
    return turns.where(F.col("role") == "assistant").withColumns({
        "status": F.when(failed, "failed").otherwise("ok"),
        "reply": F.when(failed, F.substring(trimmed, 1, LONGEST_ERROR)).otherwise(trimmed),
    })

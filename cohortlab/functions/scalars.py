"""Column expressions shared by the operators; all of them run inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, digits: int) -> Column:
    """Round to ``digits``, ties of the scaled value to even, as array libraries do.

    Spark's ``round`` takes ties away from zero, so 0.125 would become 0.13 and not 0.12.
    """
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def known_category(value: Column, domain: Iterable[str], default: str) -> Column:
    """``value`` when it is in ``domain``; anything else, null included, becomes ``default``."""
    return F.when(value.isin(*domain), value).otherwise(F.lit(default))


def band(value: Column, edges: Sequence[tuple[float, str]], lowest: str) -> Column:
    """Name of the first band whose lower edge is reached; ``edges`` go from high to low."""
    chosen = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, name in edges:
        chosen = chosen.when(value >= F.lit(edge), F.lit(name))
    return chosen.otherwise(F.lit(lowest))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one digit; null when ``whole`` is 0."""
    return round_even(part.cast("double") * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0)), 1)


def starts_with_any(value: Column, prefixes: Iterable[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | value.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def hash_bucket(key: Column, seed: int, buckets: int) -> Column:
    """Bucket in ``[0, buckets)`` that depends on the key only, so it survives any repartitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of digits, rounded like every other figure here; null stays null."""
    pattern = F.lit("0." + "0" * digits)
    return F.call_function("format_number", round_even(value, digits), pattern)

"""All comparisons of one cohort from one projection, cached or written."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from cohortlab.operators import cohorts
from cohortlab.session import stage
from cohortlab.spec import CohortSpec


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """Keep ``df`` for the reports of one job; blocks of lost executors are computed again."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


@contextmanager
def comparisons(df: DataFrame, spec: CohortSpec, exact: bool = True) -> Iterator[dict[str, DataFrame]]:
    """Overview, segment, flag and tier reports; use them inside the ``with`` block."""
    with cached(df.select(spec.segment, spec.tier, spec.outcome, spec.target, *spec.binary)) as rows:
        yield {
            "overview": cohorts.overview(rows, spec, exact),
            "segments": cohorts.segment_comparison(rows, spec, exact),
            "flags": cohorts.flag_premium(rows, spec),
            "tiers": cohorts.tier_comparison(rows, spec, exact),
        }


def all_comparisons(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """Every report in one long table. Whatever joins ``df`` takes run once: its narrow projection is written, and all
    passes read that."""
    rows = stage(df.select(spec.segment, spec.tier, spec.outcome, spec.target, *spec.binary), "compared")
    return cohorts.all_comparisons(rows, spec)

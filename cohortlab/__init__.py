"""Outcome cohorts on Spark: group comparisons, regression scoring and what-if gains."""

from cohortlab.spec import CUSTOMERS, GRADUATES, CohortSpec, Lever

__all__ = ["CUSTOMERS", "GRADUATES", "CohortSpec", "Lever"]

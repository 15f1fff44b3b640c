"""Column roles and rules of a cohort table.

Every operator takes a ``CohortSpec``, so the same code runs on any table that has an id,
an outcome flag, a numeric target, one category, one tier, and numeric and yes/no features.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Lever:
    """One single-feature change tried by the what-if operator.

    ``rule`` is ``"grow"`` (add ``max(step, share * x)``), ``"set"`` (0 or missing becomes
    ``step``) or ``"add"`` (add ``step``). ``below`` / ``above`` say when the lever applies and
    ``cap`` limits the new value. ``name`` is the key: two levers may move the same feature.
    """

    name: str
    feature: str
    rule: str
    step: float
    share: float = 0.0
    below: float | None = None
    above: float | None = None
    cap: float | None = None


def default_levers(
    numeric: tuple[str, ...],
    binary: tuple[str, ...],
    ordinal: tuple[str, ...],
    counters: tuple[tuple[str, float], ...] = (),
) -> tuple[Lever, ...]:
    """Every numeric up by a tenth, every flag on, every tier one better, every counter plus one."""
    return (
        *(Lever(f"{c}_up", c, "grow", 0.5, share=0.1) for c in numeric),
        *(Lever(f"{c}_on", c, "set", 1.0) for c in binary),
        *(Lever(f"{c}_better", c, "add", -1.0, above=1.0) for c in ordinal),
        *(Lever(f"{c}_plus_one", c, "add", 1.0, below=limit) for c, limit in counters),
    )


@dataclass(frozen=True)
class CohortSpec:
    id: str
    target: str
    outcome: str
    segment: str
    tier: str
    numeric: tuple[str, ...]
    binary: tuple[str, ...]
    post_outcome: tuple[str, ...]
    segments: tuple[str, ...]
    tiers: tuple[int, ...]
    default_segment: str
    schema: T.StructType
    levers: tuple[Lever, ...]
    bands: tuple[tuple[float, str], ...]
    lowest_band: str
    unit: str
    unit_factor: float
    labels: dict[str, str] = field(default_factory=dict, hash=False)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict, hash=False)
    defaults: dict[str, float | int | str] = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        leaked = set(self.features) & {*self.post_outcome, self.target, self.outcome}
        if leaked:
            raise ValueError(f"columns known only after the outcome used as features: {sorted(leaked)}")

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.numeric, self.segment, self.tier, *self.binary)

    @property
    def scalars(self) -> tuple[str, ...]:
        """The features that are numbers, in encoded order."""
        return (*self.numeric, self.tier, *self.binary)


def _columns(kind: str, *names: str) -> list[T.StructField]:
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType()}
    return [T.StructField(name, kinds[kind]) for name in names]


# The column names of a graduate table and their order.
_GRADE_NUMERIC = (
    "cgpa", "coding_score", "communication_score", "aptitude_score", "internships",
    "projects", "backlogs", "resume_score", "skill_score",
)
_GRADE_FLAGS = ("python_skill", "dsa_skill", "ml_skill", "web_dev_skill")

# Column names and roles, category list, limits, defaults, band edges, lever limits.
GRADUATES = CohortSpec(
    id="student_id",
    target="salary_lpa",
    outcome="placed",
    segment="branch",
    tier="college_tier",
    numeric=_GRADE_NUMERIC,
    binary=_GRADE_FLAGS,
    post_outcome=("company_type", "job_role"),
    segments=("CSE", "IT", "ECE", "Mechanical", "Civil", "EEE"),
    tiers=(1, 2, 3),
    default_segment="CSE",
    schema=T.StructType([
        *_columns("string", "student_id"),
        *_columns("double", "cgpa", "coding_score", "communication_score", "aptitude_score"),
        *_columns("int", "internships", "projects", "backlogs"),
        *_columns("double", "resume_score"),
        *_columns("int", "skill_score"),
        *_columns("string", "branch"),
        *_columns("int", "college_tier", *_GRADE_FLAGS, "placed"),
        *_columns("double", "salary_lpa"),
        *_columns("string", "company_type", "job_role"),
    ]),
    levers=default_levers(
        _GRADE_NUMERIC, _GRADE_FLAGS, ("college_tier",), (("internships", 5.0), ("projects", 10.0))
    ),
    bands=((80.0, "top"), (50.0, "solid"), (30.0, "modest")),
    lowest_band="base",
    unit="LPA",
    unit_factor=100000.0,
    labels={
        "cgpa": "Mean grade",
        "branch": "Subject",
        "college_tier": "College group",
        "python_skill": "Knows Python",
        "dsa_skill": "Knows algorithms",
        "ml_skill": "Has trained models",
        "web_dev_skill": "Has built sites",
        "coding_score": "Programming test",
        "communication_score": "Speaking mark",
        "aptitude_score": "Reasoning test",
        "internships": "Placements done",
        "projects": "Own projects",
        "backlogs": "Courses to repeat",
        "resume_score": "CV mark",
        "skill_score": "Skills held",
    },
    ranges={
        "cgpa": (5, 10), "coding_score": (0, 100), "communication_score": (0, 10),
        "aptitude_score": (0, 100), "internships": (0, 10), "projects": (0, 15),
        "backlogs": (0, 10), "resume_score": (0, 100), "skill_score": (0, 4),
        "college_tier": (1, 3), "python_skill": (0, 1), "dsa_skill": (0, 1),
        "ml_skill": (0, 1), "web_dev_skill": (0, 1),
    },
    defaults={
        "cgpa": 7.5, "coding_score": 50.0, "communication_score": 7.0, "aptitude_score": 70.0,
        "internships": 1, "projects": 3, "backlogs": 0, "resume_score": 65.0, "skill_score": 2,
        "branch": "CSE", "college_tier": 2, "python_skill": 1, "dsa_skill": 1, "ml_skill": 0,
        "web_dev_skill": 0,
    },
)

_CUST_NUMERIC = ("acctbal", "n_orders", "n_urgent", "n_low", "n_open", "n_recent")
_CUST_FLAGS = ("flag_urgent", "flag_low", "flag_recent", "flag_open")

CUSTOMERS = CohortSpec(
    id="profile_id",
    target="target",
    outcome="converted",
    segment="segment",
    tier="tier",
    numeric=_CUST_NUMERIC,
    binary=_CUST_FLAGS,
    post_outcome=("region", "last_priority"),
    segments=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "SPACE"),
    tiers=(1, 2, 3),
    default_segment="BUILDING",
    schema=T.StructType([
        *_columns("long", "profile_id"),
        *_columns("string", "segment"),
        *_columns("int", "tier"),
        *_columns("double", "acctbal"),
        *_columns("long", *_CUST_NUMERIC[1:]),
        *_columns("int", *_CUST_FLAGS, "converted"),
        *_columns("double", "target"),
        *_columns("string", "region", "last_priority"),
    ]),
    levers=default_levers(_CUST_NUMERIC, _CUST_FLAGS, ("tier",), (("n_urgent", 5.0), ("n_low", 10.0))),
    bands=((4000.0, "top"), (2500.0, "solid"), (1500.0, "modest")),
    lowest_band="base",
    unit="K",
    unit_factor=1000.0,
    labels={
        "segment": "Market segment",
        "tier": "Balance tier",
        "acctbal": "Account balance",
        "n_orders": "Orders",
        "n_urgent": "Urgent orders",
        "n_low": "Low-priority orders",
        "n_open": "Open orders",
        "n_recent": "Recent orders",
        "flag_urgent": "Often urgent",
        "flag_low": "Often low priority",
        "flag_recent": "Recently active",
        "flag_open": "Many open orders",
    },
    ranges={
        "acctbal": (0, 9000), "n_orders": (3, 20), "n_urgent": (0, 5), "n_low": (0, 5),
        "n_open": (0, 8), "n_recent": (0, 9), "tier": (1, 3), "flag_urgent": (0, 1),
        "flag_low": (0, 1), "flag_recent": (0, 1), "flag_open": (0, 1),
    },
    defaults={
        "acctbal": 0.0, "n_orders": 0, "n_urgent": 0, "n_low": 0, "n_open": 0, "n_recent": 0,
        "segment": "BUILDING", "tier": 3, "flag_urgent": 0, "flag_low": 0, "flag_recent": 0,
        "flag_open": 0,
    },
)

import sys
from pathlib import Path

import numpy as np
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from cohortlab import GRADUATES  # noqa: E402
from cohortlab.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "cohortlab-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


def graduate_rows(n: int, seed: int = 7) -> list[tuple]:
    """Graduates whose salary follows skill score and tier, so that a learner has something to find."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        flags = [int(x) for x in rng.integers(0, 2, 4)]
        skill, tier = int(rng.integers(0, 5)), int(rng.integers(1, 4))
        branch = GRADUATES.segments[int(rng.integers(0, 6))]
        placed = int(rng.random() < 0.85)
        salary = float(round(30 + 12 * skill - 6 * tier + rng.normal(0, 2), 2))
        rows.append((
            f"S{i:05d}", float(round(rng.uniform(5, 10), 1)), float(rng.integers(0, 101)),
            float(round(rng.uniform(0, 10), 1)), float(rng.integers(0, 101)), int(rng.integers(0, 8)),
            int(rng.integers(0, 13)), int(rng.integers(0, 4)), float(rng.integers(0, 101)), skill,
            branch, tier, *flags, placed, salary if placed else None,
            "MNC" if placed else None, "Engineer" if placed else None,
        ))
    return rows


@pytest.fixture(scope="session")
def graduates(spark):
    return spark.createDataFrame(graduate_rows(800), GRADUATES.schema).cache()


@pytest.fixture(scope="session")
def make(spark):
    """Graduates from the few columns a test cares about; everything else has its default."""

    def build(*rows: dict):
        base = GRADUATES.defaults | {
            "placed": 1, "salary_lpa": 50.0, "company_type": "MNC", "job_role": "Engineer",
        }
        full = [{"student_id": f"T{i}"} | base | r for i, r in enumerate(rows)]
        names = GRADUATES.schema.names
        return spark.createDataFrame([tuple(r[c] for c in names) for r in full], GRADUATES.schema)

    return build

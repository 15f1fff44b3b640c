import numpy as np
import pytest

from cohortlab import GRADUATES as G
from cohortlab.operators import cohorts
from cohortlab.plans.compare import comparisons


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_segment_comparison(make):
    df = make(
        {"branch": "CSE", "salary_lpa": 10.0}, {"branch": "CSE", "salary_lpa": 20.0},
        {"branch": "CSE", "placed": 0, "salary_lpa": 999.0},
        {"branch": "CSE", "placed": 0, "salary_lpa": None},
        {"branch": "IT", "placed": 0, "salary_lpa": 0.0},
        {"branch": "Physics", "salary_lpa": 70.0}, {"branch": None, "salary_lpa": 70.0},
    )
    result = cohorts.segment_comparison(df, G)
    assert [r["segment"] for r in result.collect()] == list(G.segments)
    rows = by(result, "segment")
    assert rows["CSE"][1:] == (4, 2, 50.0, 15.0, 15.0, 20.0)
    assert rows["IT"][1:] == (1, 0, 0.0, None, None, None)
    assert rows["EEE"][1:] == (0, 0, 0.0, None, None, None)


def test_tier_comparison(make):
    df = make(
        {"college_tier": 1, "salary_lpa": 1.0}, {"college_tier": 1, "salary_lpa": 2.0},
        {"college_tier": 1, "salary_lpa": 9.0}, {"college_tier": 2, "placed": 0},
        {"college_tier": 7, "salary_lpa": 5.0},
    )
    assert [tuple(r) for r in cohorts.tier_comparison(df, G).collect()] == [
        (1, 4.0, 2.0, 3), (2, None, None, 0), (3, None, None, 0),
    ]


def test_flag_premium(make):
    df = make(
        {"python_skill": 1, "salary_lpa": 10.004, "ml_skill": 1},
        {"python_skill": 0, "salary_lpa": 4.996, "ml_skill": 1},
        {"python_skill": 2, "salary_lpa": 100.0, "ml_skill": 1},
        {"python_skill": None, "salary_lpa": 100.0, "ml_skill": 1},
        {"python_skill": 1, "salary_lpa": 100.0, "placed": 0, "ml_skill": 0},
    )
    rows = by(cohorts.flag_premium(df, G), "flag")
    # Rounded after the subtraction: 5.008, not 10.0 - 5.0.
    assert rows["python_skill"][1:] == (10.0, 5.0, 5.01, 1, 1)
    assert rows["ml_skill"]["without_avg"] is None and rows["ml_skill"]["premium"] is None
    assert rows["ml_skill"]["with_count"] == 4 and rows["ml_skill"]["without_count"] == 0
    assert set(rows) == set(G.binary)


@pytest.mark.parametrize("exact", [True, False])
def test_overview(make, exact):
    df = make({"salary_lpa": 1.0}, {"salary_lpa": 2.0}, {"salary_lpa": 3.0}, {"placed": 0})
    row = cohorts.overview(df, G, exact).first()
    assert tuple(row) == (4, 3, 75.0, 2.0, 2.0, 1.0, 3.0, 1.0)


def test_overview_of_one_row_and_of_nothing(make):
    one = make({"salary_lpa": 7.0})
    row = cohorts.overview(one, G).first()
    assert row["std_target"] is None and row["median_target"] == 7.0
    row = cohorts.overview(one.where("false"), G).first()
    assert tuple(row) == (0, 0, None, None, None, None, None, None)


def test_group_means(make):
    df = make(
        {"branch": "CSE", "job_role": None, "salary_lpa": 10.0},
        {"branch": "Physics", "job_role": "Analyst", "salary_lpa": 20.0},
        {"branch": None, "job_role": "Analyst", "salary_lpa": 31.0},
        {"branch": "CSE", "job_role": "Analyst", "placed": 0, "salary_lpa": 1000.0},
    )
    rows = cohorts.group_means(df, ["branch", "college_tier", "company_type", "job_role"], G).collect()
    assert {(r["key"], r["value"]): r["avg_target"] for r in rows} == {
        ("branch", "CSE"): 10.0, ("branch", "Physics"): 20.0, ("college_tier", "2"): 20.33,
        ("company_type", "MNC"): 20.33, ("job_role", "Analyst"): 25.5,
    }


def test_mark_best_marks_ties_and_no_null(spark):
    report = spark.createDataFrame([("a", 1.0, 5), ("b", 3.0, 5), ("c", None, 4)], "s string, x double, n int")
    rows = by(cohorts.mark_best(report, ["x", "n"]), "s")
    assert [rows[s]["x_best"] for s in "abc"] == [False, True, False]
    assert [rows[s]["n_best"] for s in "abc"] == [True, True, False]


def test_partitioning_does_not_change_results(graduates):
    few = cohorts.segment_comparison(graduates.coalesce(1), G).collect()
    many = cohorts.segment_comparison(graduates.repartition(17), G).collect()
    assert few == many


def test_flag_counts_stay_within_the_cohort(graduates):
    placed = graduates.where("placed = 1").count()
    for row in cohorts.flag_premium(graduates, G).collect():
        assert row["with_count"] + row["without_count"] == placed


def test_comparisons_share_one_cache(graduates):
    with comparisons(graduates, G) as reports:
        assert set(reports) == {"overview", "segments", "flags", "tiers"}
        assert reports["segments"].collect() == cohorts.segment_comparison(graduates, G).collect()
        assert reports["tiers"].collect() == cohorts.tier_comparison(graduates, G).collect()


def test_reports_equal_a_data_frame_library(graduates):
    """The same figures from one in-memory frame, rounded by that library."""
    frame = graduates.toPandas()
    placed = frame[frame.placed == 1]
    pay = placed.salary_lpa
    row = cohorts.overview(graduates, G).first()
    assert row["total"] == len(frame) and row["converted_count"] == len(placed)
    spread = [pay.mean(), pay.median(), pay.min(), pay.max(), pay.std()]
    assert list(row)[3:] == [float(np.round(x, 2)) for x in spread]
    keys = ["branch", "college_tier", "company_type", "job_role"]
    means = {(r["key"], r["value"]): r["avg_target"] for r in cohorts.group_means(graduates, keys, G).collect()}
    for key in keys:
        want = placed.groupby(key).salary_lpa.mean().round(2)
        assert {v: m for (k, v), m in means.items() if k == key} == {str(v): m for v, m in want.items()}
    for r in cohorts.segment_comparison(graduates, G).collect():
        group = placed[placed.branch == r["segment"]].salary_lpa
        assert r["median_target"] == np.round(group.median(), 2) and r["max_target"] == group.max()
        assert r["avg_target"] == np.round(group.mean(), 2)
    for r in cohorts.flag_premium(graduates, G).collect():
        on, off = (placed[placed[r["flag"]] == v].salary_lpa.mean() for v in (1, 0))
        assert (r["with_avg"], r["without_avg"]) == (np.round(on, 2), np.round(off, 2))
        assert r["premium"] == np.round(on - off, 2)

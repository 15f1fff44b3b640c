import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortlab.operators import medians as m


def medians(spark, pairs):
    rows = spark.createDataFrame(pairs, "k string, v double").repartition(5)
    return {r["k"]: r["median"] for r in m.exact_median(rows, "k", "v", ["a", "b", "c", "hot", "cold"]).collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from("abc"), st.integers(-50, 50).map(lambda x: x / 4)),
        min_size=1, max_size=60,
    )
)
def test_equals_the_definition(spark, pairs):
    want = {k: statistics.median(v for g, v in pairs if g == k) for k, _ in pairs}
    assert medians(spark, pairs) == want


def test_hot_group_and_many_values(spark):
    pairs = [("hot", float((i * 7919) % 30011)) for i in range(30011)] + [("cold", 1.0), ("cold", 2.0)]
    assert medians(spark, pairs) == {"hot": 15005.0, "cold": 1.5}


def test_one_value_holds_most_rows(spark):
    pairs = [("a", 5.0)] * 900 + [("a", float(i)) for i in range(100)]
    assert medians(spark, pairs) == {"a": 5.0}


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_few_bins_do_not_change_the_result(spark, monkeypatch, rounds):
    """The counts decide; bins only say how many values are left for the last step."""
    monkeypatch.setattr(m, "BINS", 3)
    monkeypatch.setattr(m, "ROUNDS", rounds)
    pairs = [("a", float(i * i * i)) for i in range(-50, 51)] + [("b", 1e300), ("b", -1e300), ("b", 1e-300), ("b", None)]
    assert medians(spark, pairs) == {"a": 0.0, "b": 1e-300}


def test_only_listed_keys(spark):
    rows = spark.createDataFrame([("a", 1.0), ("x", 5.0), (None, 7.0)], "k string, v double")
    assert m.exact_median(rows, "k", "v", ["a"]).collect() == [("a", 1.0)]


def test_no_job_while_the_plan_is_built(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, v double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("median-plan", "nothing should run")
    result = m.exact_median(rows, "k", "v", ["a"])
    assert len(tracker.getJobIdsForGroup("median-plan")) == 0
    assert result.first()["median"] == 1.5


def test_one_plan_for_all_sizes(spark):
    """Windows are over counted bins or values, never over rows."""
    rows = spark.range(100_000).selectExpr("'a' as k", "cast(id as double) as v")
    result = m.exact_median(rows, "k", "v", ["a"])
    assert result.first()["median"] == 49_999.5
    plan = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    for line in plan.split("\n"):
        if "Window" in line:
            assert "_bin" in line or "_v" in line


@pytest.mark.parametrize("seed", range(3))
def test_all_groupings_together(spark, seed):
    """Uneven groups, ties, values far apart, and keys without rows, against a sort of each group."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(3000):
        a, b = rng.choice(["x", "y", "y", "y", None]), int(rng.integers(1, 4))
        v = [float(rng.normal()), float(rng.integers(0, 3)), 1e300 * float(rng.random()), None][int(rng.integers(0, 4))]
        rows.append((None if a is None else str(a), b, v))
    rows += [("one", 9, 5.0), ("two", 9, -5.0), ("null", 9, None)]
    df = spark.createDataFrame(rows, "a string, b int, v double").repartition(4)
    found = {(r["_key"], r["_item"]): r["median"] for r in m.medians_together(df, ["a", "b"], "v").collect()}
    groups: dict = {}
    for a, b, v in rows:
        if v is not None:
            for key in (("all", ""), ("a", a), ("b", str(b))):
                if key[1] is not None:
                    groups.setdefault(key, []).append(v)
    expected = {}
    for key, values in groups.items():
        s, n = sorted(values), len(values)
        expected[key] = (s[(n - 1) // 2] + s[n // 2]) / 2
    assert found == expected
    assert m.medians_together(df.where("false"), ["a", "b"], "v").collect() == []

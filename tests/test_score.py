import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlab import GRADUATES as G
from cohortlab.functions.scalars import round_even
from cohortlab.operators import features, learn, score

NAMES = ["a", "b", "c", "d"]


def factors(spark, values, importance, top=3):
    df = spark.createDataFrame([tuple(values)], "z_0 double, z_1 double, z_2 double, z_3 double")
    rows = df.select(score.main_factors(importance, NAMES, top).alias("f")).first()["f"]
    return [(r["feature"], r["value"], r["score"]) for r in rows]


def test_factors_by_hand(spark):
    got = factors(spark, [1.0, -3.0, 0.5, 2.0], [("d", 0.1), ("a", 0.5), ("b", 0.2), ("c", 0.2)])
    assert got == [("b", -3.0, 0.6), ("a", 1.0, 0.5), ("d", 2.0, 0.2)]


def test_equal_scores_keep_feature_order(spark):
    got = factors(spark, [1.0, -1.0, 1.0, 5.0], [(n, 0.25) for n in "dcba"])
    assert [g[0] for g in got] == ["d", "a", "b"]


def test_features_without_importance_are_left_out(spark):
    assert factors(spark, [9.0, 1.0, 9.0, 9.0], [("b", 0.5), ("zzz", 1.0)]) == [("b", 1.0, 0.5)]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-5, 5), min_size=4, max_size=4), st.lists(st.floats(0, 1), min_size=4, max_size=4))
def test_factors_equal_a_sort(spark, values, weights):
    import numpy as np

    want = [(n, v, float(np.round(abs(v) * w, 6))) for n, v, w in zip(NAMES, values, weights, strict=True)]
    want.sort(key=lambda x: x[2], reverse=True)
    assert factors(spark, values, list(zip(NAMES, weights, strict=True))) == want[:3]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=200))
def test_rounding_equals_numpy(spark, values):
    import numpy as np

    values += [0.125, 2.5, 0.375, -0.125, 1.005, 2.675]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(round_even(F.col("v"), 2)).collect()]
    assert got == np.round(np.array(values), 2).tolist()


def test_explain(graduates):
    encoding = features.fit_encoding(graduates.where("placed = 1"), G)
    model = learn.weighted_sum(encoding, {"skill_score": 0.3, "college_tier": -0.1}, 3.9)
    importance = [("skill_score", 0.8), ("college_tier", 0.2)]
    row = score.explain(graduates, model, encoding.names, importance, G).orderBy("student_id").first()
    z = {n: (row[n] - m) / d for n, m, d in zip(encoding.names, encoding.means, encoding.deviations, strict=True) if n in G.scalars}
    log = 3.9 + 0.3 * z["skill_score"] - 0.1 * z["college_tier"]
    assert math.isclose(row["predicted_log"], round(log, 4), abs_tol=1e-9)
    assert math.isclose(row["predicted_value"], round(math.expm1(log), 2), abs_tol=1e-9)
    assert [f["feature"] for f in row["top_factors"]] == sorted(
        ["skill_score", "college_tier"], key=lambda n: -abs(z[n]) * dict(importance)[n]
    )


def test_pairs(spark):
    scored = spark.createDataFrame([("x", 10.0), ("y", 12.5), ("z", 10.0)], "student_id string, predicted_value double")
    pairs = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "z"), ("x", "gone"), ("lost", "gone")], "a string, b string")
    compared = score.pair_comparison(pairs, scored, G).collect()
    rows = {(r["a"], r["b"]): (r["gap"], r["abs_gap"], r["winner"], r["status"]) for r in compared}
    assert rows == {
        ("x", "y"): (-2.5, 2.5, "b", "ok"), ("y", "x"): (2.5, 2.5, "a", "ok"), ("x", "z"): (0.0, 0.0, "tie", "ok"),
        ("x", "gone"): (None, None, None, "no b"), ("lost", "gone"): (None, None, None, "neither"),
    }


def test_a_profile_in_most_pairs_is_split(spark):
    """The pair side of the join is cut into several tasks when one profile owns a third of it."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        scored = spark.range(20000).select(F.col("id").alias("student_id"), (F.col("id") * 1.0).alias("predicted_value"))
        ids = F.col("id")
        pairs = spark.range(0, 60000, 1, 8).select(
            F.when(ids % 3 == 0, F.lit(17)).otherwise(ids % 20000).alias("a"), (ids % 19999).alias("b")
        )
        result = score.pair_comparison(pairs, scored, G)
        rows = result.collect()
        assert len(rows) == 60000 and sum(r["a"] == 17 for r in rows) >= 20000
        assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

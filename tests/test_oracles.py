"""Every registered query against SQL on the same tables; learned results by what must hold."""

import pytest
from compare import assert_same, connect, same_types
from conftest import MEDIUM, SMALL

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(MEDIUM)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    result = QUERIES[name](spark, MEDIUM)
    assert same_types(result, con, SQL[name]) == []
    assert assert_same(result, con, SQL[name]) > 0


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert [r["segment"] for r in rows][-1] == "SPACE"
    assert rows[-1]["total"] == 0


def test_learned_scores(spark):
    customers = 1500
    scores = QUERIES["gbt_scores"](spark, MEDIUM)
    assert scores.count() == customers
    assert scores.where("predicted_value is null or predicted_value <= 0").count() == 0
    factors = QUERIES["gbt_top_factors"](spark, MEDIUM)
    assert factors.count() == 3 * customers
    assert factors.where("score < 0").count() == 0
    gains = QUERIES["gbt_whatif_gains"](spark, MEDIUM)
    assert gains.where("gain <= 0").count() == 0
    assert gains.groupBy("profile_id", "lever").count().where("count > 1").count() == 0


def test_learned_importance(spark):
    rows = QUERIES["feature_importance"](spark, MEDIUM).collect()
    values = [r["importance"] for r in rows]
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert values == sorted(values, reverse=True) and abs(sum(values) - 1) < 1e-4
    assert rows[0]["feature"] == "n_orders" and rows[0]["label"] == "Orders"
    text = QUERIES["importance_text"](spark, MEDIUM).first()["user_text"]
    assert "place 1 = n_orders, share " in text and "place 10 = " in text and "place 11 = " not in text


def test_learned_model_beats_segment_means(spark):
    learned = QUERIES["model_metrics"](spark, MEDIUM).first()
    baseline = QUERIES["regression_metrics"](spark, MEDIUM).first()
    assert learned["n"] == baseline["n"]
    assert learned["mae"] < baseline["mae"] and learned["r2"] > 0.5


def test_grid(spark):
    """The whole grid: eight combinations, and the best one has the least error."""
    rows = QUERIES["grid_search"](spark, SMALL).collect()
    assert len(rows) == 8
    assert len({(r["maxIter"], r["maxDepth"], r["stepSize"], r["subsamplingRate"]) for r in rows}) == 8
    best = [r for r in rows if r["is_best"]]
    assert len(best) == 1 and best[0]["mae_log"] == min(r["mae_log"] for r in rows)

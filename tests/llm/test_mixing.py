import random

import pytest
from cases import edge_documents, empty_documents
from compare import assert_same, connect, same_types
from conftest import MEDIUM, SMALL

from cohortlab.llm import mixing
from cohortlab.llm.oracles import SQL
from cohortlab.llm.queries import REGISTRY
from cohortlab.llm.tables import ranked


def shared_targets(sizes, weights, most=3):
    """Target of each source by resharing what capped sources cannot take, again and again."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        goal = [most * s if i in capped else left * weights[i] / weight for i, s in enumerate(sizes)]
        over = {i for i, g in enumerate(goal) if g > most * sizes[i] and i not in capped}
        if not over:
            return goal
        capped |= over


def test_targets(spark):
    random.seed(3)
    sizes = [random.choice([0, 1, 5, 40, 300, 9000]) for _ in range(40)] + [50_000]
    weights = [i % 3 + 1 for i in range(41)]
    df = spark.createDataFrame(list(zip(range(41), sizes, weights, strict=True)), "i long, source_size long, weight long")
    got = {r["i"]: r["target"] for r in mixing.targets(df, sum(sizes)).collect()}
    assert [got[i] for i in range(41)] == pytest.approx(shared_targets(sizes, weights))


def test_schedule_inverse(spark):
    knots = ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (0.75, 0.0), (1.0, 4.0))

    def due(t):
        out = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            d = min(max(t - t0, 0), t1 - t0)
            out += w0 * d + (w1 - w0) / (t1 - t0) * d * d / 2
        return out

    shares = spark.range(1, 1000).selectExpr("id / 1000d as x")
    rows = shares.select("x", mixing.time_due(shares["x"], knots).alias("t")).collect()
    for x, t in rows:
        assert due(t) / due(1) == pytest.approx(x, abs=1e-9)
    times = [t for _, t in sorted(rows)]
    assert times == sorted(times) and 0 <= times[0] and times[-1] <= 1


def test_against_sql(spark):
    for folder in (SMALL, MEDIUM):
        con, name = connect(folder), "op1_mix_sources"
        result = REGISTRY[name](spark, folder)
        assert same_types(result, con, SQL[name]) == []
        assert assert_same(result, con, SQL[name]) > 0


def test_mix_follows_the_targets(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copy", "position"]
    rows = mixed.select("doc_id", "source", "position", mixing.size_of(mixed["text"]).alias("n")).collect()
    positions = [r["position"] for r in rows]
    assert positions == sorted(positions) and max(positions) <= 1
    names = sorted({r["source"] for r in rows})
    got = {s: sum(r["n"] for r in rows if r["source"] == s) for s in names}
    size = {r["source"]: r["n"] for r in docs.groupBy("source").agg({"n_chars": "count"}).toDF("source", "n").collect()}
    assert len(size) == len(names)
    plan = {r["source"]: r["target"] for r in mixing.plan(docs).select("doc.source", "target").distinct().collect()}
    for s in names:
        assert got[s] == pytest.approx(plan[s], rel=0.2)
    # Early sources have most of their words in the first half.
    half = {s: sum(r["n"] for r in rows if r["source"] == s and r["position"] < 0.5) / got[s] for s in names}
    assert all(half[s] == pytest.approx((0.625, 0.5, 0.375)[i % 3], abs=0.12) for i, s in enumerate(names))
    again = [(r["doc_id"], r["position"]) for r in mixing.mix(docs.repartition(7)).collect()]
    assert again == [(r["doc_id"], r["position"]) for r in rows]


def test_edges(spark):
    docs = edge_documents(spark)
    plan = mixing.plan(docs)
    assert plan.count() == docs.count()
    mixed = mixing.mix(docs)
    assert set(mixed.columns) == set(docs.columns)
    assert mixed.select("position").dtypes == [("position", "double")]
    assert plan.where("taken > 3 * size").count() == 0
    assert mixing.mix(empty_documents(spark)).count() == 0
    no_words = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.plan(no_words).collect()] == [0, 0]


def test_ranks(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as x").repartition(5)
    rows = ranked(df, [df["x"].desc()], "r").collect()
    assert all(r["rank"] == 999 - r["x"] for r in rows)

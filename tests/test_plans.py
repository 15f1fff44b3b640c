"""What the plans must and must not contain, and the two command lines."""

import os
import sys

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from cohortlab import CUSTOMERS, GRADUATES
from cohortlab.operators import cohorts, learn
from cohortlab.plans import queries
from cohortlab.plans import score as score_job
from cohortlab.plans import train as train_job
from cohortlab.plans.queries import REGISTRY
from cohortlab.session import new_folder, shared_folder, stage, staged
from cohortlab.sources import customers


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small enough, apart from hinted ones."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.fixture
def short_fits(monkeypatch):
    """The plans around a fit do not depend on the number of trees; the whole fits run in test_oracles."""
    monkeypatch.setattr(learn, "UNTUNED", {"maxIter": 2, "maxDepth": 2, "stepSize": 0.05})
    monkeypatch.setattr(learn, "GRID", {"maxIter": [1, 2], "maxDepth": [2]})
    monkeypatch.setattr(learn, "FOLDS", 2)
    monkeypatch.setattr(queries, "_SAVED", {})


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_slow_operator(spark, no_broadcast, short_fits, name):
    plan = physical(REGISTRY[name](spark, SMALL))
    for slow in ("CartesianProduct", "NestedLoop", "EvalPython", "InPandas", "SortAggregate"):
        assert slow not in plan, slow


def test_order_facts_are_combined_before_the_shuffle(spark):
    plan = physical(customers.order_facts(customers.read(spark, SMALL, "orders")))
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1
    assert "ObjectHashAggregate" not in plan


def test_any_priority_text(spark):
    """Priorities are an open list; a customer without orders has none."""
    orders = customers.read(spark, SMALL, "orders").withColumn(
        "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, "9-NEVER").otherwise(F.col("o_orderpriority"))
    )
    facts = customers.order_facts(orders).withColumnRenamed("o_custkey", "profile_id")
    got = {r["profile_id"]: r["last_priority"] for r in customers.with_last_priority(facts, orders).collect()}
    want = {}
    for r in orders.orderBy("o_orderdate", "o_orderkey").collect():
        want[r["o_custkey"]] = r["o_orderpriority"]
    assert got == want and "9-NEVER" in want.values()


def test_a_customer_with_most_orders(spark):
    """One customer owns the orders; the shuffled rows are one per customer and map task."""
    orders = customers.read(spark, SMALL, "orders")
    hot = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 > 0, 7).otherwise(F.col("o_custkey")))
    facts = customers.order_facts(hot).withColumnRenamed("o_custkey", "profile_id")
    assert facts.agg(F.sum("n_orders")).first()[0] == orders.count()
    best = max((r["o_orderdate"], r["o_orderkey"], r["o_orderpriority"]) for r in hot.where("o_custkey = 7").collect())
    assert customers.with_last_priority(facts, hot).where("profile_id = 7").first()["last_priority"] == best[2]


def test_unused_columns_are_not_read(spark):
    plan = physical(cohorts.flag_premium(customers.cohort(spark, SMALL), CUSTOMERS))
    # Neither names nor balances of customers matter for the flags.
    assert "ReadSchema: struct<c_custkey:bigint>" in plan and "nation" not in plan


def test_hint_free_lookup_follows_the_size(spark, no_broadcast):
    plan = physical(customers.cohort(spark, SMALL, post_outcome=True))
    assert "Broadcast" not in plan


def test_shared_folder_follows_the_session(spark, tmp_path):
    folder = shared_folder(spark)
    assert new_folder(spark, "x").startswith(folder)
    df = spark.range(10).withColumn("v", F.array(F.lit(1.5)))
    copy = stage(df, "copy")
    assert copy.dtypes == df.dtypes and copy.count() == 10
    assert "parquet" in physical(copy).lower()


def test_mounted_folder_serves_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://elsewhere:7077")
    copy = stage(spark.range(10).toDF("id"), "mounted")
    assert copy.inputFiles()[0].startswith("file:") and copy.count() == 10


def test_cluster_without_a_named_folder_shares_the_warehouse(spark):
    class Context:
        master, given = "spark://elsewhere:7077", None

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return self.given

        def setCheckpointDir(self, folder):
            self.given = folder

    class Session:
        sparkContext, conf = Context(), spark.conf

    assert shared_folder(Session()) == spark.conf.get("spark.sql.warehouse.dir") == Session.sparkContext.given


def test_staged_copy_is_removed(spark):
    with staged(spark.range(10).toDF("id"), "short") as copy:
        path = copy.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert copy.count() == 10 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_files_written_again_are_fitted_again(spark, tmp_path):
    for table in ("customer", "orders"):
        customers.read(spark, SMALL, table).write.parquet(f"{tmp_path}/{table}.parquet")
    before = queries.fitted(spark, str(tmp_path))
    assert queries.fitted(spark, str(tmp_path)) is before
    richer = customers.read(spark, SMALL, "customer").withColumn("c_acctbal", F.col("c_acctbal") + 1000)
    richer.write.mode("overwrite").parquet(f"{tmp_path}/customer.parquet")
    after = queries.fitted(spark, str(tmp_path))
    place = before.names.index("acctbal")
    assert abs(after.means[place] - before.means[place] - 1000) < 1e-6


def test_command_lines(spark, graduates, tmp_path, monkeypatch):
    given, model, out = (str(tmp_path / n) for n in ("in", "model", "out"))
    graduates.coalesce(2).write.option("header", True).csv(given)
    monkeypatch.setattr(sys, "argv", ["train", "--input", given, "--output", model, "--no-tune", "--trees", "3"])
    train_job.main()
    monkeypatch.setattr(sys, "argv", ["score", "--input", given, "--model", model, "--output", out])
    score_job.main()
    rows = spark.read.parquet(out)
    assert rows.count() == 800 and {"band", "top_factors", "n_filled", GRADUATES.id} <= set(rows.columns)

"""A cohort with one row per customer, built from customers and their orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _order_time() -> Column:
    """Date and key of an order as one number, so that the latest order is a plain maximum."""
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("decimal(18,0)")
    return micros * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col("o_orderkey")


def _count(condition: Column) -> Column:
    """Number of matching rows, null when there is none."""
    return F.sum(F.when(condition, F.lit(1).cast("bigint")))


def order_facts(orders: DataFrame) -> DataFrame:
    """One row per customer. All states are sums and maxima, so map-side aggregation absorbs a
    customer that owns a large part of the orders."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        _count(priority == "1-URGENT").alias("n_urgent"),
        _count(priority == "5-LOW").alias("n_low"),
        _count(status == "O").alias("n_open"),
        _count(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).alias("n_recent"),
        _count(status == "F").alias("n_finished"),
        F.sum(F.rint(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
        F.max(_order_time()).alias("last_time"),
    )


def raw_profiles(customer: DataFrame, facts: DataFrame) -> DataFrame:
    """Customers with their order facts; a count without any matching order is still null."""
    balance = F.col("c_acctbal")
    return customer.join(facts, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("profile_id"),
        F.col("c_mktsegment").alias("segment"),
        F.when(balance >= 6000, 1).when(balance >= 2000, 2).otherwise(3).alias("tier"),
        balance.alias("acctbal"),
        "n_orders", "n_urgent", "n_low", "n_open", "n_recent", "n_finished", "cents",
        "c_nationkey", "last_time",
    )


def finish(raw: DataFrame) -> DataFrame:
    """Missing counts become 0, then flags, outcome and target follow from the counts."""
    counts = ["n_orders", "n_urgent", "n_low", "n_open", "n_recent", "n_finished", "cents"]
    limits = {"flag_urgent": ("n_urgent", 3), "flag_low": ("n_low", 3),
              "flag_recent": ("n_recent", 3), "flag_open": ("n_open", 4),
              "converted": ("n_finished", 3)}
    return (
        raw.na.fill(0, counts)
        .withColumns({name: (F.col(c) >= n).cast("int") for name, (c, n) in limits.items()})
        .withColumn("target", F.col("cents") / 100000.0)
    )


def with_last_priority(df: DataFrame, orders: DataFrame) -> DataFrame:
    """The priority of the latest order, whatever its text. Time and key of an order are unique, so each row
    finds one order, and a customer with very many orders is spread over all tasks."""
    latest = orders.select(
        F.col("o_custkey").alias("_of"), _order_time().alias("_time"), F.col("o_orderpriority").alias("last_priority")
    )
    return df.join(latest, (F.col("profile_id") == F.col("_of")) & (F.col("last_time") == F.col("_time")), "left")


def with_region(df: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Region by nation. No hint: Spark broadcasts the lookup only if its size allows it."""
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("r_name").alias("region")
    )
    return df.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")


def cohort(spark: SparkSession, folder: str, post_outcome: bool = False) -> DataFrame:
    """The cohort table; the post-outcome columns and their joins only when asked for."""
    raw = raw_profiles(read(spark, folder, "customer"), order_facts(read(spark, folder, "orders")))
    full = finish(raw)
    extra = []
    if post_outcome:
        full = with_region(full, read(spark, folder, "nation"), read(spark, folder, "region"))
        full = with_last_priority(full, read(spark, folder, "orders"))
        extra = ["region", "last_priority"]
    return full.select(
        "profile_id", "segment", "tier", "acctbal", "n_orders", "n_urgent", "n_low", "n_open",
        "n_recent", "flag_urgent", "flag_low", "flag_recent", "flag_open", "converted", "target",
        *extra,
    )

"""Exact medians that never gather a large group in one task.

The range of each group is cut into equal bins, counted in one aggregation; running counts over the bins, a bounded
number of rows, tell which ones hold the middle ranks, and their smallest and largest values are the next range. After
two rounds only the values of a four-billionth of the range are counted one by one. The plan is the same for every
size, lazy, and its windows do not grow with the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 65_536
ROUNDS = 2


def _running(key: str, order: str) -> Column:
    """Rows of the group up to and including this bin or value."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.col("_below") + F.sum("_c").over(upto)


def _holds(rank: str) -> Column:
    return (F.col(rank) < F.col("_upto")) & (F.col(rank) >= F.col("_upto") - F.col("_c"))


def _within(rows: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    # At most one range for each listed key.
    return rows.join(F.broadcast(ranges), key).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def _carried() -> list[Column]:
    return [F.max(c).alias(c) for c in ("_below", "_r1", "_r2")]


def _narrowed(rows: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """The values between which the middle ranks of each group lie, from the bins of its last range."""
    # Halves, so that the width of no range overflows.
    width = F.col("_hi") / 2 - F.col("_lo") / 2
    place = F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / width * BINS)
    place = F.when(width > 0, F.least(place, F.lit(BINS - 1))).otherwise(0)
    bins = (
        _within(rows, key, ranges)
        .groupBy(key, place.alias("_bin"))
        .agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), *_carried())
        .withColumn("_upto", _running(key, "_bin"))
    )
    return bins.where(_holds("_r1") | _holds("_r2")).groupBy(key).agg(
        F.min("_least").alias("_lo"), F.max("_most").alias("_hi"), F.min(F.col("_upto") - F.col("_c")).alias("_below"),
        F.max("_r1").alias("_r1"), F.max("_r2").alias("_r2"),
    )


def exact_median(rows: DataFrame, key: str, value: str, listed: Sequence) -> DataFrame:
    """``(key, median)`` for the groups of ``rows`` whose key is one of ``listed``; nulls do not count.

    The list bounds what is broadcast: one row of limits for each of its values.
    """
    v = F.col(value).cast("double")
    rows = rows.where(F.col(key).isin(*listed) & v.isNotNull()).select(key, (v + 0.0).alias("_v"))
    n = F.col("_n")
    # 0-based middle ranks; the same one twice when the number of rows is odd.
    ranges = rows.groupBy(key).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).select(
        key, "_lo", "_hi", F.lit(0).cast("long").alias("_below"),
        F.floor((n - 1) / 2).alias("_r1"), F.floor(n / 2).alias("_r2"),
    )
    for _ in range(ROUNDS):
        ranges = _narrowed(rows, key, ranges)
    values = (
        _within(rows, key, ranges).groupBy(key, "_v").agg(F.count("*").alias("_c"), *_carried())
        .withColumn("_upto", _running(key, "_v"))
    )
    middle = [F.max(F.when(_holds(r), F.col("_v"))) for r in ("_r1", "_r2")]
    return values.groupBy(key).agg(((middle[0] + middle[1]) / 2).alias("median"))


def approx_median(value: Column) -> Column:
    """One-pass alternative for reports where the rank may be off by one part in ten thousand."""
    return F.percentile_approx(value, 0.5)


# Several groupings at once


def _inside(value: Column, low: Column, high: Column) -> Column:
    """The bin of a value in a range."""
    width = high / 2 - low / 2
    place = F.floor((value / 2 - low / 2) / width * BINS)
    return F.when(width > 0, F.greatest(F.least(place, F.lit(BINS - 1)), F.lit(0))).otherwise(0)


def _by_grouping(counts: DataFrame, keys: Sequence[str], path: Sequence[str]) -> DataFrame:
    """Counts of the last bin or value of a path for all rows together and by each key: ``_key, _item``, the path."""
    sets = [[F.col(p) for p in path], *([F.col(k), *(F.col(p) for p in path)] for k in keys)]
    out = counts.groupingSets(sets, *keys, *path).agg(
        F.sum("_c").alias("_c"), F.min("_least").alias("_least"), F.max("_most").alias("_most"),
        *(F.grouping(k).alias(f"_off_{k}") for k in keys),
    )
    name, item = F.lit("all"), F.lit("")
    for k in keys:
        on = F.col(f"_off_{k}") == 0
        name, item = F.when(on, F.lit(k)).otherwise(name), F.when(on, F.col(k).cast("string")).otherwise(item)
    return out.withColumn("_key", name).withColumn("_item", item).where("_item is not null").select(
        "_key", "_item", *path, "_c", "_least", "_most"
    )


def medians_together(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(_key, _item, median)`` of ``value`` over all rows (``all``, an empty item) and by each of ``keys``, whose
    values as text are the items; nulls do not count.

    For keys with few values each. All groupings are narrowed together: bins are counted once per combination of keys,
    and only these counts are added up by grouping. Bins and values that hold a middle rank of some group, at most two
    for each, are what the next pass over ``rows`` looks at.
    """
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull()).select(*keys, (v + 0.0).alias("_v"))
    span = rows.agg(F.struct(F.min("_v").alias("low"), F.max("_v").alias("high"))).scalar()
    inside = rows.withColumn("_p0", _inside(F.col("_v"), span["low"], span["high"]))
    path, chosen = ["_p0"], None
    for level in range(ROUNDS + 1):
        last = path[-1]
        counts = inside.groupBy(*keys, *path).agg(
            F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
        )
        found = _by_grouping(counts, keys, path)
        before = path[:-1]
        if chosen is None:
            n = F.sum("_c").over(Window.partitionBy("_key", "_item"))
            found = found.withColumn("_n", n).withColumns(
                {"_below": F.lit(0).cast("long"), "_r1": F.floor((F.col("_n") - 1) / 2), "_r2": F.floor(F.col("_n") / 2)}
            )
        else:
            found = found.join(F.broadcast(chosen.select("_key", "_item", *before, "_below", "_r1", "_r2")), ["_key", "_item", *before])
        upto = Window.partitionBy("_key", "_item", *before).orderBy(last).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = found.withColumn("_upto", F.col("_below") + F.sum("_c").over(upto)).where(_holds("_r1") | _holds("_r2"))
        if level == ROUNDS:
            middle = [F.max(F.when(_holds(r), F.col(last))) for r in ("_r1", "_r2")]
            return found.groupBy("_key", "_item").agg(((middle[0] + middle[1]) / 2).alias("median"))
        chosen = found.select("_key", "_item", *path, (F.col("_upto") - F.col("_c")).alias("_below"), "_r1", "_r2", "_least", "_most")
        cells = chosen.groupBy(*path).agg(F.min("_least").alias("_low"), F.max("_most").alias("_high"))
        # At most two cells for each group.
        inside = inside.join(F.broadcast(cells), path)
        following = f"_p{level + 1}"
        values = F.col("_v") if level == ROUNDS - 1 else _inside(F.col("_v"), F.col("_low"), F.col("_high"))
        inside = inside.withColumn(following, values).drop("_low", "_high")
        path = [*path, following]
    raise AssertionError("ROUNDS must not be negative")

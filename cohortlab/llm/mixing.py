"""Mixing sources to target weights along a curriculum.

Every source gets a target number of words and a schedule, its weight over the training time from 0 to 1. The
integral of the schedule up to a time is the share of the target that is due by then; inverting it gives each
document the time at which its words are due. Sorting by that time, in ranges, is the training order. Within a
source documents follow a keyed hash of their id; a source with more target than words is gone through again.

Running sums are exact without gathering a source: the hash order is cut into buckets, whose totals are summed
per source (a few rows each), and documents are only summed within their bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.tables import WORD, keep, packed, ranked, unpacked

Knots = Sequence[tuple[float, float]]

# Time and relative weight: early, even and late sources. Each schedule has the integral 1.
SCHEDULES: tuple[Knots, ...] = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
WEIGHTS = (1, 2, 3)
MOST = 3
ROWS_PER_BUCKET = 50_000
KEY_BITS = 60


def size_of(text: Column) -> Column:
    """Number of words, 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, seed: str) -> Column:
    """60 bits of a keyed hash of the id."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def time_due(share: Column, knots: Knots) -> Column:
    """The time at which the integral of the schedule reaches a share of the whole."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))
    if area <= 0 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs weights of 0 or more, and some weight")
    parts, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        w0, w1 = w0 / area, w1 / area
        slope = (w1 - w0) / (t1 - t0)
        y = F.greatest(share - F.lit(done), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + y * F.lit(2 * slope), F.lit(0.0)))
        # 2y / (w0 + root) solves w0 d + slope d^2 / 2 = y, also where the slope or w0 is 0.
        d = F.coalesce(F.try_divide(y * F.lit(2.0), F.lit(w0) + root), F.lit(0.0))
        done += (t1 - t0) * (w0 + w1) / 2
        parts.append((done, F.least(F.lit(t0) + d, F.lit(t1))))
    out = parts[-1][1]
    for end, time in reversed(parts[:-1]):
        out = F.when(share <= F.lit(end), time).otherwise(out)
    return out


def targets(sources: DataFrame, total: int, most: int = MOST) -> DataFrame:
    """Adds ``target``: words by ``weight``, at most ``most`` times ``source_size``, the excess shared again.

    Each round is one aggregation of the source table; only sums come to the driver.
    """
    limit = F.col("source_size") * most
    capped, n_capped, level = F.lit(False), -1, 0.0
    while True:
        row = sources.agg(
            F.sum(F.when(capped, limit).otherwise(0)), F.sum(F.when(~capped, F.col("weight")).otherwise(0)),
            F.sum(capped.cast("long")),
        ).first()
        full, weight, n = (int(x or 0) for x in row)
        if n == n_capped or not weight:
            break
        n_capped, level = n, (total - full) / weight
        capped = limit.cast("double") <= F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.when(capped, limit.cast("double")).otherwise(F.lit(level) * F.col("weight")))


def plan(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Knots] = SCHEDULES,
    most: int = MOST,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``docs``: the input as ``doc``, and ``size, source_size, target, copies, taken, start,
    schedule``. ``docs`` has ``doc_id`` and ``source``, and ``text`` unless ``size`` is given.

    Sources in the order of their names, null last, take the weights and schedules in turn. ``copies`` says how
    often a row is taken, ``taken`` its words times that, ``start`` the words of its source before it. The last
    round of a source takes the rows whose middle lies within what is left of the target.

    Null text: size 0. Null id: hashed like an empty one. Null source: a source of its own. Repeated rows are
    rows like any other; rows with one id stay in the order of their sizes, equal ones in any. Empty table or no
    words: no rows, or targets of 0. Extra columns are kept in ``doc`` and cannot clash.
    """
    size = size_of(F.col("text")) if size is None else size
    s = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = packed(docs, F.col("source").alias("source"), s.alias("s"), size.alias("size"),
                  order_key(F.col("doc_id"), seed).alias("key"))
    # Counted finely enough for any number of rows; coarser buckets are sums of these.
    fine = keep(rows.groupBy("source", "s", F.shiftright("key", KEY_BITS - 10).alias("fine"))
                .agg(F.sum("size").alias("size"), F.count("*").alias("n")), "fine")
    sums = fine.groupBy("source", "s").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"))
    largest, total = sums.agg(F.max("n"), F.sum("source_size")).first()
    bits = min(40, max(10, math.ceil(math.log2(max(1, (largest or 0) / ROWS_PER_BUCKET)))))
    by_rank = ranked(sums, [F.col("source").asc_nulls_last()], "sources")
    place = F.col("rank") % len(weights)
    weight = F.element_at(F.array(*(F.lit(int(w)).cast("long") for w in weights)), (place + 1).cast("int"))
    sources = targets(by_rank.withColumn("weight", weight), int(total or 0), most)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    facts = sources.select(
        "s", "source_size", "target", rounds.cast("int").alias("rounds"),
        (F.col("rank") % len(schedules)).cast("int").alias("schedule"),
    )
    bucket = F.shiftright("key", KEY_BITS - bits).alias("bucket")
    if bits == 10:
        totals = fine.select("s", F.col("fine").alias("bucket"), "size")
    else:
        totals = rows.groupBy("s", bucket).agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("s").orderBy("bucket")
    before = F.coalesce(F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("s", "bucket", before.alias("before")).join(facts, "s")
    within = Window.partitionBy("s", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    left = F.col("target") - F.col("rounds") * F.col("source_size")
    last = (F.col("start") + F.col("size") / 2 <= left) & (F.col("rounds") < most)
    return (
        rows.withColumn("bucket", bucket).join(offsets, ["s", "bucket"])
        .withColumn("start", start)
        .withColumn("copies", F.col("rounds") + F.when(last, 1).otherwise(0))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc", "size", "source_size", "target", "copies", "taken", "start", "schedule")
    )


def position(copy: Column, schedules: Sequence[Knots] = SCHEDULES) -> Column:
    """When the middle word of a copy of a planned row is due."""
    words = copy * F.col("source_size") + F.col("start") + F.col("size") / 2
    share = F.coalesce(F.try_divide(words, F.col("target")), F.lit(0.0))
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        out = F.when(F.col("schedule") == i, time_due(share, knots)).otherwise(out)
    return out


def mix(docs: DataFrame, schedules: Sequence[Knots] = SCHEDULES, **options) -> DataFrame:
    """The training order: the columns of ``docs``, ``copy`` (0, 1, ...) and ``position`` (0 to 1), a row for each
    time a document is taken, range-sorted by position. Cases: see ``plan``."""
    rows = plan(docs, schedules=schedules, **options).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rows = rows.withColumn("position", position(F.col("copy"), schedules))
    return unpacked(rows.orderBy("position", "schedule", "start"), docs.columns, F.col("copy"), F.col("position"))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The words of each document that the mix takes, in training order, documents it leaves out last."""
    # Kept, as the plan reads its rows twice: texts are read and counted once.
    docs = keep(documents.select("doc_id", "source", size_of(F.col("text")).alias("words")), "sizes")
    rows = plan(docs, size=F.col("words"))
    first = F.when(F.col("copies") > 0, F.round(position(F.lit(0)), 6))
    return rows.select(
        "doc.doc_id", "size", "source_size", "target", "taken", "copies", first.alias("position")
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")

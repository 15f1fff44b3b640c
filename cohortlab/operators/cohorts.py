"""Overview and group comparisons of a cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.scalars import percent, round_even
from cohortlab.operators.medians import approx_median, exact_median, medians_together
from cohortlab.spec import CohortSpec


def _hit(spec: CohortSpec) -> Column:
    return F.col(spec.outcome) == 1


def _target(spec: CohortSpec) -> Column:
    """The target on rows with a positive outcome, null on all others."""
    return F.when(_hit(spec), F.col(spec.target))


def _summary(
    rows: DataFrame, key: str, listed: Sequence, aggs: Sequence[Column], spec: CohortSpec, exact: bool
) -> DataFrame:
    """Group summary plus a ``median`` column; all keys of ``rows`` are listed."""
    if not exact:
        return rows.groupBy(key).agg(*aggs, approx_median(_target(spec)).alias("median"))
    medians = exact_median(rows.where(_hit(spec)), key, spec.target, listed)
    return rows.groupBy(key).agg(*aggs).join(F.broadcast(medians), key, "left")


def _domain(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    kind = "string" if isinstance(values[0], str) else "int"
    rows = [(v, i) for i, v in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, f"{name} {kind}, ord int")


def overview(df: DataFrame, spec: CohortSpec, exact: bool = True) -> DataFrame:
    """One row: size, conversions, rate, and the spread of the target on converted rows."""
    target = _target(spec)
    rows = df.select(spec.outcome, spec.target)
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(_hit(spec)).alias("converted_count"),
        F.avg(target).alias("mean"),
        F.min(target).alias("low"),
        F.max(target).alias("high"),
        F.stddev_samp(target).alias("std"),
    ]
    if exact:
        # The converted rows form the one group whose median is wanted.
        median = exact_median(rows, spec.outcome, spec.target, [1]).select("median")
        report = rows.agg(*aggs).withColumn("median", median.scalar())
    else:
        report = rows.agg(*aggs, approx_median(target).alias("median"))
    return report.select(
        "total",
        "converted_count",
        percent(F.col("converted_count"), F.col("total")).alias("rate"),
        *(
            round_even(F.col(c), 2).alias(f"{name}_target")
            for c, name in {
                "mean": "avg", "median": "median", "low": "min", "high": "max", "std": "std",
            }.items()
        ),
    )


def running_overview(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """The overview without its median, whose states are a few numbers: also for rows that go on arriving."""
    target = _target(spec)
    report = df.select(spec.outcome, spec.target).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_hit(spec)).alias("converted_count"), F.avg(target).alias("mean"),
        F.min(target).alias("low"), F.max(target).alias("high"), F.stddev_samp(target).alias("std"),
    )
    names = {"mean": "avg", "low": "min", "high": "max", "std": "std"}
    return report.select(
        "total", "converted_count", percent(F.col("converted_count"), F.col("total")).alias("rate"),
        *(round_even(F.col(c), 2).alias(f"{n}_target") for c, n in names.items()),
    )


def group_means(df: DataFrame, keys: Sequence[str], spec: CohortSpec) -> DataFrame:
    """Mean target of the converted rows by each key on its own: ``(key, value, avg_target)``.

    One scan for all keys; rows without a value for a key are left out of that key's means.
    """
    rows = df.where(_hit(spec)).select(*(F.col(k).cast("string").alias(k) for k in keys), spec.target)
    # One row per combination first, so that only those rows are multiplied by the grouping sets.
    combos = rows.groupBy(*keys).agg(F.sum(spec.target).alias("_s"), F.count(spec.target).alias("_c"))
    sets = combos.groupingSets([[F.col(k)] for k in keys], *keys).agg(
        (F.sum("_s") / F.nullif(F.sum("_c"), F.lit(0))).alias("mean"),
        *(F.grouping(k).alias(f"_off_{k}") for k in keys),
    )
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in keys:
        active = F.col(f"_off_{k}") == 0
        name = F.when(active, F.lit(k)).otherwise(name)
        value = F.when(active, F.col(k)).otherwise(value)
    return sets.select(
        name.alias("key"), value.alias("value"), round_even(F.col("mean"), 2).alias("avg_target")
    ).where(F.col("value").isNotNull())


def segment_comparison(df: DataFrame, spec: CohortSpec, exact: bool = True) -> DataFrame:
    """One row per listed segment, in listed order, also for segments without any row."""
    rows = df.where(F.col(spec.segment).isin(*spec.segments)).select(
        F.col(spec.segment).alias("segment"), spec.outcome, spec.target
    )
    target = _target(spec)
    aggs = [
        F.count(F.lit(1)).alias("_total"),
        F.count_if(_hit(spec)).alias("_hits"),
        F.avg(target).alias("_mean"),
        F.max(target).alias("_high"),
    ]
    groups = _summary(rows, "segment", spec.segments, aggs, spec, exact)
    total = F.coalesce("_total", F.lit(0))
    hits = F.coalesce("_hits", F.lit(0))
    return (
        _domain(df, "segment", spec.segments)
        .join(F.broadcast(groups), "segment", "left")
        .orderBy("ord")
        .select(
            "segment",
            total.alias("total"),
            hits.alias("converted_count"),
            percent(hits, F.greatest(total, F.lit(1))).alias("rate"),
            round_even(F.col("_mean"), 2).alias("avg_target"),
            round_even(F.col("median"), 2).alias("median_target"),
            round_even(F.col("_high"), 2).alias("max_target"),
        )
    )


def tier_comparison(df: DataFrame, spec: CohortSpec, exact: bool = True) -> DataFrame:
    """Converted rows by listed tier."""
    rows = df.where(_hit(spec) & F.col(spec.tier).isin(*spec.tiers)).select(
        F.col(spec.tier).alias("tier"), spec.outcome, spec.target
    )
    aggs = [F.count(F.lit(1)).alias("_hits"), F.avg(spec.target).alias("_mean")]
    groups = _summary(rows, "tier", spec.tiers, aggs, spec, exact)
    return (
        _domain(df, "tier", spec.tiers)
        .join(F.broadcast(groups), "tier", "left")
        .orderBy("ord")
        .select(
            "tier",
            round_even(F.col("_mean"), 2).alias("avg_target"),
            round_even(F.col("median"), 2).alias("median_target"),
            F.coalesce("_hits", F.lit(0)).alias("count"),
        )
    )


def flag_premium(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """Mean target of converted rows with and without each flag, any other state counts in neither.

    All flags are aggregated side by side in one scan; only the one result row is turned long.
    """
    aggs = []
    for flag in spec.binary:
        for name, state in ((f"{flag}_with", 1), (f"{flag}_without", 0)):
            has = F.col(flag) == state
            aggs.append(F.avg(F.when(has, F.col(spec.target))).alias(f"{name}_avg"))
            aggs.append(F.count_if(has).alias(f"{name}_count"))
    wide = df.where(_hit(spec)).agg(*aggs)
    per_flag = [
        F.struct(
            F.lit(flag).alias("flag"),
            round_even(F.col(f"{flag}_with_avg"), 2).alias("with_avg"),
            round_even(F.col(f"{flag}_without_avg"), 2).alias("without_avg"),
            round_even(F.col(f"{flag}_with_avg") - F.col(f"{flag}_without_avg"), 2).alias("premium"),
            F.col(f"{flag}_with_count").alias("with_count"),
            F.col(f"{flag}_without_count").alias("without_count"),
        )
        for flag in spec.binary
    ]
    return wide.select(F.inline(F.array(*per_flag)))


def all_comparisons(rows: DataFrame, spec: CohortSpec) -> DataFrame:
    """Overview, segment, tier and flag reports in one long table: ``report, item, measure, value`` (double).

    ``rows`` is read once for all counts and means, once for the flags, and as often as one exact median needs for all
    of them; best a written projection, see ``plans.compare``. Listed segments and tiers without rows are kept.
    """
    target = _target(spec)
    keys = [spec.segment, spec.tier]
    stats = rows.groupingSets([[], [F.col(spec.segment)], [F.col(spec.tier)]], *keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_hit(spec)).alias("hits"), F.avg(target).alias("mean"),
        F.min(target).alias("low"), F.max(target).alias("high"), F.stddev_samp(target).alias("std"),
        *(F.grouping(k).alias(f"_off_{i}") for i, k in enumerate(keys)),
    )
    by = F.when(F.col("_off_0") == 0, "segment").when(F.col("_off_1") == 0, "tier").otherwise("overview")
    item = F.when(by == "segment", F.col(spec.segment)).when(by == "tier", F.col(spec.tier).cast("string")).otherwise("")
    stats = stats.withColumns({"report": by, "item": item}).drop(*keys)
    named = {"all": "overview", spec.segment: "segment", spec.tier: "tier"}
    medians = medians_together(rows.where(_hit(spec)), keys, spec.target)
    name = F.coalesce(*(F.when(F.col("_key") == k, F.lit(n)) for k, n in named.items()))
    medians = medians.select(name.alias("report"), F.col("_item").alias("item"), "median")
    listed = [("overview", ""), *(("segment", s) for s in spec.segments), *(("tier", str(t)) for t in spec.tiers)]
    groups = df_of(rows, listed, "report string, item string").join(stats, ["report", "item"], "left").join(
        medians, ["report", "item"], "left"
    )
    total, hits = F.coalesce("total", F.lit(0)), F.coalesce("hits", F.lit(0))
    every, segment, tier = F.col("report") == "overview", F.col("report") == "segment", F.col("report") == "tier"
    share = F.when(every, percent(hits, total)).otherwise(percent(hits, F.greatest(total, F.lit(1))))
    measures = [
        ("total", ~tier, total), ("converted_count", ~tier, hits), ("rate", ~tier, share),
        ("avg_target", F.lit(True), round_even(F.col("mean"), 2)),
        ("median_target", F.lit(True), round_even(F.col("median"), 2)),
        ("min_target", every, round_even(F.col("low"), 2)), ("max_target", ~tier, round_even(F.col("high"), 2)),
        ("std_target", every, round_even(F.col("std"), 2)), ("count", tier, hits),
    ]
    cells = F.array(*(
        F.struct(F.lit(m).alias("measure"), shown.alias("shown"), v.cast("double").alias("value")) for m, shown, v in measures
    ))
    long = groups.select("report", "item", F.inline(cells)).where("shown").drop("shown")
    flags = flag_premium(rows, spec)
    names = [c for c in flags.columns if c != "flag"]
    parts = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in names))
    return long.unionByName(flags.select(F.lit("flag").alias("report"), F.col("flag").alias("item"), F.inline(parts)))


def df_of(like: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def mark_best(report: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mark every cell that reaches the maximum of its column.

    For finished reports with one row per listed category; the window holds just those rows.
    """
    whole = Window.partitionBy()
    marks = {
        f"{c}_best": F.coalesce(F.col(c) == F.max(c).over(whole), F.lit(False)) for c in columns
    }
    return report.withColumns(marks)

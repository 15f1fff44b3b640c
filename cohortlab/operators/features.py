"""Encoding, standardising and splitting a cohort for the learner."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.names import feature_names
from cohortlab.functions.scalars import hash_bucket, known_category
from cohortlab.operators.clean import converted_only, outcome_mask
from cohortlab.spec import CohortSpec

SEED = 42
TRAIN_PERCENT = 80


@dataclass(frozen=True)
class Encoding:
    """Fitted categories and the mean and population deviation of each encoded column."""

    spec: CohortSpec
    categories: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    @property
    def names(self) -> list[str]:
        return feature_names(self.spec, self.categories)

    @property
    def dropped(self) -> str:
        return self.categories[0]

    def clean_sql(self) -> str:
        """The segment with categories unknown to the fit replaced by the first fitted one."""
        known = ", ".join(_text(c) for c in self.categories)
        seg = quoted(self.spec.segment)
        return f"CASE WHEN {seg} IN ({known}) THEN {seg} ELSE {_text(self.dropped)} END"

    def encoded_sql(self) -> dict[str, str]:
        """One double expression per encoded column, in feature order."""
        hot = {
            f"{self.spec.segment}_{c}": f"CASE WHEN {self.clean_sql()} = {_text(c)} THEN 1D ELSE 0D END"
            for c in self.categories[1:]
        }
        return hot | {c: f"CAST({quoted(c)} AS DOUBLE)" for c in self.spec.scalars}

    def scaled_sql(self) -> dict[str, str]:
        """Standardised columns. A column that never varied is only centred."""
        return {
            name: f"(({sql}) - {double(mean)}) / {double(dev if dev > 0 else 1.0)}"
            for (name, sql), mean, dev in zip(
                self.encoded_sql().items(), self.means, self.deviations, strict=True
            )
        }


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double(value: float) -> str:
    """A literal that reads back as exactly the same double."""
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def quoted(name: str) -> str:
    """A column name as it is written in an expression; categories may hold any character."""
    return "`" + name.replace("`", "``") + "`"


def listed_category(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """Replace categories that are not listed, as done before a fit."""
    return df.withColumn(
        spec.segment, known_category(F.col(spec.segment), spec.segments, spec.default_segment)
    )


def category_domain(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """The distinct categories a fit would see, in order, with their position."""
    counts = listed_category(df, spec).groupBy(F.col(spec.segment).alias("category")).count()
    # At most one row per listed category is left here.
    return counts.orderBy("category").select("category", F.col("count").alias("n"))


def fit_encoding(df: DataFrame, spec: CohortSpec) -> Encoding:
    """Fit on the given rows in one aggregation; one row of statistics comes back.

    After the clean-up only listed categories are left, so the sizes of all of them and the
    moments of their yes/no columns fit in the same pass as those of the numbers.
    """
    rows = listed_category(df, spec)
    listed = sorted(spec.segments)
    hot = [(F.col(spec.segment) == c).cast("double") for c in listed]
    moments = []
    for value in [*hot, *(F.col(c).cast("double") for c in spec.scalars)]:
        moments.append(F.struct(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation")))
    n, stats = rows.agg(F.count(F.lit(1)), F.array(*moments)).first()
    if not n:
        raise ValueError("no rows to fit on")
    seen = [(c, s) for c, s in zip(listed, stats, strict=False) if s["mean"] > 0]
    numbers = list(zip(spec.scalars, stats[len(listed):], strict=True))
    empty = [c for c, s in numbers if s["mean"] is None]
    if empty:
        raise ValueError(f"features without any value: {', '.join(empty)}")
    kept = [s for _, s in seen[1:] + numbers]
    return Encoding(
        spec,
        tuple(c for c, _ in seen),
        tuple(s["mean"] for s in kept),
        tuple(s["deviation"] for s in kept),
    )


def one_hot(df: DataFrame, encoding: Encoding) -> DataFrame:
    """The id and the encoded columns in feature order, after the clean-up done before a fit."""
    columns = (f"{sql} AS {quoted(name)}" for name, sql in encoding.encoded_sql().items())
    return listed_category(df, encoding.spec).selectExpr(quoted(encoding.spec.id), *columns)


def standardize(df: DataFrame, encoding: Encoding, *keep: str) -> DataFrame:
    """The id, the columns to keep, and the standardised columns as ``z_<feature>``."""
    columns = (f"{sql} AS {quoted(f'z_{name}')}" for name, sql in encoding.scaled_sql().items())
    rows = listed_category(df, encoding.spec)
    return rows.selectExpr(quoted(encoding.spec.id), *map(quoted, keep), *columns)


def training_set(df: DataFrame, encoding: Encoding) -> DataFrame:
    """Converted rows, standardised, with the logarithm of the target as ``label``."""
    spec = encoding.spec
    rows = converted_only(df, spec).withColumn("label", F.log1p(spec.target))
    return standardize(rows, encoding, "label")


def prepare_all(df: DataFrame, encoding: Encoding) -> DataFrame:
    """Every row standardised, with its raw target and whether it was converted."""
    spec = encoding.spec
    return standardize(outcome_mask(df, spec), encoding, spec.target, "is_converted")


def split(df: DataFrame, spec: CohortSpec, percent: int = TRAIN_PERCENT, seed: int = SEED) -> DataFrame:
    """Add ``part``, ``train`` or ``test``, decided by the id alone."""
    train = hash_bucket(F.col(spec.id), seed, 100) < percent
    return df.withColumn("part", F.when(train, "train").otherwise("test"))


def folds(df: DataFrame, spec: CohortSpec, k: int, seed: int = SEED) -> DataFrame:
    """Add ``fold`` in ``[0, k)``, decided by the id alone and unrelated to ``split``."""
    return df.withColumn("fold", hash_bucket(F.col(spec.id), seed + 1, k))


def split_counts(df: DataFrame, spec: CohortSpec) -> DataFrame:
    return split(converted_only(df, spec), spec).groupBy("part").agg(F.count(F.lit(1)).alias("n"))

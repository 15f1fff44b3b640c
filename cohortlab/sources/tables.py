"""Reading cohort tables: explicit schema, early checks, no inference pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.spec import CohortSpec


def nan_to_null(df: DataFrame) -> DataFrame:
    """Aggregates skip null but not NaN, so NaN must not get past the scan."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns)
    )


# The texts that stand for a missing value in a CSV file.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _text_and_value(column: T.StructField) -> tuple[Column, Column]:
    """The text of a CSV column, null if missing, and what it says as a value of its type, null if it does not fit.
    Whole numbers may be written as 3.0."""
    text = F.when(~F.col(column.name).isin(*MISSING), F.col(column.name))
    if isinstance(column.dataType, T.StringType):
        return text, text
    value = text.try_cast(column.dataType)
    if isinstance(column.dataType, T.IntegralType):
        number = text.try_cast("double")
        value = F.coalesce(value, F.when(number == F.rint(number), number.try_cast(column.dataType)))
    return text, value


def _parsed(column: T.StructField) -> Column:
    """The text of a CSV column as its type. Any text that does not fit stops the job, whether or not the session casts
    strictly."""
    text, value = _text_and_value(column)
    if isinstance(column.dataType, T.StringType):
        return text.alias(column.name)
    unfit = F.raise_error(F.concat(F.lit(f"{column.name} is not a number: "), text))
    return (
        F.when(text.isNull() | value.isNotNull(), value)
        .otherwise(unfit.cast(column.dataType))
        .alias(column.name)
    )


def read_csv(spark: SparkSession, path: str, spec: CohortSpec, multi_line: bool = False) -> DataFrame:
    """CSV with a header line, columns found by name in any order, further columns left out.

    Types come from the spec, so no pass over the data infers them. Columns that are no features,
    such as the outcome of profiles to score, may be absent. A quote inside quoted text is doubled. Texts with line
    ends need ``multi_line``, which reads each file in one task. Records of the wrong length stop the job, whatever
    columns it uses.
    """
    raw = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("columnPruning", False)
        .csv(path)
    )
    columns = [f for f in spec.schema if f.name in require(raw, spec).columns]
    return raw.select(*(_parsed(f) for f in columns))


RECORD = "_record"


def read_csv_checked(
    spark: SparkSession, path: str, spec: CohortSpec, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """As ``read_csv``, for files that may hold bad records: the good rows, and ``(reason, record)`` of all others.

    A record is bad if it has too many or too few fields, or a text that does not fit in a number column. Its reason
    names the first such column, its record is the text as read, or the column's text. Each record is in one of the two
    tables, so their counts add up to the records of the files.
    """
    options = {"header": True, "enforceSchema": False, "escape": '"', "multiLine": multi_line, "columnPruning": False}
    names = require(spark.read.options(**options).csv(path), spec).columns
    texts = T.StructType([T.StructField(n, T.StringType()) for n in [*names, RECORD]])
    raw = (
        spark.read.options(**options).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD)
        .schema(texts).csv(path)
    )
    columns = [f for f in spec.schema if f.name in names]
    reason, record = F.when(F.col(RECORD).isNotNull(), F.lit("wrong length")), F.col(RECORD)
    values = []
    for f in columns:
        text, value = _text_and_value(f)
        unfit = text.isNotNull() & value.isNull()
        reason = reason.when(unfit, F.lit(f"{f.name} is not a number"))
        record = F.coalesce(record, F.when(unfit, text))
        values.append(value.alias(f.name))
    judged = raw.select(reason.alias("reason"), record.alias("record"), F.struct(*values).alias("row"))
    good = judged.where("reason is null").select("row.*")
    return good, judged.where("reason is not null").select("reason", "record")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line that ``read_csv`` reads back, texts with quotes, commas and line ends included (these need
    ``multi_line``). Nulls and empty texts are both written as nothing, so empty texts come back as nulls, as do the
    other texts of ``MISSING``."""
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_parquet(spark: SparkSession, path: str, spec: CohortSpec) -> DataFrame:
    return nan_to_null(require(spark.read.parquet(path), spec))


def require(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """Fail while the plan is built when a feature is missing."""
    missing = [c for c in spec.features if c not in df.columns]
    if missing:
        raise ValueError(f"no value can be found for: {', '.join(missing)}")
    return df


def from_dicts(
    spark: SparkSession, given: Sequence[Mapping[str, Any]], spec: CohortSpec
) -> DataFrame:
    """A table of a few profiles given by hand; each needs every feature. Row numbers are the ids."""
    for profile in given:
        missing = [c for c in spec.features if c not in profile]
        if missing:
            raise ValueError(f"no value can be found for: {', '.join(missing)}")
    fields = [f for f in spec.schema if f.name in spec.features]
    number = {T.DoubleType(): float, T.IntegerType(): int, T.LongType(): int}
    rows = [
        (str(i), *(number.get(f.dataType, str)(p[f.name]) if p[f.name] is not None else None for f in fields))
        for i, p in enumerate(given)
    ]
    schema = T.StructType([T.StructField(spec.id, T.StringType()), *fields])
    return spark.createDataFrame(rows, schema).select(spec.id, *spec.features)


def profiles(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """The id and the features, and nothing that is known only after the outcome."""
    return require(df, spec).select(spec.id, *spec.features)

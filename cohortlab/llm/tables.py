"""Reading, keeping and numbering tables, and the word patterns that several operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.session import new_folder, scratch

# What separates words, as a pattern and as a set of characters.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written copy.

    It cuts the lineage, outlives lost executors, and fixes whatever a rerun could number differently.
    """
    return _written(df, new_folder(df.sparkSession, label))


@contextmanager
def kept(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """Like ``keep`` for what is no longer read after its ``with`` block: the copy is removed then."""
    with scratch(df.sparkSession, label) as path:
        yield _written(df, path)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def in_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the modules that the function needs."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def field(name: str, of: str = "") -> Column:
    """A column by its literal name, dots and blanks included."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """All of ``df`` as one struct ``doc`` beside working columns, so that names cannot clash."""
    return df.select(F.struct(*(field(c) for c in df.columns)).alias("doc"), *columns)


def unpacked(df: DataFrame, names: Sequence[str], *new: Column) -> DataFrame:
    """The columns of ``doc`` and the new ones; a new one takes the place of an old one of its name."""
    added = {n.lower() for n in df.select(*new).columns} if new else set()
    old = [field(c, "doc").alias(c) for c in names if c.lower() not in added]
    return df.select(*old, *new)


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def numbered(df: DataFrame, label: str, name: str = "node") -> DataFrame:
    """Unique numbers in no particular order, fixed by writing the table."""
    return keep(df.withColumn(name, F.monotonically_increasing_id()), label)


def ranked(
    df: DataFrame, order: Sequence[Column], label: str, name: str = "rank", kept: Sequence[str] | None = None
) -> DataFrame:
    """0-based ranks of the whole table without gathering it in one task: rows are dealt by range,
    and only the number of rows in each range (one per partition) passes through the driver. ``kept``: columns that are
    still wanted once the rows are in order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*map(field, kept or df.columns))
    placed = numbered(dealt, label, "_at")
    sizes = {r[0]: r[1] for r in placed.groupBy(F.shiftright("_at", 33)).count().collect()}
    starts, before = [], 0
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    # One row for each partition that has rows.
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _start long"))
    index = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.withColumn("_part", F.shiftright("_at", 33)).join(first, "_part")
    return out.withColumn(name, index + F.col("_start")).drop("_at", "_part", "_start")

"""A bounded set of marks, for leaving rows that cannot match out of a shuffle.

Keys are hashed to a fixed number of cells. A cell that no key marked proves that a row with its hash matches none; a
marked one proves nothing. The marks have at most one row for each 64 cells, which bounds what is broadcast; with more
keys than cells fewer rows are left out, and results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 23


def _cell(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(CELLS))


def marks(keys: DataFrame, hashed: Column) -> DataFrame:
    """The marked cells, 64 to a row."""
    cells = keys.select(_cell(hashed).alias("cell"))
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    return cells.groupBy(F.shiftright("cell", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def with_marked(df: DataFrame, marked: DataFrame, hashed: Column, name: str) -> DataFrame:
    """Adds whether the cell of a row is marked. ``marked`` has at most ``CELLS / 64`` rows."""
    df = df.withColumn("_cell", _cell(hashed)).withColumn("_word", F.shiftright("_cell", 6))
    out = df.join(F.broadcast(marked), "_word", "left")
    bit = F.expr("shiftrightunsigned(_bits, cast(_cell & 63 as int)) & 1L") == 1
    return out.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_cell", "_word", "_bits")

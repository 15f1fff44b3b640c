"""Connected components of a link table, by alternating stars.

Each round joins every node to the smallest node it knows, first over its larger neighbours and then over its
smaller ones, until only stars are left; the number of rounds grows with the logarithm of the longest chain.
A node with very many links is a hot key of joins only, which adaptive execution splits; the aggregations are
minima that are merged before the shuffle. No list of neighbours is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.tables import keep


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every linked node but the smallest of each component, which is the label.

    ``links`` has two whole numbers ``a`` and ``b``; order, repeats and links to oneself do not matter. Rows
    with a null are no links. Without links the result is empty.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    edges = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = keep(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = keep(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))

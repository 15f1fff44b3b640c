"""Prefix trie of conversations, screened by a count-min sketch.

The digest of a prefix is the sum of the digests of its turns and their places, so running sums give all of them. A
count-min sketch of all prefix digests tells most prefixes that only one conversation has: an estimate of one is a
proof, as the sketch never counts too little. What follows from such a prefix alone, its node with everything below it,
is emitted where the row stands. Only prefixes that may be shared are shuffled and grouped exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.tables import field, in_arrow, keep, ranked

# Turns that one window runs over; longer conversations are cut into blocks.
BLOCK = 1024
# Cells of each of the two rows of the sketch: four for each prefix within these bounds. The broadcast bits are a
# quarter of a byte per cell, so 16 MB at most; with more prefixes than cells fewer singletons are proved.
FEWEST_CELLS, MOST_CELLS = 1 << 16, 1 << 26
# Bytes of joined ids that are hashed at once.
CHUNK = 65_536
# Fixed values of the query: conversations that share an opening, and what its length is a remainder of.
FAMILY, OPENINGS = 5, 9

_NODE = ("pos", "p1", "p2")
_LOW = (1 << 32) - 1


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, pos, key, n_bytes)`` of every turn in reading order, from 1, and ``(conv_id, total)``.

    Turns are in the order of their numbers, null first, then of role and text. ``key`` is a digest of role and text.
    """
    role, text = (F.coalesce(field(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.select(field("conv_id").cast("long").alias("conv_id"), field("turn").alias("turn"), role, text)
    key = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = rows.where("conv_id is not null").withColumn("key", key).withColumn("n_bytes", F.octet_length("text").cast("long"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = ranked(rows, order, "turns", kept=("conv_id", "key", "n_bytes"))
    convs = keep(rows.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count("*").alias("total")), "conversations")
    turns = rows.join(convs, "conv_id").select("conv_id", (F.col("rank") - F.col("first") + 1).alias("pos"), "key", "n_bytes")
    return keep(turns, "numbered"), convs.select("conv_id", "total")


def with_shared_openings(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: each gets the first turns of the first of its family of ids, in place of as many own."""
    own = convs.select(
        "conv_id", F.col("total").alias("own"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("source"),
        (F.crc32(F.col("conv_id").cast("string")) % OPENINGS).alias("opening"),
    )
    sources = convs.select(F.col("conv_id").alias("source"), F.col("total").alias("there"))
    head = F.least("opening", F.coalesce("there", F.lit(0)))
    plan = own.join(sources, "source", "left").select(
        "conv_id", "source", "opening", head.alias("head"),
        (head + F.greatest(F.col("own") - F.col("opening"), F.lit(0))).alias("total"),
    )
    plan = keep(plan, "rebuilt")
    rest = turns.join(plan.drop("source"), "conv_id").where("pos > opening").select(
        "conv_id", (F.col("head") + F.col("pos") - F.col("opening")).alias("pos"), "key", "n_bytes"
    )
    first = turns.where(F.col("pos") < OPENINGS).withColumnRenamed("conv_id", "source")
    heads = first.join(plan.where("head > 0").select("conv_id", "source", "head"), "source").where("pos <= head")
    return rest.unionByName(heads.select("conv_id", "pos", "key", "n_bytes")), plan.select("conv_id", "total")


def _running(rows: DataFrame, columns: Sequence[str], backwards: bool = False, modulus: int | None = None) -> DataFrame:
    """Replaces ``columns`` by their running sums over the turns of each conversation, from the first on or, backwards,
    from the last. A window holds one block; the blocks before it come from a table of block sums."""
    block = F.floor((F.col("pos") - 1) / BLOCK).cast("long")
    order, blocks = (F.desc("pos"), F.desc("_block")) if backwards else (F.asc("pos"), F.asc("_block"))
    rows = rows.withColumn("_block", block)
    inside = Window.partitionBy("conv_id", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("conv_id", "_block").agg(*(F.sum(c).alias(c) for c in columns), F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy(blocks).rowsBetween(Window.unboundedPreceding, -1)
    # Conversations of one block have nothing before it.
    several = sums.withColumn("_of", F.count("*").over(Window.partitionBy("conv_id"))).where("_of > 1")
    cut = (lambda c: c.bitwiseAND(modulus)) if modulus is not None else (lambda c: c)
    earlier = several.select("conv_id", "_block", *(F.sum(cut(F.col(c))).over(before).alias(f"_{c}") for c in columns))
    out = rows.withColumns({c: F.sum(c).over(inside) for c in columns}).join(earlier, ["conv_id", "_block"], "left")
    out = out.withColumns({c: cut(F.col(c) + F.coalesce(f"_{c}", F.lit(0))) for c in columns})
    return out.drop("_block", *(f"_{c}" for c in columns))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every prefix of every conversation, the empty one included: ``conv_id, pos`` (its turns), ``p1, p2`` (its
    digest), ``q1, q2`` (that of the prefix one turn shorter), ``n_bytes`` of its last text, ``last``."""
    halves = [F.xxhash64(F.lit(i), "pos", "key") for i in (1, 2)]
    lanes = [x for h in halves for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(_LOW))]
    rows = turns.select("conv_id", "pos", "n_bytes", *(x.alias(f"l{i}") for i, x in enumerate(lanes)))
    rows = rows.withColumns({f"s{i}": F.col(f"l{i}") for i in range(4)})
    rows = _running(rows, [f"s{i}" for i in range(4)], modulus=_LOW)

    def packed(a: Column, b: Column) -> Column:
        return F.shiftleft(a, 32).bitwiseOR(b)

    without = [(F.col(f"s{i}") - F.col(f"l{i}")).bitwiseAND(_LOW) for i in range(4)]
    rows = rows.select(
        "conv_id", "pos", packed(F.col("s0"), F.col("s1")).alias("p1"), packed(F.col("s2"), F.col("s3")).alias("p2"),
        packed(without[0], without[1]).alias("q1"), packed(without[2], without[3]).alias("q2"), "n_bytes",
    )
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", *(zero.alias(c) for c in ("pos", "p1", "p2", "q1", "q2", "n_bytes")))
    return rows.unionByName(roots).join(convs, "conv_id").withColumn("last", F.col("pos") == F.col("total")).drop("total")


# The sketch


def _cells(width: int, pos: Column, p1: Column, p2: Column) -> list[Column]:
    """The cell of a prefix in each row of the sketch; the rows stand one after the other."""
    return [F.pmod(F.xxhash64(F.lit(r), pos, p1, p2), F.lit(width)) + r * width for r in (0, 1)]


def full_cells(rows: DataFrame, width: int) -> np.ndarray:
    """One bit for each cell of the count-min sketch of ``rows``: whether it counts more than one."""
    cells = rows.select(F.explode(F.array(*_cells(width, *map(F.col, _NODE)))).alias("cell"))
    full = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    words = full.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(2 * width // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _screen(sketch) -> Callable:
    def proved(bits: np.ndarray, batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
        cells = [batch.column(c).to_numpy() for c in names]
        full = [(bits[c >> 6] >> (c & 63)) & 1 for c in cells]
        return (full[0] & full[1]) == 0

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        for batch in batches:
            single, above = proved(bits, batch, ("c0", "c1")), proved(bits, batch, ("d0", "d1"))
            kept = batch.drop_columns(["c0", "c1", "d0", "d1"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(single), pa.array(above & (kept.column("pos").to_numpy() > 0))],
                names=[*kept.schema.names, "single", "above_single"],
            )

    return screen


def screened(rows: DataFrame, cells: int | None = None) -> DataFrame:
    """``rows`` of ``prefixes`` with ``single`` and ``above_single``: whether the sketch proves that only one
    conversation has the prefix, or the one a turn shorter."""
    n = rows.count()
    width = cells or min(max(FEWEST_CELLS, 1 << max(4 * n - 1, 1).bit_length()), MOST_CELLS)
    sketch = rows.sparkSession.sparkContext.broadcast(full_cells(rows, width))
    own = _cells(width, *map(F.col, _NODE))
    above = _cells(width, F.col("pos") - 1, F.col("q1"), F.col("q2"))
    asked = rows.select("*", *(c.alias(f"c{i}") for i, c in enumerate(own)), *(c.alias(f"d{i}") for i, c in enumerate(above)))
    schema = "conv_id long, pos long, p1 long, p2 long, q1 long, q2 long, n_bytes long, last boolean"
    return in_arrow(asked.select(*rows.columns, "c0", "c1", "d0", "d1"), _screen(sketch), f"{schema}, single boolean, above_single boolean")


# Digests of the ids that end at a node


def _joiner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of each node as stretches of text: node, first id, stretch."""
    names = [*_NODE, "first", "ids"]
    types = [pa.int64()] * 4 + [pa.string()]
    node, ids, size, out = None, [], 0, []

    def put() -> None:
        if ids:
            out.append((*node, int(ids[0]), ",".join(ids)))
            ids.clear()

    for batch in batches:
        for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "conv_id")), strict=True):
            if key != node or size > CHUNK:
                put()
                node, size = key, 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out = []
    put()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest = None, None
    for batch in batches:
        out = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids")), strict=True):
            if key != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if out:
            yield _digests(out)
    if node is not None:
        yield _digests([(*node, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.string()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[*_NODE, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """Digest of the ascending ids of each node of ``ends(pos, p1, p2, conv_id)``, joined by commas.

    Ids are sorted and joined in ranges that split a large node; only the stretches of text, a chunk each, of one node
    go to one task, where they are hashed one after the other, as the digest demands, and none is held.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*_NODE, "conv_id"]
    dealt = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    stretches = in_arrow(dealt, _joiner, "pos long, p1 long, p2 long, first long, ids string")
    placed = stretches.repartition(*_NODE).sortWithinPartitions(*_NODE, "first")
    return in_arrow(placed, _hasher, "pos long, p1 long, p2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, cells: int | None = None) -> DataFrame:
    """Nodes of the prefix trie of ``turns(conv_id, pos, key, n_bytes)`` and ``convs(conv_id, total)``, one per distinct
    prefix: ``conv_id`` (the smallest that has it), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens``
    (bytes that are read once instead of by each conversation, in the whole subtree), ``ends_sha256``. ``cells`` is the
    width of the sketch; it changes how much is shuffled, never a result. No conversations: no rows.
    """
    rows = keep(prefixes(turns, convs), "prefixes")
    marked = screened(rows, cells)
    # What may be shared, the first prefix below it of each conversation, and where the others end.
    shuffled = keep(marked.where("not single or last or not above_single"), "shared")
    shared, edges = shuffled.where("not single"), shuffled.where("single and not above_single and pos > 1")
    nodes = shared.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max("above_single").alias("above_single"),
    )
    nodes = keep(nodes, "nodes")
    above = [(F.col("pos") - 1).alias("pos"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = nodes.where("pos > 0 and not above_single").select(*above).unionAll(
        shuffled.where("single and not above_single and pos > 0").select(*above)
    )
    counted = children.groupBy(*_NODE).agg(F.count("*").alias("n_children"))
    nodes = keep(nodes.join(counted, [*_NODE], "left").fillna(0, "n_children"), "counted")
    # Leaves, and bytes saved at a node, stand at the smallest conversation that has it; sums from the end of each
    # conversation upwards then hold everything below a prefix, once.
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    own = nodes.select("conv_id", "pos", (F.col("n_children") == 0).cast("long").alias("leaves"), saved.alias("saved"))
    zero = F.lit(0).cast("long")
    path = shared.select("conv_id", *_NODE).join(own.where("leaves > 0 or saved > 0"), ["conv_id", "pos"], "left")
    path = path.fillna(0, ["leaves", "saved"]).select("conv_id", *_NODE, "leaves", "saved", F.lit(True).alias("shared"))
    ends = shuffled.where("single and last").select(
        "conv_id", *_NODE, F.lit(1).cast("long").alias("leaves"), zero.alias("saved"), F.lit(False).alias("shared")
    )
    below = _running(path.unionAll(ends), ["leaves", "saved"], backwards=True).where("shared").groupBy(*_NODE).agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    first = nodes.select((F.col("pos") + 1).alias("pos"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    # All nodes of depth 1 have the root above them, whose id is the smallest of all.
    root = convs.agg(F.min("conv_id")).scalar()
    parent = F.when(F.col("pos") == 1, root).when(F.col("above_single"), F.col("conv_id")).otherwise(F.col("parent"))
    parent = F.when(F.col("pos") > 0, parent).alias("parent_conv_id")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    deep = nodes.join(first.where("pos > 1"), ["pos", "q1", "q2"], "left").join(below, [*_NODE])
    exact = deep.join(end_digests(shared.where("last")), [*_NODE], "left").select(
        "conv_id", F.col("pos").alias("depth"), parent, "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
    one = F.lit(1).cast("long")
    alone = (
        "conv_id", F.col("pos").alias("depth"), parent, one.alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    tails = marked.where("single and (above_single or pos < 2)").withColumn("parent", F.lit(None).cast("long")).select(*alone)
    edges = edges.join(first, ["pos", "q1", "q2"]).select(*alone)
    return exact.unionByName(tails).unionByName(edges)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations(conv_id, turn, role, text)`` as they are.

    Turns are in the order of their numbers, null first; equal numbers in that of role and text, so repeated rows are
    turns of their own. Null role or text: empty. Null ``conv_id``: in no conversation, left out. Very long texts are
    hashed whole, very long conversations in blocks. An empty table gives no rows. Other columns are not used.
    """
    return trie(*numbered_turns(conversations))


def shared_openings_trie(conversations: DataFrame) -> DataFrame:
    """As ``conversation_trie``, of conversations that begin as the first of their family of ids does."""
    return trie(*with_shared_openings(*numbered_turns(conversations)))

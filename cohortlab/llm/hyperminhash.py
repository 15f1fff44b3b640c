"""Near duplicates by HyperMinHash: compressed registers, banding, corrected estimates, exact verification.

A document is the set of hashes of its word shingles. The hashes fall into 128 buckets; a register holds, of the
smallest hash in its bucket, the number of leading zeros and the following mantissa bits, 16 bits in all. Four
registers make a band, one 64-bit number. Two sets with a similarity of 0.8 miss all 32 bands with a probability
of 5e-8, less if one link already ties them to others. The estimate before the full sets loses such a pair with a
probability of 3e-08 more (binomial, at most 75 of 128 registers equal).

1. Texts with the same word sequence are one class; only classes go on.
2. Classes that share a band are compared with the leader of that band (eight different orders, so a large group is
   compared with several leaders): estimate from the registers, then the full sets.
3. Where members of a band are still in different components, all of them are compared in blocks of bounded size:
   estimates from the registers, then the full sets for what passes. Pairs stay inside the block; what leaves it
   are links, fewer than the block has members. So no link between different components is lost,
   but for those two probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.components import components
from cohortlab.llm.shingles import binary, runs, shingle_set, text_key, word_list
from cohortlab.llm.tables import field, in_arrow, keep, numbered, packed, unpacked

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA = 10
BANDS = REGISTERS // 4
EMPTY = 0xFFFF
ORDERS = 8
# Members and shingles that a side of a block has at most, but for one longer text.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 2_000_000
# Estimates may fall short of the threshold by so many standard errors.
MARGIN = 6.0

_EDGES = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
# Fixed value: expected share of colliding registers of two large disjoint sets of one size, times 2^mantissa.
_COLLIDE = 0.169919487159739093975315012348


def registers(hashes: np.ndarray) -> np.ndarray:
    """16-bit registers of sorted distinct hashes: 6 bits of leading zeros, 10 bits of mantissa."""
    out = np.full(REGISTERS, EMPTY, dtype=np.uint16)
    if not len(hashes):
        return out
    first = np.searchsorted(hashes, _EDGES)
    filled = np.append(first[1:], len(hashes)) > first
    rest = (hashes[first[filled]] << np.uint64(BUCKET_BITS)) | np.uint64(1 << (BUCKET_BITS - 1))
    # Float exponents count the leading zeros; rounding up to the next power of two is undone.
    zeros = 64 - np.frexp(rest.astype(np.float64))[1]
    zeros = zeros + ((rest << zeros.astype(np.uint64)) >> np.uint64(63) == 0)
    mantissa = (rest << zeros.astype(np.uint64) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out[filled] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected number of equal registers of two disjoint sets of sizes ``n`` and ``m``."""
    n, m = np.maximum(n, 1.0), np.maximum(m, 1.0)
    ratio = np.maximum(n, m) / np.minimum(n, m)
    both = -np.expm1(-n / REGISTERS) * -np.expm1(-m / REGISTERS)
    return REGISTERS * _COLLIDE * 4 * ratio / (1 + ratio) ** 2 * both / 2**MANTISSA


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of rows of registers, corrected for collisions, and the registers they rest on."""
    filled_a = a != EMPTY
    used = (filled_a | (b != EMPTY)).sum(axis=-1)
    same = ((a == b) & filled_a).sum(axis=-1)
    return (same - collisions(n, m)) / np.maximum(used, 1), used


def _likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    t = percent / 100
    value, used = estimates(a, b, n, m)
    short = np.minimum(n, m) * 100 < percent * np.maximum(n, m)
    return ~short & (value >= t - MARGIN * np.sqrt(t * (1 - t) / np.maximum(used, 1)))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least ``percent`` % of their union in common."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _sketcher(k: int) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys, sizes = np.zeros((n, 2), dtype=np.int64), np.zeros(n, dtype=np.int64)
            bands = np.empty((n, REGISTERS), dtype=np.uint16)
            for i, text in enumerate(binary(batch.column("text"))):
                words = word_list(text)
                hashes = shingle_set(words, k)
                if words:
                    keys[i] = text_key(words)
                sizes[i], bands[i] = len(hashes), registers(hashes)
            numbers = bands.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(np.ascontiguousarray(x)) for x in (*keys.T, sizes, *numbers.T))],
                names=["doc_id", "text_hash", "h1", "h2", "n", *(f"b{j}" for j in range(BANDS))],
            )

    return sketch


def _set_maker(k: int) -> Callable:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)
            texts = [word_list(t) for t in binary(batch.column("text"))]
            # A repeated id may have another text; only the one of this class counts.
            own = [text_key(w) == key for w, key in zip(texts, keys, strict=True)]
            made = [shingle_set(w, k).tobytes() for w, mine in zip(texts, own, strict=True) if mine]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").filter(pa.array(own, pa.bool_())), pa.array(made, pa.binary())],
                names=["node", "hashes"],
            )

    return sets


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Registers of rows, from the numbers of their bands."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, BANDS).view(np.uint16)


def _estimator(percent: int) -> Callable:
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_matrix(batch.column(c)) for c in ("ra", "rb"))
                n, m = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                yield batch.select(["a", "b"]).filter(pa.array(_likely(a, b, n, m, percent)))

    return likely


def _verifier(percent: int) -> Callable:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)
            good = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verify


def _block_estimator(percent: int) -> Callable:
    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each member of a block that has likely partners of other components: these partners."""
        for block in runs(batches, "block"):
            part, band = block.column("part").to_numpy(), int(block.column("band")[0].as_py())
            node, label = block.column("node").to_numpy(), block.column("label").to_numpy()
            n = block.column("n").to_numpy().astype(float)
            regs = _matrix(block.column("regs"))
            numbers = regs.view(np.int64)
            lists: dict[int, list[int]] = {}
            left = np.flatnonzero(part != 1)
            for i in left.tolist():
                others = np.flatnonzero(part == 1) if part[i] == 0 else np.arange(i + 1, len(part))
                others = others[label[others] != label[i]]
                if len(others):
                    good = _likely(regs[i], regs[others], n[i], n[others], percent)
                    others = others[good]
                if len(others):
                    # Each pair counts in the first band that it shares.
                    first = ((numbers[others] == numbers[i]) & (numbers[i] != -1)).argmax(axis=1)
                    others = others[first == band]
                if len(others):
                    lists.setdefault(i, []).extend(node[others].tolist())
                    for j in others.tolist():
                        lists.setdefault(j, [])
            if lists:
                rows = sorted(lists)
                yield pa.RecordBatch.from_arrays(
                    [block.column("block").combine_chunks().take(pa.array(rows)), pa.array(node[rows]),
                     pa.array(label[rows]), pa.array([lists[i] for i in rows], pa.list_(pa.int64()))],
                    names=["block", "node", "label", "partners"],
                )

    return partners


def _block_verifier(percent: int) -> Callable:
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of a block; pairs that a link of the block already joins need no test."""
        for block in runs(batches, "block"):
            node, label = block.column("node").to_pylist(), block.column("label").to_pylist()
            hashes = dict(zip(node, block.column("hashes").to_pylist(), strict=True))
            label_of = dict(zip(node, label, strict=True))
            parent = {x: x for x in label}

            def root(x: int, parent: dict[int, int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            found = []
            for a, others in zip(node, block.column("partners").to_pylist(), strict=True):
                mine = np.frombuffer(hashes[a], np.uint64)
                for b in others:
                    ra, rb = root(label_of[a]), root(label_of[b])
                    if ra != rb and linked(mine, np.frombuffer(hashes[b], np.uint64), percent):
                        parent[ra] = rb
                        found.append((label_of[a], label_of[b]))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())],
                    names=["a", "b"],
                )

    return links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs(doc_id, text)``.

    Texts are linked if at least ``percent`` % of the union of their shingle sets is common; A-Z count as a-z.
    ``n_shingles`` is the size of the set; with fewer words than a shingle has, the whole sequence is one shingle.
    ``component_id`` is the smallest id that links reach, ``kept`` whether it is the row's own.

    Null or empty text, or no word in it: 0 shingles, linked with nothing, kept. Null ids take part like others and
    come after all ids; rows alone with null ids have a null component and are kept. Rows that repeat an id and a
    text get the same result; an id with several texts has a row for each. Very long texts are read whole. Ties
    need no rule: components do not depend on order. An empty table gives no rows. Other columns are not used.
    """
    return _grouped(docs, words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest id.

    Columns as in ``docs``. Of repeated rows, and of rows with one id in one component, one stays; rows without
    words stay unless id and text are repeated. Other cases as in ``near_duplicates``.
    """
    kept = _grouped(docs, words, percent).where("kept")
    keys = [F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("doc_id").isNull().alias("k2")]
    chosen = kept.groupBy(*keys, "group").agg(F.min("text_hash").alias("k3")).select("k1", "k2", "k3").distinct()
    doc_id = field("doc_id").cast("long")
    rows = packed(
        docs, F.coalesce(doc_id, F.lit(0)).alias("k1"), doc_id.isNull().alias("k2"),
        F.xxhash64(field("text")).alias("k3"),
    )
    names = ["k1", "k2", "k3"]
    return unpacked(rows.join(chosen, names, "left_semi").dropDuplicates(names), docs.columns)


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The result of ``near_duplicates`` with the hash of the text and the number of the component."""
    texts = docs.select(
        field("doc_id").cast("long").alias("doc_id"), field("text").cast("string").alias("text"),
        F.xxhash64(field("text").cast("string")).alias("text_hash"),
    )
    numbers = [f"b{j}" for j in range(BANDS)]
    schema = "doc_id long, text_hash long, h1 long, h2 long, n long, " + ", ".join(f"{b} long" for b in numbers)
    sketches = keep(in_arrow(texts, _sketcher(words), schema), "sketches")

    # One row per word sequence, and the id and text hash of the row that stands for it.
    classes = sketches.where("n > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"),
        F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("rep_text"),
        F.max("n").alias("n"), *(F.max(b).alias(b) for b in numbers),
    )
    classes = numbered(classes, "classes")

    # Members of the bands that two or more classes share.
    banded = classes.select("node", "n", F.posexplode(F.array(*numbers)).alias("band", "number")).where("number != -1")
    banded = banded.select(
        "node", "n", "band", F.xxhash64("band", "number").alias("bucket"),
        F.xxhash64("node", F.pmod("band", F.lit(ORDERS))).alias("turn"),
    )
    shared = banded.groupBy("bucket").agg(
        F.count("*").alias("members"), F.min("turn").alias("lead"), F.sum("n").alias("shingles")
    ).where("members > 1")
    members = keep(banded.drop("n").join(shared, "bucket"), "members")

    involved = members.select("node").distinct()
    involved = keep(classes.join(involved, "node").select(
        "node", "rep", "rep_text", "h1", "h2", "n", F.array(*numbers).alias("regs")
    ), "involved")
    regs = involved.select("node", "n", "regs")
    wanted = involved.select("node", "rep", "rep_text", "h1", "h2")
    own = texts.join(
        wanted, texts["doc_id"].eqNullSafe(wanted["rep"]) & (texts["text_hash"] == wanted["rep_text"])
    ).select("node", "h1", "h2", "text")
    sets = in_arrow(own, _set_maker(words), "node long, hashes binary").dropDuplicates(["node"])
    sets = keep(sets, "sets")

    # Each member against the leader of its band.
    leaders = members.where("turn = lead").select("bucket", F.col("node").alias("leader"))
    pairs = members.join(leaders, "bucket").where("node != leader").select(
        F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")
    ).distinct()
    with_regs = (
        pairs.join(regs.toDF("a", "na", "ra"), "a").join(regs.toDF("b", "nb", "rb"), "b")
        .select("a", "b", "na", "nb", "ra", "rb")
    )
    likely = in_arrow(with_regs, _estimator(percent), "a long, b long")
    links = likely.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    links = keep(in_arrow(links, _verifier(percent), "a long, b long"), "links")
    labels = components(links)

    # Whatever is still apart within a band, in blocks. Members of the largest component of a band have slots of
    # their own, which are only paired with the slots of the others.
    placed = _relabelled(members.where("members > 2"), labels)
    parts = placed.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    parts = parts.groupBy("bucket").agg(F.max(F.struct("size", "label")).alias("main"), F.count("*").alias("parts"))
    placed = placed.join(parts.where("parts > 1"), "bucket")
    in_main = F.col("label") == F.col("main.label")
    by_size = F.ceil(F.col("shingles") / BLOCK_SHINGLES)
    slots = F.greatest(F.ceil(F.col("main.size") / BLOCK_MEMBERS), by_size).cast("long")
    others = F.greatest(F.ceil((F.col("members") - F.col("main.size")) / BLOCK_MEMBERS), by_size).cast("long")
    placed = placed.withColumns({"slots": slots, "others": others})
    turn = F.xxhash64("node", F.lit("block"))
    slot = F.when(in_main, F.pmod(turn, F.col("slots"))).otherwise(F.col("slots") + F.pmod(turn, F.col("others")))
    first = F.when(in_main, F.col("slots")).otherwise(F.lit(0).cast("long"))
    placed = placed.withColumn("slot", slot)
    placed = placed.withColumn("other", F.explode(F.sequence(first, F.col("slots") + F.col("others") - 1)))
    block = F.xxhash64("bucket", F.least("slot", "other"), F.greatest("slot", "other"))
    part = F.when(F.col("slot") < F.col("other"), 0).when(F.col("slot") > F.col("other"), 1).otherwise(2)
    blocks = placed.select(block.alias("block"), part.alias("part"), "band", "node", "label").join(regs, "node")
    partners = keep(in_arrow(
        _in_blocks(blocks), _block_estimator(percent), "block long, node long, label long, partners array<long>"
    ), "partners")
    more = in_arrow(_in_blocks(partners.join(sets, "node")), _block_verifier(percent), "a long, b long")
    merged = components(more)

    final = labels.join(merged.toDF("label", "merged"), "label", "left").select(
        "node", F.coalesce("merged", "label").alias("label")
    )
    alone = merged.join(labels, "node", "left_anti")
    grouped = _relabelled(classes.select("node", "h1", "h2", "rep"), final.unionByName(alone))
    ids = grouped.groupBy("label").agg(F.min("rep").alias("component"))
    grouped = grouped.join(ids, "label").select("h1", "h2", "component", F.col("label").alias("group"))
    out = sketches.select("doc_id", "text_hash", "n", "h1", "h2").join(grouped, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash", "group",
    )


def _relabelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with the label of each node, itself if it has none."""
    out = nodes.join(labels, "node", "left")
    return out.withColumn("label", F.coalesce("label", "node"))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of a block together and in the same task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "block").sortWithinPartitions("block", "node")

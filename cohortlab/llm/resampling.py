"""Importance resampling towards a target distribution.

Runs of words are counted by bucket over all texts and over the target; the logarithm of the two rates is the gain of a
bucket, and one array of gains scores every text. A Gumbel term made from the id turns the best scores into a weighted
draw without replacement. The draw is ranked by parallel sorting by regular sampling: rows are sorted in runs, regular
samples of the runs give splitters at regular places, rows are exchanged by the segment between two splitters, sorted
segments are merged where they land, and the numbers of rows before each segment make the ranks exact.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.shingles import binary
from cohortlab.llm.tables import field, in_arrow, keep, numbered

# Buckets, words that a text needs to be drawn, share of these texts in percent, first part of the key.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, "2024"
# Segments of the sort at most; the driver sees one sample of each run for each of them.
SEGMENTS = 512
# Features whose bucket is looked up again, before they are forgotten, and the longest of them in bytes.
REMEMBERED, SHORT = 400_000, 64

_LETTERS = bytes(b + 32 * (65 <= b <= 90) if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def word_list(text: bytes | None) -> list[bytes]:
    """Words of ASCII letters and digits, A-Z lower-cased, and of all characters beyond ASCII."""
    return text.translate(_LETTERS).split() if text else []


def grams(words: list[bytes], orders: tuple[int, int]) -> list[bytes]:
    if orders == (1, 1):
        return words
    return [b" ".join(words[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(words) - n + 1)]


class Buckets(dict):
    """Bucket of a feature; forgets what it has seen when that becomes much."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.n
        if len(feature) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[feature] = bucket
        return bucket

    def of(self, features: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def _counter(buckets: int, orders: tuple[int, int]) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in binary(batch.column("text")):
                total += np.bincount(seen.of(grams(word_list(text), orders)), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, orders: tuple[int, int] = (1, 1)) -> np.ndarray:
    """How often the features of all rows of ``texts(text)`` fall in each bucket: one row per bucket and task is
    shuffled, one per bucket reaches the driver."""
    rows = texts.select(field("text").cast("string").alias("text"))
    counts = in_arrow(rows, _counter(buckets, orders), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the target's rate over the raw rate, by bucket, one added to each count."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    ratios = ((target + 1.0) * (s + n)) / ((raw + 1.0) * (t + n))
    # The C library's logarithm: vectorised ones may differ in the last bit.
    return np.array([math.floor(1000 * math.log(x)) for x in ratios.tolist()], dtype=np.int64)


def gumbel(seed: str, doc_id: int | None) -> int:
    """Thousandths of a Gumbel draw that an id always gets; a null id has an empty key."""
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scorer(gain: np.ndarray, orders: tuple[int, int], seed: str) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Buckets(len(gain))
        for batch in batches:
            words, sizes, weights = [], [], []
            for text in binary(batch.column("text")):
                found = word_list(text)
                features = grams(found, orders)
                words.append(len(found))
                sizes.append(len(features))
                weights.append(int(gain[seen.of(features)].sum()))
            ids = batch.column("doc_id").to_pylist()
            scores = [w + gumbel(seed, i) for w, i in zip(weights, ids, strict=True)]
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, sizes, weights, scores))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight", "score"])

    return score


# Parallel sorting by regular sampling


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _segmenter(splitters: list[np.ndarray]) -> Callable:
    k = len(splitters[0])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.concatenate(pair) for pair in zip(splitters, _columns(batch, ("k1", "k2", "k3")), strict=True)]
            # A stable sort of both: a row's segment is the number of splitters that stand at or before it.
            order = np.lexsort(keys[::-1])
            before = np.cumsum(order < k)
            segment = np.empty(len(order), dtype=np.int32)
            segment[order] = before
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(segment[k:])], names=[*batch.schema.names, "segment"]
            )

    return deal


def _numberer(starts: dict[int, int]) -> Callable:
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            ranks = np.empty(batch.num_rows, dtype=np.int64)
            segments = batch.column("segment").to_numpy(zero_copy_only=False)
            # Sorted, so each segment is one stretch of the batch.
            for s, first, n in zip(*np.unique(segments, return_index=True, return_counts=True), strict=True):
                at = seen.get(int(s), starts[int(s)])
                ranks[first : first + n] = np.arange(at + 1, at + n + 1)
                seen[int(s)] = at + int(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks)], names=[*batch.schema.names, "rank"])

    return number


def regular_ranks(rows: DataFrame, segments: int | None = None) -> DataFrame:
    """``rows(score, doc_id, ...)`` with ``rank``: 1 for the highest score, ties to the smaller id, null ids last.

    Rows with equal score and id stand in any order, fixed by a written copy, so no group of equal rows is too large
    for one segment. A segment has no more than the rows of two equal shares, whatever the scores are.
    """
    spark = rows.sparkSession
    segments = segments or min(int(spark.conf.get("spark.sql.shuffle.partitions")), SEGMENTS)
    keyed = rows.withColumn("k1", -F.col("score")).withColumn("k2", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    # Each task's rows are a sorted run; the number of a row is that of its run and its place in it.
    runs = numbered(keyed.sortWithinPartitions("k1", "k2"), "runs", "k3")
    run, place = F.shiftright("k3", 33), F.col("k3").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in runs.groupBy(run.alias("run")).count().collect()}
    if not sizes:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    strides = spark.createDataFrame([(r, max(1, n // segments)) for r, n in sizes.items()], "run long, stride long")
    sample = runs.select("k1", "k2", "k3", run.alias("run"), place.alias("place")).join(F.broadcast(strides), "run")
    taken = sample.where(F.col("place") % F.col("stride") == 0).select("k1", "k2", "k3").toArrow()
    keys = [taken.column(c).to_numpy() for c in ("k1", "k2", "k3")]
    order = np.lexsort(keys[::-1])
    at = np.linspace(0, len(order), segments + 1, dtype=np.int64)[1:-1]
    splitters = [k[order][at] for k in keys]
    dealt = in_arrow(runs, _segmenter(splitters), f"{_ddl(runs)}, segment int")
    counts = {r[0]: r[1] for r in dealt.groupBy("segment").count().collect()}
    starts, before = {}, 0
    for s in range(segments):
        starts[s], before = before, before + counts.get(s, 0)
    exchanged = dealt.repartitionById(segments, F.col("segment")).sortWithinPartitions("segment", "k1", "k2", "k3")
    ranked = in_arrow(exchanged, _numberer(starts), f"{_ddl(runs)}, segment int, rank long")
    return ranked.select(*map(field, rows.columns), "rank")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)


def resample(
    documents: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    orders: tuple[int, int] = (1, 1),
    seed: str = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` (all long) for each row of ``documents(doc_id, text)``.

    ``rank`` is the place in the draw of ``percent`` of the rows with ``least_words`` words or more, rounded down; null
    for all others. Features are the runs of ``orders[0]`` to ``orders[1]`` words. ``target`` has a column ``text``.

    Null or empty text: no features, weight 0, never drawn. Null id: an empty key, last among ties. Repeated rows are
    counted, scored and drawn each for itself; several texts with one id share their Gumbel draw. Very long texts are
    read whole. An empty table gives no rows; an empty target has the same rate for all buckets. Other columns are not
    used.
    """
    texts = documents.select(field("doc_id").cast("long").alias("doc_id"), field("text").cast("string").alias("text"))
    gain = gains(bucket_counts(texts, buckets, orders), bucket_counts(target, buckets, orders))
    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    # Narrow rows, written once; read again they make few runs.
    scored = keep(in_arrow(texts, _scorer(gain, orders, seed), schema), "scored")
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = percent * eligible.count() // 100
    ranks = regular_ranks(eligible).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranks.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")

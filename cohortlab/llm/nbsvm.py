"""Quality classifier: Naive Bayes log-count ratios and a linear support vector machine.

Each text becomes a set of n-gram indicators, hashed to buckets: its words, runs of one and two word shapes (``Aa.``,
``a$``), and one for the share of its word triples that it has more than once. Every labelled training text counts
towards the ratios; each indicator is scaled by the logarithm of its rate in good texts over that in bad ones. A linear
hinge-loss model is then fitted to the scaled, unit-length vectors by dual coordinate descent, its weights are drawn
towards their mean size, and a logistic curve, fitted to margins of texts that their model did not see, makes scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.shingles import binary
from cohortlab.llm.tables import field, in_arrow, keep

# Ids of buckets take two bytes.
BUCKETS = 65_536
# Training texts of each class that the descent and the curve are fitted on; the ratios are counted over all of them.
SAMPLE = 10_000
# Bound of the dual variables, passes over the sample, share of the mean weight, smallest change of a pass.
COST, PASSES, TOWARDS_MEAN, ENOUGH = 10.0, 15, 0.75, 1e-3
# Parts of the sample, each of which gets its margins for the curve from a model of the others.
PARTS = 3
THRESHOLD = 0.7

# Small and large letters, digits and blanks are one character each; all that is beyond ASCII counts as small letters.
_SHAPE = bytes(
    97 if 97 <= b <= 122 or b > 127 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if 9 <= b <= 13 else b
    for b in range(256)
)
_TRIPLE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def shapes(text: bytes) -> list[bytes]:
    """The shape of each word: runs of one kind of character are one character."""
    kinds = np.frombuffer(text.translate(_SHAPE), np.uint8)
    return kinds[np.append(True, kinds[1:] != kinds[:-1])].tobytes().split()


def indicators(text: bytes | None) -> bytes:
    """The distinct buckets of a text in ascending order, two bytes each."""
    words = text.lower().split() if text else []
    if not words:
        return b""
    found = {zlib.crc32(w) for w in set(words)}
    kinds = shapes(text)
    found.update(zlib.crc32(b"\1" + k) for k in set(kinds))
    found.update(zlib.crc32(b"\2" + a + b" " + b) for a, b in set(zip(kinds, kinds[1:], strict=False)))
    n = len(words) - 2
    if n > 0:
        x = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        triples = x[:n] * _TRIPLE[0] ^ x[1 : n + 1] * _TRIPLE[1] ^ x[2:] * _TRIPLE[2]
        triples.sort()
        repeated = int((triples[1:] == triples[:-1]).sum())
        found.add(zlib.crc32(b"\3%d" % (10 * repeated // n)))
    return np.unique(np.fromiter(found, np.int64, len(found)) % BUCKETS).astype(np.uint16).tobytes()


def _indicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [indicators(text) for text in binary(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "found"])


def _vector(found: bytes) -> np.ndarray:
    return np.frombuffer(found, np.uint16).astype(np.int64)


# Counting and fitting


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that have each indicator; the class itself is counted under bucket -1."""
    totals, texts = np.zeros((2, BUCKETS), dtype=np.int64), [0, 0]
    for batch in batches:
        for found, y in zip(batch.column("found").to_pylist(), batch.column("y").to_pylist(), strict=True):
            totals[y][_vector(found)] += 1
            texts[y] += 1
    used = np.flatnonzero(totals.sum(axis=0))
    columns = [np.append(used, -1), *(np.append(totals[y][used], texts[y]) for y in (0, 1))]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "bad", "good"])


def ratios(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Logarithm of the rate of each indicator in good texts over that in bad ones, one added to each count."""
    return np.log((good + 1) / (good + 1).sum()) - np.log((bad + 1) / (bad + 1).sum())


def _scaled(found: bytes, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = _vector(found)
    x = ratio[at]
    return at, x / max(math.sqrt(float(x @ x)), 1e-9)


def descend(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of the hinge-loss model of ``rows`` (places and values) and their classes, -1 or 1.

    One dual variable at a time is moved to its best value between 0 and ``COST``, in a new order each pass.
    """
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    squares = [float(x @ x) + 1.0 for _, x in rows]
    order = np.random.default_rng(0)
    for _ in range(PASSES):
        moved = 0.0
        for k in order.permutation(len(rows)).tolist():
            at, x = rows[k]
            slope = signs[k] * (float(w[at] @ x) + b) - 1.0
            new = min(max(alpha[k] - slope / squares[k], 0.0), COST)
            if new != alpha[k]:
                step = (new - alpha[k]) * signs[k]
                w[at] += step * x
                b += step
                moved = max(moved, abs(step))
                alpha[k] = new
        if moved < ENOUGH:
            break
    return w, b


def logistic(margins: np.ndarray, good: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of class 1 by margin, by Newton steps on smoothed classes."""
    n1, n0 = float(weights[good].sum()), float(weights[~good].sum())
    wanted = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    at = np.array([0.0, math.log((n1 + 1) / (n0 + 1))])

    def loss(a: np.ndarray) -> float:
        z = x @ a
        return float(weights @ (np.logaddexp(0, z) - wanted * z)) + 1e-6 * float(a @ a)

    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ at)))
        slope = x.T @ (weights * (p - wanted)) + 2e-6 * at
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2)
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def margin(self, found: bytes) -> float:
        at, x = _scaled(found, self.ratio)
        return float(self.weights[at] @ x) + self.intercept

    def score(self, found: bytes) -> float:
        z = self.slope * self.margin(found) + self.offset
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def constant(good: int, bad: int) -> Model:
    """For training texts of one class, or none: every text gets the smoothed share of good ones."""
    zero = np.zeros(BUCKETS)
    return Model(zero, zero, 0.0, 0.0, math.log((good + 1) / (bad + 1)))


def _fitted(rows: list[tuple[bytes, int]], ratio: np.ndarray) -> Model:
    w, b = descend([_scaled(f, ratio) for f, _ in rows], np.array([2.0 * y - 1 for _, y in rows]), BUCKETS)
    return Model(ratio, (1 - TOWARDS_MEAN) * w + TOWARDS_MEAN * np.abs(w).mean(), b, 1.0, 0.0)


def fit(sample: list[tuple[bytes, int, int]], bad: np.ndarray, good: np.ndarray, texts: tuple[int, int]) -> Model:
    """From a sample of ``(indicators, class, part)`` and the counts over all training texts."""
    ratio = ratios(bad, good)
    unseen = []
    for part in range(PARTS):
        others = [(f, y) for f, y, p in sample if p != part]
        if len({y for _, y in others}) == 2:
            model = _fitted(others, ratio)
            unseen += [(model.margin(f), y == 1) for f, y, p in sample if p == part]
    model = _fitted([(f, y) for f, y, _ in sample], ratio)
    if len({y for _, y in unseen}) < 2:
        unseen = [(model.margin(f), y == 1) for f, y, _ in sample]
    margins, of_class = np.array([m for m, _ in unseen]), np.array([y for _, y in unseen])
    # Each class counts as much as it does among all training texts.
    share = [texts[y] / max(1, int((of_class == bool(y)).sum())) for y in (0, 1)]
    slope, offset = logistic(margins, of_class, np.where(of_class, share[1], share[0]))
    return replace(model, slope=slope, offset=offset)


def learn(training: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of ``training(doc_id, found, y)``; ``sample`` bounds the rows of each class that reach the driver."""
    counted = in_arrow(training.select("found", "y"), _count, "bucket long, bad long, good long")
    counts = counted.groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
    bad, good, texts = np.zeros(BUCKETS), np.zeros(BUCKETS), (0, 0)
    for r in counts:
        if r["bucket"] < 0:
            texts = r["bad"], r["good"]
        else:
            bad[r["bucket"]], good[r["bucket"]] = r["bad"], r["good"]
    if not all(texts):
        return constant(texts[1], texts[0])
    # A share of each class by the hash of id and indicators; the limit only guards against very many equal rows.
    draw = F.pmod(F.xxhash64("doc_id", "found"), F.lit(1 << 30)) / float(1 << 30)
    part = F.pmod(F.xxhash64("found", "doc_id"), F.lit(PARTS)).cast("int").alias("part")
    taken = []
    for y in (0, 1):
        some = training.where((F.col("y") == y) & (draw < 0.95 * sample / texts[y])).select("found", "y", part)
        taken += some.limit(sample).collect()
    if len({r["y"] for r in taken}) < 2:
        return constant(texts[1], texts[0])
    # In the order of the contents, so that the fit does not depend on how tasks end.
    return fit(sorted((bytes(r["found"]), r["y"], r["part"]) for r in taken), bad, good, texts)


def _scorer(model: Model) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(f) for f in batch.column("found").to_pylist()], pa.float64())
            columns = [batch.column("doc_id"), batch.column("held_out"), scores]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score"])

    return score


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score`` (from 0 to 1, higher for texts like those of quality 1) and ``predicted`` (int) for
    each row of ``documents(doc_id, text)``; ``labels(doc_id, quality)``.

    Learns from all labelled rows that are not held out; ``sample`` bounds those of each class that the hinge-loss
    model itself is fitted on. Null or empty text: no indicators, so the score follows from the intercept. Null id:
    scored, never labelled, its remainder that of an empty text. Repeated rows are each scored, and count each time
    if labelled; a text with several labels has the lowest; null labels do not count. Very long texts are read whole.
    Labels of one class, or none: one score for all. An empty table gives no rows. Other columns are not used.
    """
    rows = documents.select(field("doc_id").cast("long").alias("doc_id"), field("text").cast("string").alias("text"))
    # Texts are read once; their indicators serve the counts, the sample and the scores.
    found = keep(in_arrow(rows, _indicate, "doc_id long, found binary"), "indicators")
    found = found.withColumn("held_out", held_out(F.col("doc_id")))
    marks = labels.where(field("quality").isin(0, 1)).groupBy(field("doc_id").cast("long").alias("doc_id")).agg(
        F.min(field("quality")).cast("int").alias("y")
    )
    training = keep(found.where(~F.col("held_out")).drop("held_out").join(marks, "doc_id"), "training")
    scored = in_arrow(found, _scorer(learn(training, sample)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Many boosts over the same rows at once, with the trees of Spark's learner.

Rows are blocks of arrays: bins of the features, label, and the predictions of every boost. A level of the trees that
all boosts fit at a time is one pass over the blocks: it sums by node and bin, then the splits are picked. While the rows
are few, each group of boosts is grown in one task, which holds them all (``Held``). Otherwise they stay in their
partitions and a pass is a Spark job, whose sums the driver adds up (``Spread``). Split candidates, rows drawn for a
tree, gains and ties are those of ``GBTRegressor`` with squared error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import lru_cache, partial, reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.session import remove_folder

# Rows of a block, whose arrays fit a processor's cache.
BLOCK = 1 << 14
# Rows that one task holds: some 60 bytes each, and 8 for every boost it grows.
HELD = 1 << 21
# Codes of a column of several features with few bins.
CODES = 1024
# Partitions whose sums the driver adds up itself.
DIRECT = 16
# Leaves are bits of a number of 32, so trees are at most this deep.
DEEPEST = 5
EPSILON = float(np.finfo(float).eps)

Cut = tuple[int, int, int]


@dataclass(frozen=True)
class Boost:
    """What one boost is: the fold it leaves out (or none), number, depth and step of its trees, share of rows for each."""

    fold: int | None
    trees: int
    depth: int
    step: float
    rate: float


@dataclass(frozen=True)
class Layout:
    """Thresholds of each feature by the fold left out, and how features are packed into columns of codes."""

    thresholds: dict[int | None, list[np.ndarray]]
    widths: tuple[int, ...]
    columns: tuple[tuple[int, ...], ...]
    # All rows are one block. Rows are added up one by one for every node and feature: sums are Spark's to the last bit.
    in_order: bool
    rows: int

    def codes(self, column: int) -> int:
        return int(np.prod([self.widths[f] for f in self.columns[column]]))

    def bins(self, column: int) -> dict[int, np.ndarray]:
        """The bin of each feature of a column by code."""
        features = self.columns[column]
        at = np.unravel_index(np.arange(self.codes(column)), [self.widths[f] for f in features])
        return dict(zip(features, at, strict=True))

    def by_bin(self, column: int, sums: np.ndarray) -> np.ndarray:
        """Sums by code (the last axis) added up by bin, one feature after the other."""
        features = self.columns[column]
        apart = sums.reshape(*sums.shape[:-1], *(self.widths[f] for f in features))
        first, every = sums.ndim - 1, range(len(features))
        return np.concatenate([apart.sum(axis=tuple(first + j for j in every if j != i)) for i in every], axis=-1)

    def places(self) -> dict[int, slice]:
        """Where the bins of a feature stand among those of all columns."""
        out, at = {}, 0
        for f in (f for features in self.columns for f in features):
            out[f] = slice(at, at := at + self.widths[f])
        return out


@dataclass
class Tree:
    """Nodes by number: 1 is the root, 2n and 2n + 1 are below n. Stats are rows, sum and sum of squares."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)
    stats: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    open: list[int] = field(default_factory=lambda: [1])

    def value(self, node: int) -> float:
        n, total, _ = self.stats[node]
        return total / n if n else 0.0

    def outline(self) -> tuple[list[int], list[Cut]]:
        """Leaves from left to right; feature, bin and, as bits, the leaves to the left of each split."""
        leaves: list[int] = []
        cuts: list[Cut] = []

        def walk(node: int) -> None:
            if node not in self.splits:
                leaves.append(node)
                return
            first = len(leaves)
            walk(2 * node)
            cuts.append((*self.splits[node], (1 << len(leaves)) - (1 << first)))
            walk(2 * node + 1)

        walk(1)
        return leaves, cuts


# Rows drawn for a tree


def _hashed(data: bytes, seed: int) -> int:
    """Murmur3 of whole words."""
    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _stepped(x: np.ndarray) -> np.ndarray:
    x = x ^ (x << np.uint64(21))
    x ^= x >> np.uint64(35)
    return x ^ (x << np.uint64(4))


@lru_cache(maxsize=1)
def _jumps(steps: int) -> list[list[int]]:
    """What ``steps`` steps make of each byte of a state: a step is linear, so its bytes are taken one by one."""
    x = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for _ in range(steps):
        x = _stepped(x)
    bits = [int(v) for v in x]
    return [[reduce(int.__xor__, (bits[8 * b + i] for i in range(8) if v >> i & 1), 0) for v in range(256)] for b in range(8)]


class Draws:
    """Spark's random numbers of one partition, in the order of its rows, many at a time."""

    RUN = 128

    def __init__(self, seed: int):
        data = (seed & (1 << 64) - 1).to_bytes(8, "big")
        low = _hashed(data, 0x3C074A61)
        self.state = _hashed(data, low) << 32 | low
        self.drawn = np.empty(0)

    def until(self, n: int) -> np.ndarray:
        """The first ``n`` of them, at least."""
        if n > len(self.drawn):
            runs, jumps = -(-(n - len(self.drawn)) // self.RUN), _jumps(2 * self.RUN)
            states = []
            for _ in range(runs):
                states.append(self.state)
                self.state = reduce(int.__xor__, (jumps[b][self.state >> 8 * b & 255] for b in range(8)))
            x, new = np.array(states, dtype=np.uint64), np.empty((self.RUN, runs))
            for i in range(self.RUN):
                x = _stepped(x)
                high = (x & np.uint64((1 << 26) - 1)) << np.uint64(27)
                x = _stepped(x)
                new[i] = high + (x & np.uint64((1 << 27) - 1))
            self.drawn = np.concatenate([self.drawn, new.T.ravel() * 2.0**-53])
        return self.drawn


# In the tasks


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features, labels and folds as bytes, a row for each block."""
    parts: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        if t["label"].null_count or t["x"].null_count:
            raise ValueError("labels and features must not be null")
        label, x = t["label"].to_numpy(), t["x"].chunk(0).flatten().to_numpy().reshape(len(t), -1).T.copy()
        if not (np.isfinite(label).all() and np.isfinite(x).all()):
            raise ValueError("labels and features must be finite numbers")
        fold = t["fold"].to_numpy().astype(np.int32)
        return pa.RecordBatch.from_pydict({"n": [len(t)], "x": [x.tobytes()], "label": [label.tobytes()], "fold": [fold.tobytes()]})

    held = 0
    for batch in batches:
        while batch.num_rows:
            take = batch.slice(0, BLOCK - held)
            parts.append(take)
            batch, held = batch.slice(take.num_rows), held + take.num_rows
            if held == BLOCK:
                yield block()
                parts, held = [], 0
    if parts:
        yield block()


def _binned(layout: Layout, rows: Iterator[Any]) -> Iterator[dict]:
    """Blocks of one partition; ``before``: how many rows of it come before a block, by the fold left out."""
    before = dict.fromkeys(layout.thresholds, 0)
    for r in rows:
        x = np.frombuffer(r["x"]).reshape(-1, r["n"])
        fold = np.frombuffer(r["fold"], dtype=np.int32)
        codes, same = {}, {}
        for out, thresholds in layout.thresholds.items():
            codes[out] = []
            for features in layout.columns:
                key = features, *(thresholds[f].tobytes() for f in features)
                if key not in same:  # folds mostly agree on the bins; what they share is kept once
                    bins = [np.searchsorted(thresholds[f], x[f]) for f in features]
                    same[key] = np.ravel_multi_index(bins, [layout.widths[f] for f in features]).astype(np.uint16)
                codes[out].append(same[key])
        yield {"label": np.frombuffer(r["label"]), "fold": fold, "codes": codes, "before": dict(before)}
        before = {out: n + (r["n"] if out is None else int((fold != out).sum())) for out, n in before.items()}


def _started(block: dict, boosts: Sequence[Boost]) -> dict:
    """A block with what these boosts need, before their first tree."""
    folds = {b.fold for b in boosts}
    of = {name: {k: block[name][k] for k in folds} for name in ("codes", "before")}
    return block | of | {"predicted": np.zeros((len(boosts), len(block["label"]))), "drawn": {}}


_DE_BRUIJN = np.uint32(0x077CB531)
_PLACE = [(1 << b) * 0x077CB531 % (1 << 32) >> 27 for b in range(32)]


def _tables(layout: Layout, bins: list[dict[int, np.ndarray]], cuts: Sequence[Cut]) -> dict[int, np.ndarray]:
    """By column and code, the leaves that the splits on its features leave open. The first open one is a row's leaf."""
    column = {f: c for c, features in enumerate(layout.columns) for f in features}
    out: dict[int, np.ndarray] = {}
    for f, at, left in cuts:
        c = column[f]
        if c not in out:
            out[c] = np.full(layout.codes(c), 0xFFFFFFFF, dtype=np.uint32)
        out[c][bins[c][f] > at] &= np.uint32(0xFFFFFFFF ^ left)
    return out


def _by_leaf(tables: dict[int, np.ndarray], codes: Sequence[np.ndarray], values: Sequence[Any], kind: type) -> np.ndarray:
    """The value of each row's leaf."""
    left = None
    for c, table in tables.items():
        found = table.take(codes[c], mode="clip")
        left = found if left is None else np.bitwise_and(left, found, out=left)
    if left is None:
        return np.full(len(codes[0]), values[0], dtype=kind)
    left &= ~left + np.uint32(1)
    left *= _DE_BRUIJN
    left >>= np.uint32(27)
    ordered = np.zeros(32, dtype=kind)
    ordered[_PLACE[: len(values)]] = values
    return ordered.take(left, mode="clip")


def _advanced(
    layout: Layout, boosts: Sequence[Boost], seed: int, grown: Sequence[tuple | None] | None, part: int, blocks: Iterator[dict]
) -> Iterator[dict]:
    """Blocks with the last trees added to the predictions, and with the rows drawn for the next ones."""
    draws = Draws(seed + part + 1)
    bins = [layout.bins(c) for c in range(len(layout.columns))]
    tables = [g and _tables(layout, bins, g[1]) for g in grown or ()]
    for block in blocks:
        block = dict(block)
        if grown is not None:
            predicted = block["predicted"].copy()
            for i, (g, b) in enumerate(zip(grown, boosts, strict=True)):
                if g is not None:
                    predicted[i] += _by_leaf(tables[i], block["codes"][b.fold], g[0], float)
            block["predicted"] = predicted
        block["drawn"] = {}
        for b in boosts:
            if (b.fold, b.rate) not in block["drawn"]:
                there = np.full(len(block["fold"]), True) if b.fold is None else block["fold"] != b.fold
                if b.rate < 1:
                    at, n = block["before"][b.fold], int(there.sum())
                    there[there] = draws.until(at + n)[at : at + n] < b.rate
                block["drawn"][b.fold, b.rate] = there
        yield block


def _sums(
    layout: Layout, boosts: Sequence[Boost], first: bool, asked: Sequence[tuple | None], root: bool, blocks: Iterator[dict]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows, sums and sums of squares by asked node and bin; at the root also the rows and errors of the folds left out."""
    every = range(len(layout.columns))
    sizes, bins = [layout.codes(c) for c in every], [layout.bins(c) for c in every]
    tables = [a and _tables(layout, bins, a[1]) for a in asked]
    nodes = [a[2] if a else 0 for a in asked]
    added = [[np.zeros((3, n * sizes[c])) for c in every] if n else [] for n in nodes]
    errors = np.zeros((2, len(boosts)))
    for block in blocks:
        codes, label = block["codes"], block["label"]
        whole: dict[tuple, tuple] = {}
        for i, (a, b) in enumerate(zip(asked, boosts, strict=True)):
            if root and b.fold is not None:
                held = block["fold"] == b.fold
                errors[:, i] += held.sum(), np.abs(label[held] - block["predicted"][i][held]).sum()
            if not nodes[i]:
                continue
            drawn = block["drawn"][b.fold, b.rate]
            if root:  # the same rows for all boosts of this fold and rate
                if (b.fold, b.rate) not in whole:
                    at = np.flatnonzero(drawn)
                    keys = [codes[b.fold][c][at].astype(np.intp) for c in every]
                    whole[b.fold, b.rate] = at, keys, [np.bincount(k, minlength=sizes[c]) for c, k in enumerate(keys)]
                at, keys, counts = whole[b.fold, b.rate]
            else:
                node = _by_leaf(tables[i], codes[b.fold], a[0], np.int8)
                at = np.flatnonzero((node >= 0) & drawn)
                node = node[at].astype(np.intp)
            aim = label[at] if first else 2.0 * (label[at] - block["predicted"][i][at])
            squares = aim * aim
            for c in every:
                key = keys[c] if root else node * sizes[c] + codes[b.fold][c][at]
                n, into = nodes[i] * sizes[c], added[i][c]
                into[0] += counts[c] if root else np.bincount(key, minlength=n)
                into[1] += np.bincount(key, aim, n)
                into[2] += np.bincount(key, squares, n)
    parts = [
        np.concatenate([layout.by_bin(c, x.reshape(3, n, -1)) for c, x in enumerate(xs)], axis=2)
        for n, xs in zip(nodes, added, strict=True)
        if n
    ]
    yield np.concatenate(parts, axis=1) if parts else np.zeros((3, 0, sum(layout.widths))), errors


def _added(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


# On the driver


def split_candidates(rows: DataFrame, learner: GBTRegressor) -> list[np.ndarray]:
    """The thresholds of each feature among which Spark's learner chooses on these rows."""
    jvm = rows.sparkSession._jvm
    ml = jvm.org.apache.spark.ml
    utils, metadata, forest = (
        getattr(getattr(of, f"{name}$"), "MODULE$")
        for of, name in ((ml.util, "DatasetUtils"), (ml.tree.impl, "DecisionTreeMetadata"), (ml.tree.impl, "RandomForest"))
    )
    learner._transfer_params_to_java()
    java = learner._java_obj
    instances = utils.extractInstances(java, rows._jdf, getattr(utils, "extractInstances$default$3")())
    kind = jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression()
    strategy = java.getOldBoostingStrategy(jvm.PythonUtils.toScalaMap({}), kind).treeStrategy()
    about = metadata.buildMetadata(instances, strategy, 1, "all")
    found = forest.findSplits(instances, about, learner.getSeed())
    return [np.array([s.threshold() for s in splits]) for splits in found]


def columns_of(widths: Sequence[int], most: int) -> tuple[tuple[int, ...], ...]:
    """Features put together, the widest first, while a column has at most so many codes."""
    columns: list[list[int]] = []
    for f in sorted(range(len(widths)), key=lambda f: -widths[f]):
        for features in columns:
            if np.prod([widths[x] for x in features]) * widths[f] <= most:
                features.append(f)
                break
        else:
            columns.append([f])
    return tuple(tuple(sorted(features)) for features in columns)


def _spread(stats: np.ndarray) -> np.ndarray:
    """Variance from rows, sum and sum of squares."""
    n, total, squares = stats
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (squares - total * total / n) / n)


def best_splits(layout: Layout, sums: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gain, feature and bin of the best split of each node, and the statistics of both sides.

    ``sums`` is by statistic, node and bin, ``stats`` by statistic and node. Equal gains: the first feature and bin.
    """
    every, impurity = np.arange(sums.shape[1]), _spread(stats)
    gain, feature, at = np.zeros(len(every)), np.full(len(every), -1), np.zeros(len(every), dtype=int)
    left, right = np.zeros((3, len(every))), np.zeros((3, len(every)))
    places = layout.places()
    for f in range(len(layout.widths)):
        if layout.widths[f] < 2:
            continue
        low = np.cumsum(sums[:, :, places[f]], axis=2)
        high = low[:, :, -1:] - low
        whole = low[0] + high[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = impurity[:, None] - low[0] / whole * _spread(low) - high[0] / whole * _spread(high)
        gains = np.where((low[0] < 1) | (high[0] < 1), -np.inf, gains)
        best = gains.argmax(axis=1)
        better = np.flatnonzero(gains[every, best] > gain)
        gain[better], feature[better], at[better] = gains[better, best[better]], f, best[better]
        left[:, better], right[:, better] = low[:, better, best[better]], high[:, better, best[better]]
    return gain, feature, at, left, right


def _root_stats(layout: Layout, sums: np.ndarray, fold: int | None) -> np.ndarray:
    """Both sides of the first split there is, added up."""
    with_splits = [f for f, t in enumerate(layout.thresholds[fold]) if len(t)]
    bins = sums[:, layout.places()[with_splits[0] if with_splits else 0]]
    low = np.cumsum(bins, axis=1)
    return low[:, 0] + (low[:, -1] - low[:, 0])


class Held:
    """Blocks that one task holds, by their partition."""

    def __init__(self, parts: dict[int, list[dict]]):
        self.parts = parts

    def advance(self, step: Callable[[int, Iterator[dict]], Iterator[dict]]) -> None:
        for part, blocks in self.parts.items():
            blocks[:] = step(part, iter(list(blocks)))

    def total(self, add: Callable[[Iterator[dict]], Iterator[tuple]]) -> tuple:
        return next(add(b for blocks in self.parts.values() for b in blocks))


class Spread:
    """Blocks that stay in their partitions. Every ``checkpoints`` steps they are written, which cuts their lineage."""

    def __init__(self, spark: SparkSession, blocks: RDD, checkpoints: int):
        self.spark, self.checkpoints = spark, checkpoints
        self.kept, self.written, self.steps = [blocks], [], 0

    def advance(self, step: Callable[[int, Iterator[dict]], Iterator[dict]]) -> None:
        state = self.kept[-1].mapPartitionsWithIndex(step, preservesPartitioning=True)
        self.kept.append(state.persist(StorageLevel.MEMORY_AND_DISK_DESER))
        self.steps += 1
        if self.steps % self.checkpoints == 0:
            state.checkpoint()

    def total(self, add: Callable[[Iterator[dict]], Iterator[tuple]]) -> tuple:
        state = self.kept[-1]
        parts = state.mapPartitions(add)
        out = parts.treeReduce(_added) if parts.getNumPartitions() > DIRECT else reduce(_added, parts.collect())
        path = state.getCheckpointFile()
        if path and path not in self.written:
            self.written.append(path)
            self._remove(self.written, remove_folder_of(self.spark))
        self._remove(self.kept, RDD.unpersist)
        return out

    def _remove(self, things: list, remove: Callable[[Any], Any], left: int = 1) -> None:
        for old in things[: len(things) - left]:
            remove(old)
            things.remove(old)

    def close(self) -> None:
        self._remove(self.kept, RDD.unpersist, 0)
        self._remove(self.written, remove_folder_of(self.spark), 0)


def remove_folder_of(spark: SparkSession) -> Callable[[str], None]:
    return lambda path: remove_folder(spark, path)


def _level(
    layout: Layout, state: Held | Spread, boosts: Sequence[Boost], trees: list[Tree | None], known: list[dict], m: int, level: int
) -> np.ndarray | None:
    """Grow all trees by a level. ``known``: the sums of each tree's nodes of the level above, replaced by this one's."""
    asked: list[tuple | None] = []
    wanted: list[list[int]] = []
    for t, above in zip(trees, known, strict=True):
        nodes = t.open if t else []
        if t and level and not layout.in_order:  # of two open sides the one with fewer rows; the other is what is left
            nodes = [n for n in nodes if n ^ 1 not in nodes or (t.stats[n][0], n) < (t.stats[n ^ 1][0], n ^ 1)]
        wanted.append(nodes)
        if not nodes:
            asked.append(None)
            continue
        leaves, cuts = t.outline()
        slot = {n: i for i, n in enumerate(nodes)}
        asked.append(([slot.get(n, -1) for n in leaves], cuts, len(nodes)))
    if not any(wanted) and level:
        return None
    sums, errors = state.total(lambda blocks: _sums(layout, boosts, m == 0, asked, level == 0, blocks))
    at, chosen = 0, []
    for i, (t, nodes) in enumerate(zip(trees, wanted, strict=True)):
        found = {n: sums[:, at + k] for k, n in enumerate(nodes)}
        at += len(nodes)
        if t:
            for n in t.open:
                if n not in found:
                    found[n] = known[i][n >> 1] - found[n ^ 1]
            if not level:
                t.stats[1] = tuple(_root_stats(layout, found[1], boosts[i].fold).tolist())
            chosen += [(t, boosts[i], n, found[n]) for n in t.open]
            t.open = []
        known[i] = found
    if not chosen:
        return errors
    stats = np.array([t.stats[n] for t, _, n, _ in chosen]).T
    best = best_splits(layout, np.stack([s for *_, s in chosen], axis=1), stats)
    gain, feature, bins, left, right = (x.tolist() for x in best)
    closed = np.abs(_spread(best[3])) < EPSILON, np.abs(_spread(best[4])) < EPSILON
    for k, (t, b, n, _) in enumerate(chosen):
        if gain[k] > 0:
            t.splits[n], t.gains[n] = (feature[k], bins[k]), gain[k]
            for side, of in enumerate((left, right)):
                t.stats[2 * n + side] = of[0][k], of[1][k], of[2][k]
                if level + 1 < b.depth and not closed[side][k]:
                    t.open.append(2 * n + side)
    return errors


def _grown(layout: Layout, state: Held | Spread, boosts: Sequence[Boost], seed: int) -> list[tuple[list[float], list[Tree]]]:
    """Of each boost, the mean absolute error on its fold after each tree; the trees of those without a fold."""
    out: list[tuple[list[float], list[Tree]]] = [([], []) for _ in boosts]
    last: list[tuple | None] | None = None
    for m in range(max(b.trees for b in boosts) + 1):
        trees = [Tree() if m < b.trees else None for b in boosts]
        known: list[dict] = [{} for _ in boosts]
        state.advance(partial(_advanced, layout, boosts, seed + m, last))
        rows, errors = _level(layout, state, boosts, trees, known, m, 0)
        for i, b in enumerate(boosts):
            if b.fold is not None and 0 < m <= b.trees:
                out[i][0].append(float(errors[i] / rows[i]))
        for level in range(1, max(b.depth for b in boosts)):
            if _level(layout, state, boosts, trees, known, m, level) is None:
                break
        last = []
        for i, (t, b) in enumerate(zip(trees, boosts, strict=True)):
            if t is None:
                last.append(None)
                continue
            if b.fold is None:
                out[i][1].append(t)
            leaves, cuts = t.outline()
            last.append(([t.value(n) * (b.step if m else 1.0) for n in leaves], cuts))
    return out


def _dealt(layout: Layout, groups: Sequence[Sequence[Boost]], part: int, rows: Iterator[Any]) -> Iterator[tuple]:
    """Each block for each group."""
    for number, block in enumerate(_binned(layout, rows)):
        for g, group in enumerate(groups):
            folds = {b.fold for b in group}
            yield g, (part, number, block | {name: {k: block[name][k] for k in folds} for name in ("codes", "before")})


def _grown_alone(layout: Layout, groups: Sequence[Sequence[Boost]], seed: int, dealt: Iterator[tuple]) -> Iterator[tuple]:
    mine: dict[int, list[tuple]] = {}
    for g, block in dealt:
        mine.setdefault(g, []).append(block)
    for g, blocks in mine.items():
        parts: dict[int, list[dict]] = {}
        for part, _, block in sorted(blocks, key=lambda b: b[:2]):
            parts.setdefault(part, []).append(_started(block, groups[g]))
        blocks.clear()
        yield g, _grown(layout, Held(parts), groups[g], seed)


def grow(
    rows: DataFrame, layout: Layout, groups: Sequence[Sequence[Boost]], seed: int, checkpoints: int
) -> dict[Boost, tuple[list[float], list[Tree]]]:
    """Grow groups of boosts at the same time; of each boost what ``_grown`` tells."""
    spark, packed = rows.sparkSession, blocks_of(rows)
    if layout.rows <= HELD:
        dealt = packed.rdd.mapPartitionsWithIndex(partial(_dealt, layout, groups)).partitionBy(len(groups), int)
        done = dict(dealt.mapPartitions(partial(_grown_alone, layout, groups, seed)).collect())
    else:

        def together(group: Sequence[Boost]) -> list:
            binned = packed.rdd.mapPartitions(lambda blocks: (_started(b, group) for b in _binned(layout, blocks)))
            state = Spread(spark, binned, checkpoints)
            try:
                return _grown(layout, state, group, seed)
            finally:
                state.close()

        with ThreadPoolExecutor(len(groups)) as pool:
            done = dict(enumerate(pool.map(inheritable_thread_target(spark)(together), groups)))
    return {b: found for g, group in enumerate(groups) for b, found in zip(group, done[g], strict=True)}


def layout_of(rows: DataFrame, learner: GBTRegressor, folds: Sequence[int | None]) -> Layout:
    """Split candidates of the rows without each fold."""
    thresholds = {k: split_candidates(rows if k is None else rows.where(F.col("fold") != k), learner) for k in folds}
    widths = tuple(max(len(t) for t in ts) + 1 for ts in zip(*thresholds.values(), strict=True))
    sizes = dict(rows.groupBy("fold").count().collect())
    if empty := [k for k in folds if k is not None and k not in sizes]:
        raise ValueError(f"no rows in the folds {empty}")
    n = sum(sizes.values())
    in_order = rows.rdd.getNumPartitions() == 1 and n <= BLOCK
    return Layout(thresholds, widths, columns_of(widths, 1 if in_order else CODES), in_order, n)


def blocks_of(rows: DataFrame) -> DataFrame:
    """``features``, ``label`` and ``fold`` as bytes, some ten thousand rows in a row."""
    lists = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double"), F.col("fold").cast("int"))
    return lists.mapInArrow(_packed, "n long, x binary, label binary, fold binary")


def model_of(spark: SparkSession, learner: GBTRegressor, layout: Layout, fold: int | None, trees: Sequence[Tree], step: float) -> GBTRegressionModel:
    """The trees as the model that Spark's learner returns."""
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    ml = jvm.org.apache.spark.ml
    # Every call is a message to the JVM: classes are looked up once, and all statistics go there in one piece.
    leaf, inner, split = ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.ContinuousSplit
    calculator, part = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, jvm.java.util.Arrays.copyOfRange
    numbers = np.array([t.stats[n] for t in trees for n in sorted(t.stats)])
    spread = _spread(numbers.T).tolist()
    stats = gateway.new_array(jvm.double, numbers.size)
    jvm.java.nio.ByteBuffer.wrap(numbers.astype(">f8").tobytes()).asDoubleBuffer().get(stats)

    def node(t: Tree, n: int, at: dict[int, int]) -> Any:
        i = at[n]
        of = calculator(part(stats, 3 * i, 3 * i + 3), int(t.stats[n][0]))
        if n not in t.splits:
            return leaf(t.value(n), spread[i], of)
        f, cut = t.splits[n]
        below = node(t, 2 * n, at), node(t, 2 * n + 1, at)
        return inner(t.value(n), spread[i], t.gains[n], *below, split(f, float(layout.thresholds[fold][f][cut])), of)

    features, first = len(layout.widths), 0
    fitted = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(jvm.double, len(trees))
    for i, t in enumerate(trees):
        at = {n: first + j for j, n in enumerate(sorted(t.stats))}
        fitted[i] = ml.regression.DecisionTreeRegressionModel(node(t, 1, at), features)
        weights[i], first = step if i else 1.0, first + len(at)
    java = ml.regression.GBTRegressionModel(learner.uid, fitted, weights, features)
    learner._transfer_params_to_java()
    java = learner._java_obj.copyValues(java, learner._java_obj.extractParamMap())
    return learner._copyValues(GBTRegressionModel(java))

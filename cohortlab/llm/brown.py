"""Scoring texts with a Brown class n-gram model.

The probability of a word after another one is that of its class after the class of the other, times that of the
word in its class. Classes come from exchange clustering: the most frequent words are moved one at a time to the class
that raises the likelihood most; every other word then gets its best class, given what stands beside it in all training
texts; and in further rounds all words, the most frequent ones included, are exchanged at once, each against the classes
that the round before gave to its neighbours, until few of them move or the likelihood no longer rises.

Texts are cut into chunks, each with its own numbering of words, so that counts, classes and scores are exchanged
once per word of a chunk and never once per token. The words of a chunk are dealt by hash into parts, one message to
a part, and its answer comes back in the order of the words. Everything counted from the corpus is counted over all of
it; the driver sees only the bounded statistics of the first step and of the classes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.shingles import binary, word_hashes, word_list
from cohortlab.llm.tables import field, in_arrow, keep, ship
from cohortlab.session import staged

# Classes; words that are exchanged one at a time; tokens in a chunk, but for a longer last text.
CLASSES = 64
SEEDS = 2048
CHUNK_TOKENS = 4_000_000
PASSES = 3
# Rounds over the whole vocabulary at most; share of the words that may still move after the last one.
ROUNDS = 4
SETTLED = 0.01
# Chunks whose words make a part, at most; words that are compared with all classes at once.
CHUNKS_PER_PART = 8
BLOCK = 4096
FOLDS, HELD_OUT = 5, 1
# Weight of the class frequencies in the transition probabilities, and of the uniform guess in the exchange.
PRIOR, EPS = 5.0, 0.1
ONCE = 0x80


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _chunker(limit: int) -> Callable:
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        total = 0
        squeeze = zstandard.ZstdCompressor(level=3)

        def row() -> pa.RecordBatch:
            flat = np.concatenate(tokens).astype(np.int32)
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            held = np.fromiter(map(is_held_out, ids), np.bool_, len(ids))
            counts = np.bincount(flat[np.repeat(~held, sizes)], minlength=len(numbers)).astype(np.int64)
            values = [
                pa.array([(part << 32) + serial]), pa.array([ids], pa.list_(pa.int64())),
                pa.array([sizes.tobytes()], pa.binary()), pa.array([held.tobytes()], pa.binary()),
                pa.array([squeeze.compress(flat.tobytes())], pa.binary()),
                pa.array([word_hashes(list(numbers)).astype(np.int64)], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())), pa.array([int((~held).sum())]),
            ]
            return pa.RecordBatch.from_arrays(values, names=_names(_CHUNK))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binary(batch.column("text")), strict=True):
                words = word_list(text)
                tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                total += len(words)
                if total >= limit:
                    yield row()
                    serial, total = serial + 1, 0
                    numbers.clear()
                    ids.clear()
                    tokens.clear()
        if ids:
            yield row()

    return chunk


_CHUNK = ("chunk long, doc_ids array<long>, sizes binary, held binary, tokens binary, vocabulary array<long>, "
          "counts array<long>, n_train long")


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, sizes of the texts, and which texts are held out."""
    tokens = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), np.int32)
    return tokens, np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["held"], np.bool_)


def _training(row: dict, symbols: np.ndarray, end: int) -> np.ndarray:
    """The training texts of a chunk as one sequence of symbols, with an end before and after each text."""
    tokens, sizes, held = _unpack(row)
    own = symbols[tokens[np.repeat(~held, sizes)]]
    return np.concatenate(([end], np.insert(own, np.cumsum(sizes[~held]), end)))


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[dict]:
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i].as_py() for c in columns if c != "vocabulary"}
        if "vocabulary" in columns:
            row["vocabulary"] = batch.column("vocabulary")[i].values.to_numpy(zero_copy_only=False)
        yield row


def _matched(vocabulary: np.ndarray, known: np.ndarray, values: np.ndarray, default: int) -> np.ndarray:
    """The value of each word of a chunk, by hash in the sorted ``known``."""
    at = np.minimum(np.searchsorted(known, vocabulary), len(known) - 1)
    return np.where(known[at] == vocabulary, values[at], default)


def _pair_counter(seeds: np.ndarray) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of neighbours among the seeds, all other words (one symbol) and the end."""
        size = len(seeds) + 2
        sums = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for row in _rows(batch, "sizes", "held", "tokens", "vocabulary"):
                symbols = _matched(row["vocabulary"], seeds, np.arange(len(seeds)), len(seeds))
                text = _training(row, symbols, len(seeds) + 1)
                sums += np.bincount(text[:-1] * size + text[1:], minlength=size * size)
        codes = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums[codes])], names=["code", "n"])

    return count


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """Classes of the words of a pair count matrix, most frequent words first; its last two symbols (other words,
    end) stay classes of their own. Returns one class per word.

    A word starts among the other words; then it goes to the class that raises the class bigram likelihood most.
    """
    m = len(pairs) - 2
    other, end = classes, classes + 1
    cls = np.full(m + 2, other)
    cls[m + 1] = end
    member = np.zeros((m + 2, classes + 2))
    member[np.arange(m + 2), cls] = 1
    after, before = pairs @ member, pairs.T @ member
    table = member.T @ after
    totals = table.sum(axis=1)
    k = np.arange(classes)
    logged = _xlogx(table)

    def refresh(x: int) -> None:
        logged[x], logged[:, x] = _xlogx(table[x]), _xlogx(table[:, x])

    for turn in range(passes + 1):
        moved = 0
        for w in range(m):
            a, own = cls[w], pairs[w, w]
            succ, pred = after[w].copy(), before[w].copy()
            table[a] -= succ
            table[:, a] -= pred
            table[a, a] += own
            refresh(a)
            n = succ.sum()
            totals[a] -= n
            succ[a] -= own
            pred[a] -= own
            if turn == 0 and w < classes:
                b = w
            else:
                gain = (_xlogx(table[:classes] + succ) - logged[:classes]).sum(axis=1)
                gain += (_xlogx(table[:, :classes].T + pred) - logged[:, :classes].T).sum(axis=1)
                corner = table[k, k]
                gain += _xlogx(corner + succ[k] + pred[k] + own) + _xlogx(corner)
                gain -= _xlogx(corner + succ[k]) + _xlogx(corner + pred[k])
                gain -= 2 * (_xlogx(totals[k] + n) - _xlogx(totals[k]))
                b = int(gain.argmax())
            if b != a:
                moved += 1
                after[:, a] -= pairs[:, w]
                after[:, b] += pairs[:, w]
                before[:, a] -= pairs[w]
                before[:, b] += pairs[w]
                cls[w] = b
            table[b] += succ
            table[:, b] += pred
            table[b, b] += own
            refresh(b)
            totals[b] += n
        if not moved:
            break
    return cls[:m]


def class_table(pairs: np.ndarray, cls: np.ndarray, classes: int) -> np.ndarray:
    """Counts of class after class, of a pair count matrix whose last two symbols are other words and the end."""
    full = np.concatenate((cls, [classes, classes + 1]))
    member = np.zeros((len(full), classes + 2))
    member[np.arange(len(full)), full] = 1
    return member.T @ pairs @ member


def likelihood(table: np.ndarray) -> float:
    """Logarithm of the class bigram likelihood, but for what the words themselves add whatever their classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def class_scores(beside: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How well each class suits words, from the counts of classes after and before them (a row for each word).

    It is the change of the likelihood when a few occurrences join a class. From the class that a word has (``own``,
    the number of classes for none) its own occurrences are taken out first.
    """
    size = len(table)
    classes = size - 2
    guess = EPS * table.sum(axis=0) / max(table.sum(), 1)
    around = np.concatenate((table[:classes], table[:, :classes].T), axis=1)
    total = table.sum(axis=1)[:classes]
    guesses = np.concatenate((guess, guess))
    out = beside @ np.log((around + guesses) / (total[:, None] + EPS) + 1e-12).T
    has = np.flatnonzero(own < classes)
    a, b = own[has], beside[has]
    left = np.maximum(total[a] - b[:, :size].sum(axis=1), 0)
    out[has, a] = (b * np.log((np.maximum(around[a] - b, 0) + guesses) / (left[:, None] + EPS) + 1e-12)).sum(axis=1)
    return out


def _dealt(vocabulary: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of a chunk by part, and where each part begins."""
    part = (vocabulary.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.searchsorted(np.sort(part), np.arange(parts + 1))


_MESSAGE = ("part int, chunk long, words binary, own binary, entries binary, codes binary, counts binary, "
            "table array<long>")
_ANSWER = ("part int, chunk long, classes binary, counts binary, sizes array<long>, types array<long>, moved long")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _messages(row: dict, beside: np.ndarray, own: np.ndarray, classes: int, parts: int) -> pa.Table:
    """To each part: its words of a chunk, their present classes, and the classes (``beside``) of their neighbours in
    training texts. A row of part -1 has the counts of class after class."""
    words, size = row["vocabulary"], classes + 2
    codes = 2 * size
    class_of = np.append(beside, classes + 1)
    text = _training(row, np.arange(len(words)), len(words))
    order, starts = _dealt(words, parts)
    place = np.empty(len(words) + 1, dtype=np.int64)
    place[order], place[-1] = np.arange(len(words)), len(words)
    at = np.flatnonzero(text < len(words))
    keys = np.concatenate((place[text[at]] * codes + class_of[text[at + 1]],
                           place[text[at]] * codes + size + class_of[text[at - 1]]))
    keys, n = np.unique(keys, return_counts=True)
    word, code = np.divmod(keys, codes)
    entries = np.bincount(word, minlength=len(words)).astype("<u4")
    first = np.searchsorted(word, starts)
    now = class_of[text]
    table = np.bincount(now[:-1] * size + now[1:], minlength=size * size)
    columns = (words[order].astype("<i8"), own[order].astype("u1"), entries)
    rows = [(-1, row["chunk"], *[None] * 5, table.tolist())]
    for p in np.flatnonzero(np.diff(starts)):
        a, b, c, d = starts[p], starts[p + 1], first[p], first[p + 1]
        rows.append((int(p), row["chunk"], *(x[a:b].tobytes() for x in columns), code[c:d].astype("u1").tobytes(),
                     n[c:d].astype("<u4").tobytes(), None))
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64())]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_names(_MESSAGE))


def _first_messages(seeds: np.ndarray, cls: np.ndarray, classes: int, parts: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Messages when only the seeds have classes."""
        for batch in batches:
            for row in _rows(batch, "chunk", "sizes", "held", "tokens", "vocabulary"):
                known = _matched(row["vocabulary"], seeds, cls, classes)
                yield from _messages(row, known, known, classes, parts).to_batches()

    return send


def _answered(row: dict, answers: pa.Table, classes: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and class of each word of a chunk."""
    order, starts = _dealt(row["vocabulary"], parts)
    c, cls = np.zeros(len(order), dtype=np.int64), np.full(len(order), classes)
    expand = zstandard.ZstdDecompressor()
    for p, ks, ns in zip(*(answers.column(x).to_pylist() for x in ("part", "classes", "counts")), strict=True):
        at = order[starts[p]:starts[p + 1]]
        cls[at] = np.frombuffer(ks, np.uint8)
        c[at] = np.frombuffer(expand.decompress(ns), np.int64)
    return c, cls


def _next_messages(classes: int, parts: int) -> Callable:
    def send(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        """Messages when every word of the training texts has a class."""
        row = next(_rows(chunk.combine_chunks().to_batches()[0], "chunk", "sizes", "held", "tokens", "vocabulary"))
        _, cls = _answered(row, answers, classes, parts)
        return _messages(row, cls, cls, classes, parts)

    return send


def _assigner(table: np.ndarray, fixed: bool) -> Callable:
    """Best class of each word of a part. ``fixed``: words that have a class keep it."""
    size = len(table)
    classes, codes = size - 2, 2 * size

    def joined(messages: pa.Table, column: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(messages.column(column).to_pylist()), kind)

    def assign(messages: pa.Table) -> pa.Table:
        words, at = np.unique(joined(messages, "words", "<i8"), return_inverse=True)
        own = np.empty(len(words), dtype=np.int64)
        own[at] = joined(messages, "own", "u1")
        key = np.repeat(at, joined(messages, "entries", "<u4")) * codes + joined(messages, "codes", "u1")
        order = np.argsort(key, kind="stable")
        key, n = key[order], joined(messages, "counts", "<u4")[order]
        c, cls = np.zeros(len(words), dtype=np.int64), own.copy()
        for first in range(0, len(words), BLOCK):
            b = min(BLOCK, len(words) - first)
            i, j = np.searchsorted(key, (first * codes, (first + b) * codes))
            beside = np.bincount(key[i:j] - first * codes, weights=n[i:j], minlength=b * codes).reshape(b, codes)
            c[first:first + b] = beside[:, :size].sum(axis=1)
            score = class_scores(beside, own[first:first + b], table)
            best = score.argmax(axis=1)
            held = np.minimum(own[first:first + b], classes - 1)
            rows = np.arange(b)
            stays = (own[first:first + b] < classes) & (fixed | (score[rows, held] >= score[rows, best] - 1e-9))
            cls[first:first + b] = np.where(stays, held, best)
        cls[c == 0] = classes
        squeeze = zstandard.ZstdCompressor(level=1)
        ends = np.cumsum([len(x) // 8 for x in messages.column("words").to_pylist()])
        # A row of chunk -1 has the sums of the part.
        sizes = np.bincount(cls, weights=c, minlength=classes + 1)[:classes].astype(np.int64)
        types = np.bincount(cls, minlength=classes + 1)[:classes]
        part = messages.column("part")[0].as_py()
        out = [(part, -1, None, None, sizes.tolist(), types.tolist(), int((cls != own).sum()))]
        for chunk, i in zip(messages.column("chunk").to_pylist(), np.split(at, ends[:-1]), strict=True):
            out.append((part, chunk, cls[i].astype("u1").tobytes(), squeeze.compress(c[i].tobytes()), None, None, None))
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 2, pa.int64()]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_names(_ANSWER))

    return assign


def _summed(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """The arrays of a column added up."""
    out = np.zeros(size)
    for r in rows.select(F.posexplode(column).alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out


_DOC = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, path binary"


def _encoder(n: int, v: int, discount: float, class_sizes: np.ndarray, has_end: int, parts: int) -> Callable:
    classes = len(class_sizes)

    def encode(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        """Base score, emission score and sequence of classes of each text of a chunk."""
        out = []
        for row in _rows(chunk.combine_chunks().to_batches()[0], "doc_ids", "sizes", "held", "tokens", "vocabulary"):
            tokens, sizes, held = _unpack(row)
            c, cls = _answered(row, answers, classes, parts)
            c, cls = np.append(c, has_end), np.append(cls, classes + 1)
            scale = n + 0.5 * (v + 1)
            base = np.log10((c + 0.5) / scale)
            sizes_of = np.append(class_sizes, [1, 1])[cls]
            emission = np.where((cls < classes) & (c > 0), np.log10(np.maximum(c - discount, 1e-9) / sizes_of), 0.0)
            marked = (cls | np.where(c == 1, ONCE, 0)).astype(np.uint8)
            marked[-1] = classes + 1
            text = np.insert(tokens, np.cumsum(sizes), len(c) - 1)
            lengths = sizes + 1
            first = np.cumsum(lengths) - lengths
            offsets = np.append(first, len(text)).astype(np.int64)
            path = marked[text]
            out.append(pa.table({
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(held),
                "n_tokens": pa.array(lengths),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64)[text], first)),
                "base_score": pa.array(np.add.reduceat(base[text], first)),
                "emission": pa.array(np.add.reduceat(emission[text], first)),
                "path": pa.Array.from_buffers(
                    pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(path.tobytes())]
                ).cast(pa.binary()),
            }))
        return pa.concat_tables(out)

    return encode


def _path(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Marked classes of the texts of a batch one after the other, and where each begins."""
    texts = column.to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes


def _transition_counter(classes: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Class after class; a word seen once also stands for one never seen, as what another word follows."""
        size = classes + 2
        sums = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                marked, _ = _path(batch.column("path"))
                now = (marked & (ONCE - 1)).astype(np.int64)
                last = np.append(classes + 1, now[:-1])
                sums += np.bincount(last * size + now, minlength=size * size)
                once = np.append(False, marked[:-1] >= ONCE)
                sums += np.bincount(classes * size + now[once], minlength=size * size)
        codes = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums[codes])], names=["code", "n"])

    return count


def transitions(counts: np.ndarray, unseen: np.ndarray, floor: float) -> np.ndarray:
    """Log10 probabilities of class after class. The last two symbols are an unseen word and the end; ``unseen`` is
    the share of each class that is kept for unseen words."""
    size = len(counts)
    real = np.delete(np.arange(size), size - 2)
    share = counts[real][:, real].sum(axis=0)
    share = share / max(share.sum(), 1)
    p = np.zeros((size, size))
    own = counts[:, real]
    p[:, real] = (own + PRIOR * share) / (own.sum(axis=1, keepdims=True) + PRIOR)
    p[:, size - 2] = np.maximum(p[:, : size - 2] @ unseen, floor)
    return np.log10(np.maximum(p, 1e-300))


def _scorer(logs: np.ndarray) -> Callable:
    size = len(logs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
        for batch in batches:
            if batch.num_rows:
                marked, first = _path(batch.column("path"))
                now = (marked & (ONCE - 1)).astype(np.int64)
                last = np.append(size - 1, now[:-1])
                total = np.add.reduceat(logs[last, now], first) + batch.column("emission").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(total)], names=[*names, "score"]
                )

    return score


def _classes(chunks: DataFrame, top: list, classes: int, parts: int, rounds: int, settled: float) -> DataFrame:
    """Counts and classes of the words of every part, as answers to the chunks."""
    known = np.array([r["hash"] for r in top], dtype=np.int64)
    by_hash = np.argsort(known)
    spans = chunks.select("chunk", "sizes", "held", "tokens", "vocabulary")
    counted = in_arrow(spans, _pair_counter(known[by_hash]), "code long, n long")
    counted = counted.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    size = len(top) + 2
    pairs = np.zeros(size * size)
    pairs[counted.column("code").to_numpy()] = counted.column("n").to_numpy()
    pairs = pairs.reshape(size, size)
    order = np.append(np.argsort(by_hash), [size - 2, size - 1])
    pairs = pairs[np.ix_(order, order)]
    cls = exchange(pairs, classes)

    def answers(messages: DataFrame, table: np.ndarray, fixed: bool) -> DataFrame:
        own = messages.where("part >= 0").drop("table")
        return keep(own.groupBy("part").applyInArrow(_assigner(table, fixed), _ANSWER), "classes")

    first = in_arrow(spans, _first_messages(known[by_hash], cls[by_hash], classes, parts), _MESSAGE)
    now = answers(first, class_table(pairs, cls, classes), True)
    before, last = now, -np.inf
    for _ in range(rounds):
        asked = spans.groupBy("chunk").cogroup(now.where("chunk >= 0").groupBy("chunk"))
        with staged(asked.applyInArrow(_next_messages(classes, parts), _MESSAGE), "messages") as messages:
            table = _summed(messages.where("part = -1"), "table", (classes + 2) ** 2).reshape(classes + 2, -1)
            reached = likelihood(table)
            if reached <= last:
                return before
            before, last = now, reached
            now = answers(messages, table, False)
        sums = now.where("chunk = -1").agg(F.sum("moved"), F.sum(F.aggregate("types", F.lit(0).cast("long"), lambda t, x: t + x)))
        moved, words = sums.first()
        if moved < settled * words:
            break
    return now


def score_texts(
    docs: DataFrame, classes: int = CLASSES, seeds: int = SEEDS, chunk_tokens: int = CHUNK_TOKENS,
    rounds: int = ROUNDS, settled: float = SETTLED,
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of
    ``docs(doc_id, text)``; the model is learned from the rows that are not held out.

    Tokens are the words, A-Z lower-cased, and one end for each text. ``base_score`` is that of the smoothed
    unigram model, ``score`` that of the class model, both log10 over a vocabulary of the training tokens and one
    unseen token. Unseen words get what absolute discounting takes from the words of each class; after them the
    class frequencies follow that were counted after words seen once.

    Null or empty text: the end only. Null id: a training text, scored like others. Repeated rows count and are
    scored each time. Very long texts are read whole. Equal counts are ordered by the hash of the word. Without
    training texts every token is the unseen one, and scores are 0. An empty table gives no rows. Words are told
    apart by 64-bit hashes. Other columns are not used.

    All words are exchanged in up to ``rounds`` rounds, until fewer than the share ``settled`` of them move in one; the
    result of a round that lowers the likelihood of the training texts is not used.
    """
    if not 2 <= classes <= ONCE - 2:
        raise ValueError(f"classes must be between 2 and {ONCE - 2}")
    texts = docs.select(field("doc_id").cast("long").alias("doc_id"), field("text").cast("string").alias("text"))
    chunks = keep(in_arrow(texts, _chunker(chunk_tokens), _CHUNK), "chunks")
    in_chunks = chunks.select(F.explode(F.arrays_zip("vocabulary", "counts")).alias("w"))
    vocabulary = in_chunks.where("w.counts > 0").groupBy(F.col("w.vocabulary").alias("hash")).agg(
        F.sum("w.counts").alias("c")
    )
    vocabulary = keep(vocabulary, "vocabulary")
    n_words, types, once, twice = (int(x or 0) for x in vocabulary.agg(
        F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    ).first())
    n_end = int(chunks.agg(F.sum("n_train")).first()[0] or 0)
    n, v = n_words + n_end, types + (n_end > 0)
    discount = (once + 1) / (once + 2 * twice + 2)

    conf = docs.sparkSession.conf
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), -(-chunks.count() // CHUNKS_PER_PART))
    top = vocabulary.orderBy(F.desc("c"), "hash").limit(seeds).collect()
    ship(docs.sparkSession)
    class_sizes, class_types = np.zeros(classes), np.zeros(classes)
    answers = docs.sparkSession.createDataFrame([], _ANSWER)
    if top:
        answers = _classes(chunks, top, classes, parts, rounds, settled)
        sums = answers.where("chunk = -1")
        class_sizes, class_types = _summed(sums, "sizes", classes), _summed(sums, "types", classes)
    encode = _encoder(n, v, discount, class_sizes, n_end, parts)
    whole = chunks.select("chunk", "doc_ids", "sizes", "held", "tokens", "vocabulary")
    answers = answers.where("chunk >= 0").select("part", "chunk", "classes", "counts")
    paths = keep(whole.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(encode, _DOC), "paths")

    counted = in_arrow(paths.where("not held_out").select("path"), _transition_counter(classes), "code long, n long")
    counts = np.zeros((classes + 2) ** 2)
    for r in counted.groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[r["code"]] = r["n"]
    if n:
        unseen = np.divide(discount * class_types, class_sizes, out=np.zeros(classes), where=class_sizes > 0)
        logs = transitions(counts.reshape(classes + 2, -1), unseen, 0.5 / (n + 0.5 * (v + 1)))
    else:
        logs = np.zeros((classes + 2, classes + 2))
    scored = in_arrow(
        paths, _scorer(logs),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )

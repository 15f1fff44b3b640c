"""Repeated passages, by hashing lines, sentences and runs of them.

A passage is a line that has enough words, or a run of lines that have enough words together: from each line on, and up
to each line, the shortest such run, and each whole paragraph between blank lines. So passages wrapped into short lines
are found wherever they start, and copies cut alike. The same is done with the sentences of the lines, so that passages
are also found between other sentences of a line; of these, only what lies together and has more words goes.
Passages are normalised (words, A-Z lower-cased, one blank between them) and their digests grouped over the whole
corpus. The occurrence that comes first, by document and place, stays; the others are cut out. What is left of a text
keeps the places of its parts in the original.

Runs of over 50 words of an earlier document of which nothing goes in this way, as they begin and end inside long
sentences, go word by word. They are found by windows of words, of which a choice is grouped that no such run escapes
(``windows``); where one is repeated, all runs of 51 words around it are looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from cohortlab.llm.bits import marks, with_marked
from cohortlab.llm.shingles import binary, word_hashes, word_list
from cohortlab.llm.tables import BLANK, field, in_arrow, keep, kept, packed, unpacked
from cohortlab.llm.windows import RUN, WINDOW, chosen, run_hashes, window_hashes
from cohortlab.session import passing_shuffles, remove_folder, scratch

# Words that a line, a sentence or a run of them must have to be looked for elsewhere, and words that repeated
# sentences that follow each other must have to go.
LEAST_WORDS, LEAST_TOGETHER = 20, 40
# What a passage is made of. Texts that are hashed at once.
LINES, SENTENCES, WINDOWS, RUNS = 0, 1, 2, 3
TEXTS = 500
# Parts of the passages, by digest, that are gone through one after another.
PARTS = 4
KEYS = "k1 long, k2 boolean, k3 long"
# ``place`` and ``end``: first and last sentence (of windows and runs: word); ``start`` and ``stop``: in words.
UNITS = f"{KEYS}, kind byte, place int, end int, start int, stop int, h1 long, h2 long"
SETTLED = f"{KEYS}, gone array<struct<place int, end int, start int, stop int>>, open array<struct<h1 long, h2 long>>"
_IS_BLANK, _IS_SPACE, _IS_END = (np.isin(np.arange(256), [*map(ord, x)]) for x in (BLANK, " \t", ".!?"))
_NEWLINE = ord("\n")
# More than the words or sentences of any text.
_FAR = 1 << 32


@dataclass
class Layout:
    """Where the words, sentences and lines of texts stand that are joined by line ends.

    ``begin``: each text, in bytes. ``words``, ``sentences``: from where to where. ``before``: words before each sentence.
    ``lines``: first sentence of each line. ``of_sentence``, ``of_line``, ``of_word``: the first one of each text. Where one
    ends, the next one starts, so all but ``words`` and ``sentences`` have one number more.
    """

    text: bytes
    begin: np.ndarray
    words: tuple[np.ndarray, np.ndarray]
    sentences: tuple[np.ndarray, np.ndarray]
    before: np.ndarray
    lines: np.ndarray
    of_sentence: np.ndarray
    of_line: np.ndarray
    of_word: np.ndarray


def _spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of a text that are inside start and stop; its last byte is outside."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate([[0], edges]) if inside[0] else edges
    return edges[::2], edges[1::2]


def laid_out(texts: list[bytes]) -> Layout:
    """A sentence ends where another one follows in its line; a line's blanks at its ends belong to its sentences."""
    text = b"\n".join(texts) + b"\n"
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    at = np.frombuffer(text, np.uint8)
    words = _spans(~_IS_BLANK[at])
    ends, starts = _spans(_IS_SPACE[at])
    cut = _IS_END[at[ends - 1]] & (at[starts] != _NEWLINE)
    line_ends = np.flatnonzero(at == _NEWLINE)
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    starts = np.sort(np.concatenate([line_starts, starts[cut]]))
    ends = np.sort(np.concatenate([line_ends, ends[cut]]))
    before = np.append(np.searchsorted(words[0], starts), len(words[0]))
    lines = np.append(np.searchsorted(starts, line_starts), len(starts))
    of_sentence = np.searchsorted(starts, begin)
    return Layout(
        text, begin, words, (starts, ends), before, lines, of_sentence, np.searchsorted(line_starts, begin), before[of_sentence]
    )


def passages(before: np.ndarray, of_text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the passages of texts, given by the words before each line and the first line of each
    text; neither of them is blank."""
    full = np.flatnonzero(np.diff(before))
    n = np.arange(len(full))
    ahead = np.append(before[full], before[-1])
    text = np.searchsorted(of_text, full, "right") - 1
    first, last = np.searchsorted(full, of_text[text]), np.searchsorted(full, of_text[text + 1]) - 1
    # Over the lines with words: the shortest run from each line on, and up to each line.
    to = np.maximum(np.searchsorted(ahead, ahead[:-1] + least) - 1, n)
    since = np.minimum(np.searchsorted(ahead, ahead[1:] - least, "right") - 1, n)
    # Paragraphs.
    heads = np.flatnonzero((n == first) | (np.diff(full, prepend=-2) > 1))
    tails = np.append(heads[1:], len(full))[: len(heads)] - 1
    enough = ahead[tails + 1] - ahead[heads] >= least
    a = np.concatenate([n[to <= last], since[since >= first], heads[enough]])
    b = np.concatenate([to[to <= last], n[since >= first], tails[enough]])
    found = np.unique(a * (len(full) + 1) + b)
    return full[found // (len(full) + 1)], full[found % (len(full) + 1)]


def _units(batch: pa.RecordBatch, rows: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    taken = pa.array(rows, pa.int64())
    types = (pa.int8(), *[pa.int32()] * 4, *[pa.int64()] * 2)
    *places, h1, h2 = columns
    made = zip((*places, h1.view(np.int64), h2.view(np.int64)), types, strict=True)
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c).take(taken) for c in ("k1", "k2", "k3")), *(pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in made)],
        names=["k1", "k2", "k3", "kind", "place", "end", "start", "stop", "h1", "h2"],
    )


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _hasher(least: int) -> Callable:
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind, place and digest of the passages of each text: of lines, of sentences (both counted in sentences), and
        chosen windows (in words)."""
        for batch in _slices(batches):
            at = laid_out([text or b"" for text in binary(batch.column("text"))])
            hashes = word_hashes(word_list(at.text))
            a, b = passages(at.before[at.lines], at.of_line, least)
            for kind, place, end in (
                (LINES, at.lines[a], at.lines[b + 1] - 1), (SENTENCES, *passages(at.before, at.of_sentence, least))
            ):
                rows = np.searchsorted(at.of_sentence, place, "right") - 1
                start, stop, zero = at.before[place], at.before[end + 1], at.of_sentence[rows]
                yield _units(
                    batch, rows, np.full(len(rows), kind), place - zero, end - zero, start - at.of_word[rows],
                    stop - at.of_word[rows], *run_hashes(hashes, start, stop, kind),
                )
            one, two = window_hashes(hashes)
            start = chosen(np.diff(at.of_word), one)
            rows = np.searchsorted(at.of_word, start, "right") - 1
            place, kinds = start - at.of_word[rows], np.full(len(rows), WINDOWS)
            yield _units(batch, rows, kinds, place, place + WINDOW - 1, place, place + WINDOW, one[start], two[start])

    return units


def _listed(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """The row of each member of a list column, and its fields."""
    members = column.flatten()
    rows = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    return rows, *(members.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names)


def _as_lists(n: int, rows: np.ndarray, kind: pa.DataType, **fields: np.ndarray) -> pa.Array:
    """The other way round; rows in order."""
    offsets = pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x, kind) for x in fields.values()], names=[*fields]))


def _merged(place: np.ndarray, end: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """What passages that overlap or follow each other cover together, in sentences and in words."""
    order = np.argsort(place, kind="stable")
    place, end, start, stop = (x[order] for x in (place, end, start, stop))
    end, stop = np.maximum.accumulate(end), np.maximum.accumulate(stop)
    new = np.concatenate([np.ones(1, bool), place[1:] > end[:-1] + 1])[: len(place)]
    last = np.append(np.flatnonzero(new)[1:], len(place))[: new.sum()] - 1
    return place[new], end[last], start[new], stop[last]


def _settler(least_together: int) -> Callable:
    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sentences of each text that go, and the repeated windows that none of them cuts into."""
        for batch in batches:
            n = batch.num_rows
            rows, kind, *places = _listed(batch.column("cut"), "kind", "place", "end", "start", "stop")
            # The texts are laid out one after another.
            places = [x + rows * _FAR for x in places]
            together = _merged(*(x[kind == SENTENCES] for x in places))
            enough = together[3] - together[2] >= least_together
            gone = _merged(*(np.concatenate([x[kind == LINES], y[enough]]) for x, y in zip(places, together, strict=True)))
            of = gone[0] // _FAR
            where = dict(zip(("place", "end", "start", "stop"), (x - of * _FAR for x in gone), strict=True))
            found, at, h1, h2 = _listed(batch.column("windows"), "place", "h1", "h2")
            at = at + found * _FAR
            near = np.searchsorted(gone[2], at + WINDOW)
            free = np.concatenate([[-1], gone[3]])[near] <= at
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("k1", "k2", "k3")), _as_lists(n, of, pa.int32(), **where),
                    _as_lists(n, found[free], pa.int64(), h1=h1[free], h2=h2[free]),
                ],
                names=["k1", "k2", "k3", "gone", "open"],
            )

    return settled


def _runs_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of 51 words that hold one of the asked windows."""
    for batch in _slices(batches):
        at = laid_out(binary(batch.column("text")))
        asked = batch.column("asked")
        rows, begin = np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy()), at.of_word
        place = asked.flatten().to_numpy().astype(np.int64) + begin[rows]
        least, most = np.maximum(place + WINDOW - RUN, begin[rows]), np.minimum(place, begin[rows + 1] - RUN)
        some = most >= least
        change = np.zeros(begin[-1] + 2, np.int64)
        np.add.at(change, least[some], 1)
        np.add.at(change, most[some] + 1, -1)
        start = np.flatnonzero(change.cumsum() > 0)
        rows = np.searchsorted(begin, start, "right") - 1
        place, kinds = start - begin[rows], np.full(len(rows), RUNS)
        digests = run_hashes(word_hashes(word_list(at.text)), start, start + RUN, RUNS)
        yield _units(batch, rows, kinds, place, place + RUN - 1, place, place + RUN, *digests)


def _rank() -> Column:
    """Documents in the order of their ids, null last, then of the hash of the text: one number that is merged before
    the shuffle."""
    wide = "decimal(38,0)"
    last = F.lit(str(1 << 63)).cast(wide)
    doc = F.when(F.col("k2"), last).otherwise(F.col("k1").cast(wide))
    bits = F.col("k3").bitwiseAND(F.lit((1 << 60) - 1)).cast(wide)
    return (doc * F.lit(1 << 60).cast("decimal(19,0)") + bits).cast(wide)


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What overlapping runs cover together."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _without(span: list[int], cuts: list[tuple[int, int]], text: bytes) -> list[list[int]]:
    """What stays of a span; blanks beside a cut go with it."""
    out, (start, end) = [], span
    for a, b in cuts:
        if a < end and b > start:
            left = start + len(text[start:a].rstrip())
            out += [[start, left]] if left > start else []
            start = b + len(text[b:end]) - len(text[b:end].lstrip())
    return [*out, [start, end]] if start < end or not out and [start, end] == span else out


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stays of each text, from where to where its parts stand in the original, and how many lines lost
    something."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts, spans, counts = [], [], []
        given = (binary(batch.column("text")), batch.column("gone").to_pylist(), batch.column("runs").to_pylist())
        for text, gone, again in zip(*given, strict=True):
            at = laid_out([text])
            starts, ends = (x.tolist() for x in at.sentences)
            gone = gone or []
            cuts = []
            if again:
                # Runs that no sentence that goes cuts into.
                first = np.sort(np.array(again, np.int64))
                lost = [np.array([g[k] for g in gone], np.int64) for k in ("start", "stop")]
                near = np.searchsorted(lost[0], first + RUN)
                first = first[np.concatenate([[-1], lost[1]])[near] <= first]
                cuts = [
                    (int(at.words[0][a]), int(at.words[1][b])) for a, b in _joined([(a, a + RUN - 1) for a in first.tolist()])
                ]
            sides = [-1, *(x for g in gone for x in (g["place"], g["end"])), len(starts)]
            kept = [[starts[a + 1], ends[b - 1]] for a, b in zip(sides[::2], sides[1::2], strict=True) if b > a + 1]
            if cuts:
                kept = [part for span in kept for part in _without(span, cuts, text)]
            texts.append(b"\n".join(text[a:b] for a, b in kept).decode())
            # From bytes to characters.
            done = chars = 0
            for span in kept:
                for k in (0, 1):
                    chars += len(text[done : span[k]].decode())
                    done, span[k] = span[k], chars
            spans.append([{"start": a, "end": b} for a, b in kept])
            lines = at.lines.tolist()
            lost = {k for g in gone for k in range(g["place"], g["end"] + 1)}
            counts.append(sum(
                any(k in lost for k in range(i, j)) or any(starts[i] < b and ends[j - 1] > a for a, b in cuts)
                for i, j in zip(lines, lines[1:], strict=False)
            ))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(spans, spans_type)],
            names=["doc", "text", "n_removed", "spans"],
        )


def _first(units: DataFrame) -> DataFrame:
    """The digests that are repeated, and the rank of the first document that has them. To be written, so that joins can
    split digests that are very common."""
    first = units.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(_rank()).alias("first")).where("n > 1")
    return first.drop("n")


def _met(units: DataFrame, path: str) -> DataFrame:
    """The passages whose digest is repeated, and whether they are in a later document than the first one that has it;
    written to ``path``.

    The passages are written in parts by their digests, which are gone through one after another: what is shuffled for a
    part goes before the next one, and so does the part.
    """
    spark, h1 = units.sparkSession, F.col("h1")
    with scratch(spark, "units") as folder:
        dealt = units.withColumn("part", F.pmod("h2", F.lit(PARTS)).cast("int"))
        dealt.write.option("compression", "zstd").partitionBy("part").parquet(folder)
        for k in range(PARTS):
            part = spark.read.schema(dealt.schema).parquet(folder).where(F.col("part") == k).drop("part")
            # Only what may be repeated, by half of its digest, is ranked and moves to the others that have the digest.
            twice = part.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1")
            may_be = with_marked(part, marks(twice, h1), h1, "often").where("often").drop("often")
            with kept(may_be, "often") as often:
                remove_folder(spark, f"{folder}/part={k}")
                with kept(_first(often), "first") as first:
                    met = often.join(first, ["h1", "h2"]).withColumn("later", _rank() > F.col("first")).drop("first")
                    met.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(met.schema).parquet(path)


def _later_runs(docs: DataFrame, windows: DataFrame, open_windows: DataFrame) -> DataFrame:
    """``(k1, k2, k3, runs)``: where the runs of 51 words, around the open windows, begin that an earlier document has.
    ``windows``: all places of the repeated windows; ``open_windows``: digests; ``docs``: keys and texts."""
    keys, content = ["k1", "k2", "k3"], ["h1", "h2"]
    wanted = windows.join(keep(open_windows.distinct(), "open"), content, "left_semi")
    asked = keep(wanted.groupBy(*keys).agg(F.collect_set("place").alias("asked")), "asked")
    hashed = F.xxhash64(*keys)
    texts = with_marked(docs, marks(asked, hashed), hashed, "wanted").where("wanted").drop("wanted").join(asked, keys)
    with kept(in_arrow(texts, _runs_around, UNITS).select(*keys, "place", *content), "runs") as runs:
        with kept(_first(runs), "first") as first:
            later = runs.join(first, content).where(_rank() > F.col("first"))
            return keep(later.groupBy(*keys).agg(F.collect_set("place").alias("runs")), "later_runs")


def _all_cuts(docs: DataFrame, least_words: int, least_together: int) -> DataFrame:
    """``(k1, k2, k3, gone, runs)``: the sentences and the runs that go, of each text that loses any."""
    ids, content, spark = ["k1", "k2", "k3"], ["h1", "h2"], docs.sparkSession
    with scratch(spark, "met") as path:
        met = _met(in_arrow(docs, _hasher(least_words), UNITS), path)
        # In the first document itself; passages with one content that start at different places end in the same order.
        upper = F.min("end").over(Window.partitionBy(*content))
        own = met.where(~F.col("later") & (F.col("kind") != WINDOWS))
        again = own.withColumn("upper", upper).where("place > upper").drop("upper")
        passage = F.when(F.col("kind") != WINDOWS, F.struct("kind", "place", "end", "start", "stop"))
        window = F.when(F.col("kind") == WINDOWS, F.struct("place", "h1", "h2"))
        cut = met.where("later").unionByName(again).groupBy(*ids)
        cut = cut.agg(F.collect_set(passage).alias("cut"), F.collect_set(window).alias("windows"))
        cut = keep(in_arrow(cut, _settler(least_together), SETTLED), "cuts")
        open_windows = cut.select(F.explode("open").alias("o")).select("o.*")
        runs = _later_runs(docs, met.where(F.col("kind") == WINDOWS), open_windows)
        return keep(cut.where(F.size("gone") > 0).drop("open").join(runs, ids, "full"), "all_cuts")


def drop_repeats(
    docs: DataFrame, least_words: int = LEAST_WORDS, least_together: int = LEAST_TOGETHER
) -> DataFrame:
    """The columns of ``docs`` with ``text`` without its repeated passages, ``n_removed`` (lines that lost something)
    and ``spans`` (start and end, in characters of the original text, of each run of sentences that stays; joined by
    line ends they are the text).

    Lines and runs with fewer than ``least_words`` words are left alone, and so are repeated sentences that have fewer
    than ``least_together`` words where they follow each other, unless their whole lines are repeated. Runs of 51
    words or more of an earlier document go word by word, except for runs of 51 that such lines or sentences cut into. Blank lines
    inside a repeated run go with it. Documents rank by id, null last; within a text the upper passage comes first, and
    passages that overlap it stay. Rows that repeat an id and a text are one document and get the same result; several
    texts with one id rank by their hashes. Null text: null, no spans. Very long texts are read whole. An empty table
    gives no rows. Extra columns are kept, but for those with the names of the new ones.
    """
    doc_id, text = field("doc_id").cast("long"), field("text").cast("string")
    keys = [F.coalesce(doc_id, F.lit(0)).alias("k1"), doc_id.isNull().alias("k2"), F.xxhash64(text).alias("k3")]
    keyed, hashed = docs.select(*keys, text.alias("text")), F.xxhash64("k1", "k2", "k3")
    with passing_shuffles(docs.sparkSession):
        cut = _all_cuts(keyed, least_words, least_together)
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    rows = with_marked(packed(docs, *keys, text.alias("text")), marks(cut, hashed), hashed, "touched")
    # Texts that lose nothing stay where they are.
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.char_length("text").cast("long").alias("end")))
    none = F.array().cast(ArrayType(span))
    same = rows.where(~F.col("touched") | F.col("text").isNull()).select(
        "doc", "text", F.lit(0).cast("long").alias("n_removed"),
        F.when(F.col("text").isNull(), none).otherwise(whole.cast(ArrayType(span))).alias("spans"),
    )
    touched = rows.where(F.col("touched") & F.col("text").isNotNull()).join(cut, ["k1", "k2", "k3"], "left")
    schema = StructType([
        rows.schema["doc"], StructField("text", StringType()), StructField("n_removed", LongType()),
        StructField("spans", ArrayType(span)),
    ])
    done = in_arrow(touched.select("doc", "text", "gone", "runs"), _cut_out, schema)
    return unpacked(same.unionAll(done), docs.columns, F.col("text"), F.col("n_removed"), F.col("spans"))

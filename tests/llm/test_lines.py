import random
import re
import time
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from cases import edge_documents, empty_documents
from conftest import MEDIUM

from cohortlab import session
from cohortlab.llm import lines, shingles, windows
from cohortlab.llm.queries import REGISTRY


def parts_of(text):
    """Sentences of each line with their places."""
    out, at = [], 0
    for line in text.split("\n"):
        places, start = [], 0
        for m in re.finditer(r"[.!?]([ \t]+)(?=[^ \t]|$)", line):
            if m.end() < len(line):
                places.append((at + start, at + m.start(1)))
                start = m.end()
        out.append([*places, (at + start, at + len(line))])
        at += len(line) + 1
    return out


def test_first_occurrence_stays(spark):
    passage = " ".join(f"Word{i}" for i in range(55))
    docs = [(9, f"nine\n{passage}\nend"), (3, f"three\n  {passage.upper()} \n{passage}"), (4, passage), (5, "five"), (6, "five")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"], [tuple(s) for s in r["spans"]]) for r in lines.drop_repeats(df).collect()}
    first = f"three\n  {passage.upper()} "
    assert got[3] == (first, 1, [(0, len(first))])
    assert got[9] == ("nine\nend", 1, [(0, 4), (5 + len(passage) + 1, 5 + len(passage) + 4)])
    assert got[4] == ("", 1, []) and got[5] == got[6] == ("five", 0, [(0, 4)])


def test_edges(spark):
    docs = edge_documents(spark)
    out = lines.drop_repeats(docs, least_words=3)
    assert set(out.columns) == {*docs.columns, "n_removed"} and out.count() == docs.count()
    rows = out.collect()
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] == 1)
    assert [r["text"] for r in rows if r["doc_id"] == 2] == [None]
    assert lines.drop_repeats(empty_documents(spark)).count() == 0
    null_last = spark.createDataFrame([(None, "a b c"), (5, "A  b c"), (-7, "a b C"), (None, "a b c d")], "doc_id long, text string")
    kept = {(r["doc_id"], r["text"]) for r in lines.drop_repeats(null_last, 3).collect()}
    assert kept == {(None, ""), (5, ""), (-7, "a b C"), (None, "a b c d")}


def runs(words, least):
    """The shortest runs with enough words from each unit on and up to each unit, and whole paragraphs."""
    full, n = [i for i, w in enumerate(words) if w], len(words)
    found = set()
    for i in full:
        size, j = 0, i
        while j < n and size < least:
            size, j = size + len(words[j]), j + 1
        found |= {(i, j - 1)} if size >= least else set()
        size, j = 0, i
        while j >= 0 and size < least:
            size, j = size + len(words[j]), j - 1
        found |= {(j + 1, i)} if size >= least else set()
        if i == 0 or not words[i - 1]:
            j = next((j for j in range(i, n) if not words[j]), n) - 1
            found |= {(i, j)} if sum(map(len, words[i : j + 1])) >= least else set()
    return sorted(found)


def earlier_runs(text, order, seen, gone, n=windows.RUN):
    """Where runs of 51 words or more of an earlier document stand that nothing in ``gone`` cuts into; each is looked up."""
    at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    words, out = [text[a:b].encode().lower() for a, b in at], []
    for i in range(len(words) - n + 1):
        start, end = at[i][0], at[i + n - 1][1]
        if seen.setdefault(tuple(words[i : i + n]), order) < order and not any(a < end and b > start for a, b in gone):
            if out and start <= out[-1][1]:
                start = out.pop()[0]
            out.append((start, end))
    return out


def brute(docs, least=lines.LEAST_WORDS, together=lines.LEAST_TOGETHER):
    """Text and number of lines that lost something of each document, in the order of the ids."""
    seen, out, windows_of = {}, {}, {}
    for order, (doc_id, text) in enumerate(sorted(docs)):
        by_line = parts_of(text)
        places = [p for line in by_line for p in line]
        words = [text[a:b].encode().lower().split() for a, b in places]
        line_of = [k for k, line in enumerate(by_line) for _ in line]
        first = [line_of.index(k) for k in range(len(by_line))]
        last = [*(f - 1 for f in first[1:]), len(places) - 1]
        whole = [[w for x in words[a : b + 1] for w in x] for a, b in zip(first, last, strict=True)]
        found = [(0, first[a], last[b]) for a, b in runs(whole, least)] + [(1, a, b) for a, b in runs(words, least)]
        gone = [set(), set()]
        for kind, i, j in found:
            before, end = seen.setdefault((kind, tuple(w for x in words[i : j + 1] for w in x)), (order, j))
            if before < order or i > end:
                gone[kind] |= set(range(i, j + 1))
        for i in range(len(places)):
            j = i
            while j in gone[1]:
                j += 1
            if i - 1 not in gone[1] and sum(map(len, words[i:j])) >= together:
                gone[0] |= set(range(i, j))
        cuts = earlier_runs(text, order, windows_of, [places[i] for i in gone[0]])
        kept = []
        for i, (a, b) in enumerate(places):
            if i not in gone[0]:
                if kept and i - 1 not in gone[0]:
                    kept[-1] = kept[-1][0], b
                else:
                    kept.append((a, b))
        for c, d in cuts:
            parts = [p for a, b in kept for p in (((a, min(b, c)), (max(a, d), b)) if a < d and b > c else ((a, b),))]
            blank = " \t\n\x0b\x0c\r"
            kept = [
                (a + (a == d) * (len(text[a:b]) - len(text[a:b].lstrip(blank))), b - (b == c) * (len(text[a:b]) - len(text[a:b].rstrip(blank))))
                for a, b in parts
            ]
            kept = [(a, b) for a, b in kept if a < b]
        lost = {line_of[i] for i in gone[0]} | {line_of[i] for c, d in cuts for i, (a, b) in enumerate(places) if a < d and b > c}
        out[doc_id] = "\n".join(text[a:b] for a, b in kept), len(lost), kept
    return out


def test_wrapped_passages_go(spark):
    words = [f"word{i}" for i in range(60)]

    def wrapped(n):
        return "\n".join(" ".join(words[i : i + n]) for i in range(0, 60, n))

    chant = "\n".join(["one short line again"] * 12)
    docs = [
        (1, f"start\n{wrapped(6)}\n\nend"), (2, wrapped(6)), (3, f"other start here\n{wrapped(6)}\nother end"),
        (4, f"head\n\n{wrapped(10)}\n\ntail"), (5, wrapped(10).upper()), (6, wrapped(60)), (7, chant),
        (8, f"{words[0]}\n{words[1]}"), (9, f"lead\n\n{wrapped(5)}\n\n{wrapped(4)}"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.drop_repeats(df).collect()}
    assert got == {i: r[:2] for i, r in brute(docs).items()}
    # Equal wrapping goes wherever it starts, other wrapping as a whole paragraph; what comes first and short lines stay.
    assert got[1] == (docs[0][1], 0) and got[2] == ("", 10) and got[3] == ("other start here\nother end", 10)
    assert got[5] == ("", 6) and got[6] == ("", 1) and got[8] == (docs[7][1], 0)
    assert got[7] == ("\n".join(["one short line again"] * 5), 7) and got[9][0].split() == ["lead"]


def long_repeats(docs, n=51):
    """Documents that have ``n`` words in a row of an earlier one."""
    seen, out = {}, set()
    for doc_id, text in sorted(docs):
        words = text.encode().lower().split()
        for i in range(len(words) - n + 1):
            if seen.setdefault(tuple(words[i : i + n]), doc_id) != doc_id:
                out.add(doc_id)
    return out


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()]
    text_of = dict(docs)
    rows = REGISTRY["op9_repeated_lines"](spark, MEDIUM).collect()
    got = {r["doc_id"]: (r["text"], r["n_removed"], [tuple(s) for s in r["spans"]]) for r in rows}
    assert got == brute(docs)
    for i, (text, n, spans) in got.items():
        # The offsets lead back to the parts of the original.
        assert text == "\n".join(text_of[i][a:b] for a, b in spans) and (n > 0) == (text != text_of[i])
    repeated = long_repeats(docs)
    assert all(got[i][1] > 0 for i in repeated)
    assert sum(got[i][1] > 0 for i in got if i not in repeated) < 0.07 * (len(docs) - len(repeated))


def test_passages_inside_lines_go(spark):
    """A passage between other sentences of a line, cut anywhere: inside a sentence, it goes but for that sentence."""
    passage = " ".join(" ".join(f"word{i}{j}" for j in range(10)) + "." for i in range(6))
    short = " ".join(f"few{i}" for i in range(25)) + "."
    docs = [
        (1, f"Début here. {passage} The end of one."), (2, f"Another start! {passage.upper()} And another end?"),
        (3, f"a line\nOf three. {passage}\nlast line"), (4, f"Half of a sentence {passage} with another half."),
        (5, f"One. {short} Two."), (6, f"Three. {short} Four."), (7, f"{passage}\n{passage}"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"], [tuple(s) for s in r["spans"]]) for r in lines.drop_repeats(df).collect()}
    assert got == brute(docs)
    assert got[1][:2] == (docs[0][1], 0) and got[2][:2] == ("Another start!\nAnd another end?", 1)
    assert got[3][:2] == ("a line\nOf three.\nlast line", 1)
    assert got[4][1] == 1 and "word30" not in got[4][0] and "word00" in got[4][0]
    # Fewer words than must lie together, inside lines that differ.
    assert got[6][:2] == (docs[5][1], 0) and got[7] == ("", 2, [])


def test_texts_without_repeats_stay(spark):
    docs = [(i, f"Sentence {i} has words. " * 6 + f"\nanother line of {i}") for i in range(300)]
    docs += [(1000 + i, " ".join(f"same{j}" for j in range(50))) for i in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = lines.drop_repeats(df)
    assert out.where("n_removed > 0").count() == 1 and out.count() == 302


def test_runs_inside_long_sentences_go(spark):
    """Runs of over 50 words of an earlier document go to the word, wherever they begin; shorter ones stay."""
    rng = random.Random(5)

    def some(n):
        return [f"w{rng.randrange(10**9)}é" for _ in range(n)]

    source = some(9000)
    docs, want = [(0, " ".join(source))], {0: (" ".join(source), 0)}
    for i in range(1, 61):
        n, at = 49 + i % 30, rng.randrange(8800)
        head, tail = some(rng.randrange(1, 40)), some(rng.randrange(1, 40))
        text = " ".join([*head, *(w.replace("w", "W") if i % 2 else w for w in source[at : at + n]), *tail])
        docs.append((i, f"first line {i}\n{text}\nlast line {i}"))
        left = f"first line {i}\n{' '.join(head)}\n{' '.join(tail)}\nlast line {i}"
        want[i] = (left, 1) if n > 50 else (docs[-1][1], 0)
    # A run over several lines and at both ends of a text; the first to have it keeps it, within one text it stays.
    run = some(70)
    docs += [(71, " ".join([*some(30), *run, *run])), (72, "\n".join(map(" ".join, (run[:15], run[15:33], run[33:51], [*run[51:], "end"]))))]
    want |= {71: (docs[-2][1], 0), 72: ("end", 4)}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = lines.drop_repeats(df).collect()
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in rows}
    assert got == want
    text_of = dict(docs)
    assert all(r["text"] == "\n".join(text_of[r["doc_id"]][a:b] for a, b in r["spans"]) for r in rows)


def test_chosen_windows_meet_in_every_run():
    rng = np.random.default_rng(3)
    for _ in range(200):
        run = rng.integers(0, 40, windows.RUN)
        texts = [np.concatenate([rng.integers(0, 40, k), run, rng.integers(0, 40, 30)]).astype(np.uint64) for k in rng.integers(0, 40, 2)]
        one, two = windows.window_hashes(np.concatenate(texts))
        sizes = [len(t) for t in texts]
        at = windows.chosen(sizes, one)
        of_first = {(one[i], two[i]) for i in at if i < sizes[0]}
        assert of_first & {(one[i], two[i]) for i in at if i >= sizes[0]}
        assert all(i + windows.WINDOW <= sizes[0] or i >= sizes[0] for i in at)


def test_layout_against_brute_force():
    """Words, sentences, lines and passages of many texts at once."""
    rng = random.Random(11)
    texts = ["", " ", ". a", "a. ", "\n", "a.\r\nb. \r c!\t\x0bd? \n.", "Oh! no", " b.\x0c c"]
    texts += ["".join(rng.choices(["a", "bc", "d", ".", "?", " ", "\t", "\n", "\n\n", "\r", " . "], k=rng.randrange(300))) for _ in range(80)]
    at = lines.laid_out([t.encode() for t in texts])
    assert [at.text[a:b] for a, b in zip(*at.words, strict=True)] == [w for t in texts for w in t.encode().split()]
    assert at.of_word.tolist() == np.cumsum([0, *(len(t.encode().split()) for t in texts)]).tolist()
    found = {kind: list(zip(*lines.passages(before, of, 5), strict=True)) for kind, before, of in (
        ("line", at.before[at.lines], at.of_line), ("sentence", at.before, at.of_sentence)
    )}
    for i, text in enumerate(texts):
        a, b = at.of_sentence[i], at.of_sentence[i + 1]
        by_line = parts_of(text)
        places = [p for line in by_line for p in line]
        assert places == [(x - at.begin[i], y - at.begin[i]) for x, y in zip(at.sentences[0][a:b], at.sentences[1][a:b], strict=True)]
        assert np.diff(at.before[a : b + 1]).tolist() == [len(text[x:y].encode().split()) for x, y in places]
        assert np.diff(at.lines[at.of_line[i] : at.of_line[i + 1] + 1]).tolist() == [len(line) for line in by_line]
        words = {"line": [x.encode().split() for x in text.split("\n")], "sentence": [text[x:y].encode().split() for x, y in places]}
        for kind, of in (("line", at.of_line), ("sentence", at.of_sentence)):
            assert [(x - of[i], y - of[i]) for x, y in found[kind] if of[i] <= x < of[i + 1]] == runs(words[kind], 5)


def test_settled_against_brute_force():
    """Sentences that go and windows that none of them cuts into, of many texts at once."""
    rng = random.Random(12)
    rows, want = [], []
    for i in range(60):
        sizes = [rng.randrange(9) for _ in range(rng.randrange(1, 40))]
        before = [0, *np.cumsum(sizes).tolist()]
        cut, gone, inside = [], set(), set()
        for _ in range(rng.randrange(7)):
            kind, a = rng.randrange(2), rng.randrange(len(sizes))
            b = min(a + rng.randrange(6), len(sizes) - 1)
            if sizes[a] and sizes[b]:  # passages begin and end with words
                cut.append({"kind": kind, "place": a, "end": b, "start": before[a], "stop": before[b + 1]})
                (inside if kind else gone).update(range(a, b + 1))
        for a in range(len(sizes)):
            b = next(b for b in range(a, len(sizes) + 1) if b not in inside)
            if a - 1 not in inside and before[b] - before[a] >= 15:
                gone |= set(range(a, b))
        lost = {w for k in gone for w in range(before[k], before[k + 1])}
        at = rng.sample(range(400), 5)
        rows.append({
            "k1": i, "k2": False, "k3": -i, "cut": cut, "windows": [{"place": w, "h1": w, "h2": -w} for w in at],
        })
        want.append((gone, [w for w in at if not lost & set(range(w, w + windows.WINDOW))]))
    passage = pa.list_(pa.struct([("kind", pa.int8()), *((n, pa.int32()) for n in ("place", "end", "start", "stop"))]))
    window = pa.list_(pa.struct([("place", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))
    kinds = pa.schema({"k1": pa.int64(), "k2": pa.bool_(), "k3": pa.int64(), "cut": passage, "windows": window})
    batch = pa.RecordBatch.from_pylist(rows, kinds)
    # Whole and in parts, which begin inside the columns.
    for batches in ([batch], [batch.slice(0, 17), batch.slice(17)]):
        got = [r for b in lines._settler(15)(iter(batches)) for r in b.to_pylist()]
        assert [{k for g in r["gone"] for k in range(g["place"], g["end"] + 1)} for r in got] == [w[0] for w in want]
        assert [[w["h1"] for w in r["open"]] for r in got] == [w[1] for w in want]


def test_hashing_passages_costs_little_beside_words():
    """Over the budget of 960 CPU seconds a GB before: passages were hashed one by one, at many times what words cost."""
    rng = random.Random(13)

    def text():
        sentence = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(3, 30))) + "."
        return "\n".join(" ".join(sentence() for _ in range(3)) for _ in range(10))

    texts = [text() for _ in range(1000)]
    n = pa.array(range(1000), pa.int64())
    batch = pa.RecordBatch.from_arrays([n, pa.array([False] * 1000), n, pa.array(texts)], names=["k1", "k2", "k3", "text"])

    def seconds(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    words = seconds(lambda: [shingles.word_hashes(shingles.word_list(t.encode())) for t in texts])
    assert seconds(lambda: list(lines._hasher(lines.LEAST_WORDS)(iter([batch])))) < 4 * words


def test_copies_and_shuffles_of_passages_go(spark, monkeypatch):
    """Over four times the input on disk before: all repeated passages were moved at once, and copies and shuffles stayed."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rng = random.Random(14)
    text = lambda: "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + "." for _ in range(4))
    texts = [text() for _ in range(50)]
    docs = [(i, f"{texts[i % 50]}\n{text()}") for i in range(150)]
    rows, kept = [], lines.kept

    @contextmanager
    def counted(df, label):
        with kept(df, label) as out:
            rows.append((label, out.count()))
            yield out

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(files.apply(i)) for i in range(files.size()) if "shuffle_" in str(files.apply(i))}

    monkeypatch.setattr(lines, "kept", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    folders, before, value = set(session._MADE), shuffled(), spark.conf.get(name, None)
    out = lines.drop_repeats(df)
    left = {path.split("/")[-1].rsplit("-", 1)[0] for path in session._MADE if path not in folders}
    assert left <= {"cuts", "open", "asked", "later_runs", "all_cuts"}
    assert spark.conf.get(name, None) == value
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.5)
    assert not shuffled() - before
    sizes = [n for label, n in rows if label == "often"]
    assert len(sizes) == lines.PARTS and 0 < max(sizes) < 0.5 * sum(sizes)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in out.collect()}
    assert got == {i: (t, 0) if i < 50 else (t.split("\n", 4)[4], 4) for i, t in docs}

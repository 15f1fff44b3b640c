import math
import zlib

import numpy as np
from cases import edge_documents, empty_documents
from conftest import MEDIUM
from pyspark.sql import functions as F

from cohortlab.llm import nbsvm
from cohortlab.llm.queries import REGISTRY
from cohortlab.llm.tables import read


def test_query_on_held_out_labels(spark):
    rows = {r["doc_id"]: r for r in REGISTRY["op13_quality_nbsvm"](spark, MEDIUM).collect()}
    assert len(rows) == read(spark, MEDIUM, "documents").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    labels = [(r["quality"], rows[r["doc_id"]]) for r in read(spark, MEDIUM, "labels").collect()]
    held = [(y, r["score"], r["predicted"]) for y, r in labels if r["held_out"]]
    good, bad = [s for y, s, _ in held if y], [s for y, s, _ in held if not y]
    order = sum(a > b for a in good for b in bad) / (len(good) * len(bad))
    assert order > 0.97
    assert sum(p == y for y, _, p in held) / len(held) > 0.93
    assert sum(p for y, _, p in held if y) / len(good) > 0.95


def test_held_out_labels_do_not_matter(spark):
    docs, labels = read(spark, MEDIUM, "documents"), read(spark, MEDIUM, "labels")
    held = nbsvm.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    expected = sorted(map(tuple, nbsvm.classify(docs, labels).collect()))
    assert sorted(map(tuple, nbsvm.classify(other, turned).collect())) == expected


def brute(text):
    """Buckets of a text, by another way of counting."""
    words, out = text.encode().split(), set()
    shapes = []
    for w in words:
        out.add(zlib.crc32(w.lower()) % nbsvm.BUCKETS)
        shape, last = b"", None
        for b in w:
            c = b"a" if 97 <= b <= 122 or b > 127 else b"A" if 65 <= b <= 90 else b"0" if 48 <= b <= 57 else bytes([b])
            shape, last = shape + c if c != last else shape, c
        shapes.append(shape)
    out |= {zlib.crc32(b"\1" + s) % nbsvm.BUCKETS for s in shapes}
    out |= {zlib.crc32(b"\2" + a + b" " + b) % nbsvm.BUCKETS for a, b in zip(shapes, shapes[1:], strict=False)}
    n = len(words) - 2
    if n > 0:
        again = n - len({tuple(w.lower() for w in words[i : i + 3]) for i in range(n)})
        out.add(zlib.crc32(b"\3%d" % (10 * again // n)) % nbsvm.BUCKETS)
    return sorted(out)


def test_indicators(spark):
    texts = [r["text"] for r in read(spark, MEDIUM, "documents").limit(200).collect()]
    texts += ["", " \n", "One", "A b", "aa!! bb$$$ 12-34 É é", "a b c " * 50, "a\tb\x0bc\r\nd"]
    assert all(np.frombuffer(nbsvm.indicators(t.encode()), np.uint16).tolist() == brute(t) for t in texts)
    assert nbsvm.indicators(None) == b""


def test_counts_of_all_training_texts(spark):
    docs = read(spark, MEDIUM, "documents")
    labels = {r["doc_id"]: r["quality"] for r in read(spark, MEDIUM, "labels").collect()}
    training = [(r["text"], labels[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in labels]
    df = spark.createDataFrame([(i, bytearray(nbsvm.indicators(t.encode())), y) for i, (t, y) in enumerate(training)],
                               "doc_id long, found binary, y int")
    model = nbsvm.learn(df, sample=100)
    bad, good = np.zeros(nbsvm.BUCKETS), np.zeros(nbsvm.BUCKETS)
    for text, y in training:
        (good if y else bad)[brute(text)] += 1
    assert np.allclose(model.ratio, nbsvm.ratios(bad, good))


def test_descent_reaches_the_optimum(monkeypatch):
    """The primal and the dual value of the hinge-loss problem meet."""
    monkeypatch.setattr(nbsvm, "PASSES", 2000)
    monkeypatch.setattr(nbsvm, "ENOUGH", 1e-7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6))
    signs = np.where(x[:, 0] + 0.5 * rng.normal(size=120) > 0.2, 1.0, -1.0)
    w, b = nbsvm.descend([(np.arange(6), row) for row in x], signs, 6)
    full = np.append(w, b)
    margins = signs * (x @ w + b)
    primal = 0.5 * full @ full + nbsvm.COST * np.maximum(0, 1 - margins).sum()
    # Any small change makes the loss no smaller.
    for _ in range(300):
        moved = full + rng.normal(size=7) * 10 ** rng.uniform(-4, -1)
        loss = 0.5 * moved @ moved + nbsvm.COST * np.maximum(0, 1 - signs * (x @ moved[:6] + moved[6])).sum()
        assert loss >= primal - 1e-6


def test_logistic():
    rng = np.random.default_rng(4)
    margins = rng.normal(size=20_000)
    good = rng.random(20_000) < 1 / (1 + np.exp(-(2.0 * margins - 0.7)))
    slope, offset = nbsvm.logistic(margins, good, np.ones(20_000))
    assert abs(slope - 2.0) < 0.1 and abs(offset + 0.7) < 0.1
    apart = nbsvm.logistic(np.array([-1.0, -1.0, 1.0]), np.array([False, False, True]), np.ones(3))
    assert all(map(math.isfinite, apart)) and apart[0] > 0


def test_edges(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(1, 0), (1, None), (5, 1), (6, 1), (7, 0), (None, 0), (99, 0)], "doc_id long, quality int")
    rows = nbsvm.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}
    assert len(empty) == 1
    assert nbsvm.classify(empty_documents(spark), labels).count() == 0
    for none in (labels.limit(0), labels.where("quality = 1"), labels.where("quality is null")):
        assert len({r["score"] for r in nbsvm.classify(docs, none).collect()}) == 1

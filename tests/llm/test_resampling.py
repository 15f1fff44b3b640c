import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from cases import edge_documents, empty_documents
from conftest import MEDIUM

from cohortlab.llm import resampling
from cohortlab.llm.queries import REGISTRY
from cohortlab.llm.tables import read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def features(text, orders=(1, 1)):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=10, least=20, orders=(1, 1)):
    def bucket(f):
        return zlib.crc32(f.encode()) % 10_000

    raw, aim = (Counter(bucket(f) for t in texts for f in features(t, orders)) for texts in ([t for _, t in docs], target))
    s, t = sum(raw.values()), sum(aim.values())
    out = []
    for doc_id, text in docs:
        found = features(text, orders)
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, len(words(text))])
    eligible = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in read(spark, MEDIUM, "documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in read(spark, MEDIUM, "benchmark").collect()]
    assert got(REGISTRY["op12_target_resampling"](spark, MEDIUM)) == brute(docs, target)


def test_word_pattern():
    text = "".join(map(chr, range(1, 0x250))) + " Ünïcode123 x_y z{w 中文 a\x7fb"
    assert [w.decode() for w in resampling.word_list(text.encode())] == words(text)
    assert [g.decode() for g in resampling.grams(resampling.word_list(text.encode()), (1, 3))] == features(text, (1, 3))


def test_ranks_of_many_ties(spark):
    """Half of the rows are equal; no segment gets more than two shares, and ranks run through."""
    rng = np.random.default_rng(5)
    rows = [(int(s), int(i)) for s, i in zip(rng.integers(0, 4, 4000), rng.integers(0, 50, 4000), strict=True)]
    rows += [(7, 7)] * 4000 + [(2, None), (2, None)]
    df = spark.createDataFrame(rows, "score long, doc_id long").repartition(8)
    ranks = resampling.regular_ranks(df, 8)
    found = sorted((r["rank"], r["score"], r["doc_id"]) for r in ranks.collect())
    expected = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    assert [r[0] for r in found] == list(range(1, len(rows) + 1))
    assert [(s, i) for _, s, i in found] == expected
    sizes = [r["count"] for r in ranks.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * len(rows) / 8 + 8


def test_edges(spark):
    docs = edge_documents(spark)
    target = spark.createDataFrame([("small TEXT about word1 word2",), (None,), ("",)], "text string")
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for orders in ((1, 1), (1, 2)):
        out = resampling.resample(docs, target, percent=40, least_words=3, orders=orders)
        assert got(out) == brute(given, [r[0] for r in target.collect()], 40, 3, orders)
    assert resampling.resample(empty_documents(spark), target).count() == 0
    assert got(resampling.resample(docs, target.where("false"))) == brute(given, [])


def test_draw_moves_towards_the_target(spark):
    """Texts of the target's words are drawn far more often than their share."""
    rows = [(i, " ".join(f"{'aim' if i % 10 == 0 else 'raw'}{(i * 7 + j) % 40}" for j in range(25))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(f"aim{j}" for j in range(40)),)], "text string")
    drawn = [r["doc_id"] for r in resampling.resample(docs, target, percent=5).where("rank is not null").collect()]
    assert len(drawn) == 100 and sum(i % 10 == 0 for i in drawn) > 95

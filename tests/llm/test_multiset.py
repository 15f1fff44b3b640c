import hashlib
import math
import random

import pytest
from cases import edge_documents, empty_documents
from conftest import MEDIUM
from pyspark.sql import functions as F

from cohortlab.llm import multiset
from cohortlab.llm.queries import REGISTRY


def prints(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["fingerprint"] for r in multiset.fingerprint_table(df).orderBy("doc_id").collect()]


def lanes(fingerprint):
    cut = multiset.EQUAL_LANES * 8
    equal = [int(fingerprint[i : i + 8], 16) for i in range(0, cut, 8)]
    return equal, [int(fingerprint[i : i + 8], 16) for i in range(cut, len(fingerprint), 8)]


def test_order_and_arithmetic(spark):
    a, b, c = "one two three four", "five six seven", "eight nine ten eleven twelve"
    one, two, first, second, third, other = prints(
        spark, f"{a}\n{b}\n{c}", f"{c}\n{a}\n{b}", a, f"{b}\n{c}", f"{a}\n{a}\n{b}\n{c}", f"{a} {b}\n{c}"
    )
    assert one == two and len({one, first, second, third, other}) == 5
    # A paragraph is added by adding its vector, and taken away again.
    for x, y, z, bits in zip(lanes(first), lanes(second), lanes(one), (32, 32), strict=True):
        assert [(p + q) % 2**bits for p, q in zip(x, y, strict=True)] == z
        assert [(p - q) % 2**bits for p, q in zip(z, x, strict=True)] == y


def test_query(spark):
    docs = dict(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect())
    order = sorted(docs, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    rows = {r["doc_id"]: r for r in REGISTRY["op10_multiset_fingerprints"](spark, MEDIUM).collect()}
    assert rows.keys() == docs.keys()
    seen = {}
    for i, r in rows.items():
        text, n = docs[i], len(docs[i])
        edited = text[: n - n // 2] + docs[following[i]][: n // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if docs[following[i]] == text:
            assert r["near_next"] == 1
    assert len(set(seen.values())) == len(seen)
    apart = [r for i, r in rows.items() if len(docs[i]) > 100 and docs[following[i]] != docs[i]]
    assert sum(r["near_edited"] > r["near_next"] for r in apart) > 0.99 * len(apart)


def test_likeness_follows_what_is_shared(spark):
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words)
    shares = (1.0, 0.9, 0.7, 0.5, 0.2, 0.0)
    texts = [" ".join(words[: int(400 * s)] + [f"x{i}" for i in range(400 - int(400 * s))]) for s in shares]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([base, *texts])], "doc_id long, text string")
    signs = multiset.sign_lanes(df, ["doc_id"], "text").orderBy("doc_id").select("signs", F.array(F.lit(0)).alias("e"))
    rows = signs.collect()
    pairs = spark.createDataFrame([(rows[0][0], r[0]) for r in rows[1:]], "a array<smallint>, b array<smallint>")
    near = [r[0] for r in pairs.select(multiset.likeness(F.array(F.lit(1)), F.col("a"), F.array(F.lit(2)), F.col("b"))).collect()]
    assert all(abs(x - s) < 0.25 for x, s in zip(near, shares, strict=True)) and near[0] > 0.999


def test_edges(spark):
    docs = edge_documents(spark)
    rows = multiset.compare_with_next(docs).collect()
    assert len(rows) == docs.select("doc_id", "text").distinct().count()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    empty = [r["fingerprint"] for r in rows if r["doc_id"] in (2, 3)]
    assert empty[0] == empty[1]
    assert multiset.compare_with_next(empty_documents(spark)).count() == 0
    alone = multiset.compare_with_next(spark.createDataFrame([(1, "just one text")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1 and alone["edited_sha256"] == hashlib.sha256(b"just onjust o").hexdigest()
    plan = multiset.fingerprint_table(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_all_lanes_count(spark):
    """Likeness is the cosine over 128 lanes, however they are stored."""

    def signed(fingerprint):
        return [x - (x >> 31 << 32) for x in lanes(fingerprint)[1]]

    rows = REGISTRY["op10_multiset_fingerprints"](spark, MEDIUM).collect()
    widths = set()
    for r in rows:
        a, b = signed(r["fingerprint"]), signed(r["edited_fingerprint"])
        assert len(a) == len(b) == 128
        norm = math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
        near = sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0
        assert r["near_edited"] == pytest.approx(1 if r["fingerprint"] == r["edited_fingerprint"] else max(near, 0))
        widths.add(max(map(abs, a)) < 128)
    assert widths == {True, False}


def test_one_line_very_often(spark):
    """40,000 shingles of one kind, and 20,000 after the edit: the angle does not change."""
    docs = spark.createDataFrame([(2, "one two three\n" * 40_000), (1, "short")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in multiset.compare_with_next(docs).collect()}
    assert rows[2]["near_edited"] > 0.999
    signs = multiset.sign_lanes(docs, ["doc_id"], "text").where("doc_id = 2").first()["signs"]
    assert len(signs) == 128 and {abs(x) for x in signs} == {40_000}


def test_both_fingerprints_are_those_of_the_whole_texts(spark):
    """Paragraphs in common are summed once; cuts at, before and behind line ends, without any, and in empty texts."""
    texts = ["a b c d\ne f g h\ni j k l", "a b c d\n", "\n\n\n\n", "one line only without an end", "", "x", "\nxy",
             "a b c d\ne f\n", "ab\ncd", "ab\nc", "p q r s t u v w\n" * 300, "w" * 1000 + "\n" + "v w x y z " * 400, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = list(range(len(texts)))[::-1]
    edited = {}
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        text, n = texts[i] or "", len(texts[i] or "")
        edited[i] = text[: n - n // 2] + (texts[after] or "")[: n // 2]
    rows = {r["doc_id"]: r for r in multiset.compare_with_next(df).collect()}
    assert [rows[i]["fingerprint"] for i in range(len(texts))] == prints(spark, *(t or "" for t in texts))
    assert [rows[i]["edited_fingerprint"] for i in range(len(texts))] == prints(spark, *(edited[i] for i in range(len(texts))))


def test_lanes_against_brute_force(spark):
    """Both kinds of lanes counted one paragraph, shingle and bit at a time."""
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choices("abcdefghij", k=rng.randrange(0, 40))) for _ in range(rng.randrange(1, 30)))
             for _ in range(8)]
    texts.append(" ".join(f"w{i}" for i in range(1000)))
    # Hashes of single values by Spark, all sums here.
    shingled, whole = [], []
    for text in texts:
        for p in text.split("\n"):
            w = p.split()
            whole.append((p,))
            shingled += [(w[i : i + 3],) for i in range(len(w) - 2)] if len(w) > 2 else [(w,)] if w else []

    def hashed(cells):
        three = spark.createDataFrame(cells, "w array<string>").distinct().withColumn(
            "h", F.when(F.size("w") == 3, F.xxhash64(*(F.get("w", k) for k in range(3)))).otherwise(F.xxhash64("w"))
        )
        return {tuple(r["w"]): (r["h"], r["g"]) for r in three.withColumn("g", F.xxhash64("h", F.lit(1))).collect()}

    words = hashed(shingled)
    lanes_of = {r["p"]: r["v"] for r in spark.createDataFrame(whole, "p string").distinct().withColumn("d", F.sha2("p", 256))
                .withColumn("v", F.array(*(F.xxhash64("d", F.lit(i).cast("long")) for i in range(multiset.EQUAL_LANES)))).collect()}
    for text, fingerprint in zip(texts, prints(spark, *texts), strict=True):
        equal, signs = lanes(fingerprint)
        ps = text.split("\n")
        assert equal == [sum(lanes_of[p][i] for p in ps) % 2**32 for i in range(multiset.EQUAL_LANES)]
        found = []
        for p in ps:
            w = p.split()
            found += [words[tuple(w[i : i + 3])] for i in range(len(w) - 2)] if len(w) > 2 else [words[tuple(w)]] if w else []
        expected = [
            sum(2 * (pair[half] >> bit & 1) - 1 for pair in found) % 2**32
            for half in (0, 1) for i in range(32) for bit in (i, i + 32)
        ]
        assert signs == expected

import itertools
import random

import numpy as np
import pytest
from cases import edge_documents, empty_documents
from conftest import MEDIUM

from cohortlab.llm import hyperminhash as hmh
from cohortlab.llm.components import components
from cohortlab.llm.queries import REGISTRY


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(docs, k, percent=80):
    """Component of each (id, text) by comparing all pairs that share a shingle."""
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = {p for ids in by_shingle.values() for p in itertools.combinations(ids, 2)}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            parent[root(a)] = root(b)
    low = {}
    for i, (doc_id, _) in enumerate(docs):
        low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), low[root(i)], doc_id == low[root(i)]) for i, (doc_id, _) in enumerate(docs)}


def as_dict(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()]
    assert as_dict(REGISTRY["op3_hyperminhash_dedup"](spark, MEDIUM)) == brute(docs, 4)


def near_copies(n, seed):
    """Chains and clusters around the threshold: each copy changes some words of an earlier one."""
    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 160))) for _ in range(8)]
    while len(texts) < n:
        words = rng.choice(texts[:4] if rng.random() < 0.7 else texts).split()
        for _ in range(rng.randrange(0, max(2, len(words) // 22))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    return list(enumerate(texts))


def test_clusters_in_blocks(spark, monkeypatch):
    """Small blocks, so that members of one band meet in different ones."""
    monkeypatch.setattr(hmh, "BLOCK_MEMBERS", 16)
    docs = near_copies(400, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert as_dict(hmh.near_duplicates(df, words=5)) == brute(docs, 5)


def test_registers_and_estimates():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 2**64, 30_000, dtype=np.uint64))
    rng.shuffle(pool)
    for common, own in ((900, 100), (2000, 2000), (0, 3000), (40, 8)):
        a = np.sort(pool[: common + own])
        b = np.sort(np.concatenate((pool[:common], pool[-own:])))
        x, y = hmh.registers(a), hmh.registers(b)
        sizes = np.array([float(len(a))]), np.array([float(len(b))])
        got, _ = hmh.estimates(x[None], y[None], *sizes)
        assert got[0] == pytest.approx(common / (common + 2 * own), abs=0.15)
    # The smallest hash of a bucket, by leading zeros and mantissa.
    one = hmh.registers(np.array([(5 << 57) | (1 << 56)], dtype=np.uint64))
    assert one[5] == 0 and (np.delete(one, 5) == hmh.EMPTY).all()
    low = hmh.registers(np.array([5 << 57], dtype=np.uint64))
    assert low[5] >> 10 == 57
    assert hmh.linked(np.arange(8, dtype=np.uint64), np.arange(10, dtype=np.uint64), 80)
    assert not hmh.linked(np.arange(79, dtype=np.uint64), np.arange(100, dtype=np.uint64), 80)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(7, 7), (None, 3)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    docs = edge_documents(spark)
    got = sorted(map(str, hmh.near_duplicates(docs).collect()))
    assert len(got) == docs.count()
    rows = {(r["doc_id"], r["n_shingles"]): r for r in hmh.near_duplicates(docs).collect()}
    assert rows[2, 0]["kept"] and rows[3, 0]["component_id"] == 3
    assert rows[6, 7]["component_id"] == 1 and not rows[6, 7]["kept"]
    assert rows[None, 1]["component_id"] is None and rows[None, 1]["kept"]
    left = hmh.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "1", "2", "3", "4", "5", "7", "None", "None"]
    assert hmh.near_duplicates(empty_documents(spark)).count() == 0
    assert hmh.one_of_each(empty_documents(spark)).count() == 0


def test_estimate_keeps_borderline_pairs():
    """78 of 128 registers equal is five standard errors below 0.8: the full sets decide."""
    a = np.arange(hmh.REGISTERS, dtype=np.uint16)[None, :]
    b = a.copy()
    b[0, 78:] += 1000
    n = np.array([1000])
    assert hmh._likely(a, b, n, n, 80).all()

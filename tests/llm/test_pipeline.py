import hashlib
import os
import re

import pytest
from cases import edge_documents, empty_documents
from conftest import SMALL
from test_hyperminhash import brute as components_of
from test_pieces import library
from test_rules import brute as statistics_of

import corpus_pipeline as cp
from cohortlab import session
from cohortlab.llm.tables import keep, read

STAGES = dict(cp.STAGES)


@pytest.fixture(scope="module")
def outputs(spark):
    """What each stage returns, written and read again."""
    docs, out = read(spark, SMALL, "documents"), {"input": read(spark, SMALL, "documents")}
    for name, stage in cp.STAGES:
        docs = out[name] = keep(stage(spark, docs, SMALL), name)
    out["folders"] = set(session._MADE)
    return out


def texts(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(outputs):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "pii", "mixing", "sentencepiece"]
    names = outputs["input"].columns
    assert all(outputs[n].columns == names for n, _ in cp.STAGES[:-1])


def test_quality(outputs, spark):
    given, kept = dict(texts(outputs["input"])), dict(texts(outputs["quality_rules"]))
    assert kept.items() <= given.items()
    labels = {r["doc_id"]: r["quality"] for r in read(spark, SMALL, "labels").collect()}
    for i, text in given.items():
        n, *_, repeated = statistics_of(text)
        failed = n < 10 or 100 * repeated > 20 * n
        assert not (failed and i in kept)
        if labels.get(i) == 1 and not failed:
            assert i in kept


def test_dedup(outputs):
    given, kept = texts(outputs["quality_rules"]), texts(outputs["near_dedup"])
    expected = [(i, t) for i, t in given if components_of(given, 5)[i][2]]
    assert sorted(kept) == sorted(expected)


def test_private_values_go(outputs):
    given, made = dict(texts(outputs["near_dedup"])), dict(texts(outputs["pii"]))
    assert given.keys() == made.keys()
    found = 0
    for i, text in given.items():
        for value in re.findall(r"\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}", text):
            found += 1
            assert value not in made[i]
        if not re.search(r"[0-9@=]", text):
            assert made[i] == text
    assert found


def test_mixing(outputs):
    given, mixed = texts(outputs["pii"]), texts(outputs["mixing"])
    assert set(mixed) <= set(given)
    words = sum(len(t.split()) for _, t in given)
    assert sum(len(t.split()) for _, t in mixed) == pytest.approx(words, rel=0.1)
    assert max(mixed.count(x) for x in set(mixed)) <= 3


def test_encoding(outputs):
    given, rows = texts(outputs["mixing"]), outputs["sentencepiece"].collect()
    p = library()
    expected = sorted((i, p.encode(t)) for i, t in given)
    assert sorted((r["doc_id"], r["ids"]) for r in rows) == expected
    assert all(r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() for r in rows)


def test_run(spark, outputs):
    made = cp.run(spark, SMALL)
    ran = sorted(map(str, made.select("doc_id", "ids_sha256").collect()))
    # Only what the result reads is left of all that the run wrote.
    left = {p for p in session._MADE if p not in outputs["folders"] and os.path.isdir(p)}
    assert {os.path.basename(p).split("-")[0] for p in left} == {"mixing"}
    assert ran == sorted(map(str, outputs["sentencepiece"].select("doc_id", "ids_sha256").collect()))


@pytest.mark.parametrize("name", list(STAGES))
def test_edges(spark, name):
    docs = edge_documents(spark)
    out = STAGES[name](spark, docs, SMALL)
    if name != "sentencepiece":
        assert out.columns == docs.columns
    assert out.count() >= 1
    assert STAGES[name](spark, empty_documents(spark), SMALL).count() == 0

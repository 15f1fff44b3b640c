import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import sentencepiece
from cases import edge_documents, empty_documents
from conftest import MEDIUM

from cohortlab.llm import pieces
from cohortlab.llm.queries import REGISTRY

BITS = ["a", "b", "the", " ", "  ", "   ", "\n", "\t", "▁", "é", "①", "𝒳", "<s>", "</s>", "\0", "　", "中文", "ing", "!", "--"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_same_ids_and_spans_as_the_library():
    own, other = pieces.pieces(), library()
    given = [*texts(3000), "", " ", "▁", "x" * 500, " " * 70]
    e = own.encode([t.encode() for t in given])
    for i, text in enumerate(given):
        ids = other.encode(text)
        mine = slice(e.bounds[i], e.bounds[i + 1])
        assert e.ids[mine].tolist() == ids and e.joined[i] == ",".join(map(str, ids)), text
        ends = [p.end for p in other.encode(text, return_type="proto").pieces]
        # The library gives all but the last byte of a character no bytes; here each byte has its own.
        same = [(a, b) for a, b, x in zip(ends, e.ends[mine].tolist(), ids, strict=True) if not other.is_byte(x)]
        assert all(a == b for a, b in same), text
        assert not ids or e.ends[mine][-1] == len(text.encode())


def test_query(spark):
    other = library()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = REGISTRY["op5_sentencepiece"](spark, MEDIUM).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = other.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["n_bytes"] == len(docs[r["doc_id"]].encode())
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(other.decode(ids).encode()).hexdigest()


def compiled(entries: dict[bytes, bytes]) -> bytes:
    """A character map in its compiled form: a double array placed greedily, then the replacements."""
    texts_at, data = {}, b""
    for key, new in entries.items():
        texts_at[key] = len(data)
        data += new + b"\0"
    units, free = {0: 0}, 1

    def place(node, prefix):
        nonlocal free
        below = sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})
        ends = prefix in entries
        base = free
        while any((base ^ c) in units for c in [*below, *([0] if ends else [])]) or (base ^ node) >= 1 << 21:
            base += 1
        units[node] |= (base ^ node) << 10 | (0x100 if ends else 0)
        if ends:
            units[base] = texts_at[prefix] | 1 << 31
        for c in below:
            units[base ^ c] = c
        for c in below:
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    size = max(units) + 1
    trie = b"".join(struct.pack("<I", units.get(i, 0x7F)) for i in range(size))
    return struct.pack("<I", len(trie)) + trie + data


def test_compiled_map():
    entries = {"ﬁ".encode(): b"fi", "①".encode(): b"1", b"ab": b"X", b"abc": "Ÿ".encode(), "é".encode(): b"e"}
    m = pieces.CharMap(compiled(entries))
    assert m.longest(b"abcd", 0) == (3, "Ÿ".encode())
    assert m.longest(b"abx", 0) == (2, b"X") and m.longest(b"axb", 0) is None
    p = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    p.map = m
    normal, places = p.normalise("ab é①z abc")
    assert normal == "▁X▁e1z▁Ÿ"
    data = "ab é①z abc".encode()
    # Each piece is projected to whole bytes of the source.
    e = p.encode([data, "ﬁn".encode(), b""])
    assert e.ids[: e.bounds[1]].tolist() == p.library.encode("X e1z Ÿ")
    assert e.ends[e.bounds[1] - 1] == len(data) and e.ends[e.bounds[2] - 1] == 4 and e.bounds[3] == e.bounds[2]
    assert (np.diff(places) >= 0).all() and places[-1] == len(data)


def test_edges(spark):
    docs = edge_documents(spark)
    rows = pieces.encode_texts(docs, digests=True).collect()
    assert len(rows) == docs.count()
    other = library()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] in (2, 3, 5)}
    assert by_id[2]["ids"] == [] == by_id[3]["ids"] and by_id[2]["n_bytes"] == 0
    assert by_id[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    long = next(r["text"] for r in docs.collect() if r["doc_id"] == 5)
    assert by_id[5]["ids"] == other.encode(long) and by_id[5]["ends"][-1] == len(long)
    assert pieces.encode_texts(empty_documents(spark)).count() == 0


def test_slices(spark, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 100)
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    given = texts(200, 9)
    encode = pieces._encoder(None, ["doc_id", "ids", "ids_sha256", "decoded_sha256"])
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": given})
    ids = [x for b in encode([batch]) for x in b.column("ids").to_pylist()]
    assert ids == [library().encode(t) for t in given]

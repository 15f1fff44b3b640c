import hashlib
import random
import zlib
from collections import defaultdict

from cases import edge_documents
from conftest import MEDIUM
from pyspark.sql import functions as F

from cohortlab.llm import prefixes
from cohortlab.llm.queries import REGISTRY

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
)


def conversations(rows):
    """Turns of each conversation in reading order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, of in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below)
        ends = ",".join(str(c) for c in sorted(of) if len(convs[c]) == len(node))
        out.append((
            min(of), len(node), min(members[node[:-1]]) if node else None, len(of),
            sum(len(n) == len(node) + 1 for n in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query_against_brute_force(spark):
    given = spark.read.parquet(f"{MEDIUM}/conversations.parquet")
    convs = conversations([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in given.collect()])
    assert rows_of(REGISTRY["op11_prefix_trie"](spark, MEDIUM)) == brute(rebuilt(convs))


def random_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(0, 7)):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", None, ""])))
    return rows


def test_shared_prefixes_with_any_sketch(spark):
    """A sketch with hardly any cells proves nothing, and a wide one nearly all; the nodes are the same."""
    rows = random_rows(60, 3) + [(200, 0, "user", "only one"), (201, 5, "user", "two"), (201, 4, "x", "three")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    turns, convs = prefixes.numbered_turns(df)
    expected = brute(conversations(rows))
    shared = {}
    for cells in (64, 1 << 16):
        assert rows_of(prefixes.trie(turns, convs, cells)) == expected
        marked = prefixes.screened(prefixes.prefixes(turns, convs), cells)
        shared[cells] = marked.where("not single").count()
        # What the sketch proves is true.
        single = {(r["pos"], r["p1"], r["p2"]) for r in marked.where("single").collect()}
        often = marked.groupBy("pos", "p1", "p2").count().where("count > 1").collect()
        assert not any((r["pos"], r["p1"], r["p2"]) in single for r in often)
    assert shared[1 << 16] < shared[64]
    assert rows_of(prefixes.shared_openings_trie(df)) == brute(rebuilt(conversations(rows)))


def test_long_conversations(spark, monkeypatch):
    """Two that share more turns than a block has, one that leaves them in the middle, and many that end together."""
    monkeypatch.setattr(prefixes, "BLOCK", 16)
    monkeypatch.setattr(prefixes, "CHUNK", 40)
    long = [(c, t, "user" if t % 2 else "assistant", f"t{t % 7}") for c in (3, 8) for t in range(100)]
    fork = [(5, t, "user" if t % 2 else "assistant", f"t{t % 7}" if t < 41 else "else") for t in range(60)]
    many = [(c, 0, "user", "hello") for c in range(1000, 1400)]
    df = spark.createDataFrame(long + fork + many, SCHEMA)
    assert rows_of(prefixes.conversation_trie(df)) == brute(conversations(long + fork + many))


def test_edges(spark):
    rows = [
        (1, None, None, None), (1, None, None, None), (1, 0, "user", "x" * 200_000), (None, 0, "user", "nobody's"),
        (2, 0, "", ""), (2, 0, None, None), (-7, 3, "user", "a"), (-7, 3, "assistant", "b"),
    ]
    extra = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", pos long, total long, key string")
    assert rows_of(prefixes.conversation_trie(extra)) == brute(conversations(rows))
    assert prefixes.conversation_trie(extra.where("false")).count() == 0
    assert prefixes.shared_openings_trie(extra.where("false")).count() == 0
    one = spark.createDataFrame([(4, 0, "user", "a")], SCHEMA)
    assert rows_of(prefixes.conversation_trie(one)) == brute({4: [("user", "a")]})
    # Other tables with these columns will do; equal texts of one id are turns that follow each other.
    docs = edge_documents(spark).select(F.col("doc_id").alias("conv_id"), F.col("rank").alias("turn"), F.col("lang").alias("role"), "text")
    given = [tuple(r) for r in docs.collect()]
    assert rows_of(prefixes.conversation_trie(docs)) == brute(conversations(given))

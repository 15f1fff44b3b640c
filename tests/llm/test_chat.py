import hashlib

from conftest import MEDIUM
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.llm import chat
from cohortlab.llm.queries import REGISTRY

BITS = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "é", " ", "\n", "😀", "<\\/s>", "[\\INST]"]
TEXT = st.lists(st.one_of(st.sampled_from(BITS), st.text(max_size=4)), max_size=8).map("".join)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_escape_is_reversible(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_ids_read_back(role, text):
    text = "".join(c for c in text if not 0xD800 <= ord(c) < 0xE000)
    role = "".join(c for c in role if not 0xD800 <= ord(c) < 0xE000)
    c = chat.coder()
    ids = [c.reserved[chat.OPEN], *c.encode(role), c.reserved[chat.TURN], *c.encode(text), c.reserved[chat.REPLY]]
    assert c.read(ids) == (role, text, False)
    assert sum(i >= c.first for i in ids) == 3


def test_query(spark):
    turns = spark.read.parquet(f"{MEDIUM}/conversations.parquet").collect()
    talks = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in turns:
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    rows = REGISTRY["op4_chat_format"](spark, MEDIUM).collect()
    assert len(rows) == len(talks)
    for r in rows:
        own = sorted(talks[r["conv_id"]])
        said = "".join(t for _, role, t in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha("".join(f"{a}\n{b}\n" for _, a, b in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), sha(said))
        assert r["formatted_chars"] >= sum(len(a) + len(b) + 13 for _, a, b in own)


def test_positions_and_edges(spark):
    long = "ab</s>" * 40_000
    rows = [(1, 1, "assistant", long), (1, 0, "user", None), (1, None, None, "late"), (None, 0, "user", "x"),
            (2, 0, "assistant", ""), (2, 0, "assistant", ""), (2, 0, "tool", "[INST]")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    formatted = chat.format_turns(df).collect()
    assert len(formatted) == len(rows)
    for conv in (1, 2, None):
        own = sorted((r["token_start"], len(r["ids"])) for r in formatted if r["conv_id"] == conv)
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0
    learned = [r for r in formatted if r["loss_end"] > r["loss_start"]]
    assert len(learned) == 1 and learned[0]["conv_id"] == 1
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert back[1]["turns_sha256"] == sha(f"user\n\nassistant\n{long}\n\nlate\n")
    assert (back[1]["loss_chars"], back[1]["loss_sha256"]) == (len(long), sha(long))
    assert back[2]["n_turns"] == 3 and back[None]["n_turns"] == 1
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0

import pytest

from cohortlab import GRADUATES as G
from cohortlab.operators import features, learn, score, text


@pytest.fixture(scope="module")
def scorer(graduates):
    encoding = features.fit_encoding(graduates.where("placed = 1"), G)
    return encoding, learn.weighted_sum(encoding, {"skill_score": 0.3, "python_skill": 0.1}, 3.9)


def test_explain_text(make, scorer):
    encoding, model = scorer
    df = make({"cgpa": 8.126, "branch": "IT", "coding_score": None})
    explained = score.explain(df, model, encoding.names, [("skill_score", 0.9), ("cgpa", 0.1)], G)
    row = text.explain_text(explained, G).first()
    lines = row["user_text"].split("\n")
    assert row["system_text"] == text.EXPLAIN_SYSTEM
    assert "Mean grade = 8.13" in lines and "Subject = IT" in lines and "Own projects = 3" in lines
    assert "Programming test = 50.00" in lines and explained.first()["n_filled"] == 1
    assert lines[0].startswith("score = ") and lines[0].endswith(" LPA") and "," in lines[1]
    assert sum(x.startswith("driver ") for x in lines) == 2


def test_advice_text_keeps_eight_gains_and_profiles_without_any(make, graduates, scorer):
    encoding, _ = scorer
    every = learn.weighted_sum(encoding, {n: 0.05 for n in encoding.names}, 3.9)
    row = text.advice_text(make({"python_skill": 0, "dsa_skill": 0}), every, G).first()
    gains = [x for x in row["user_text"].split("\n") if x.startswith("option ")]
    assert len(gains) == 8 and all(" -> " in g and " adds " in g for g in gains)
    flat = learn.weighted_sum(encoding, {"cgpa": 0.0}, 3.0)
    row = text.advice_text(make({}), flat, G).first()
    assert row["user_text"].startswith("option = none\n")


def test_importance_text(spark):
    table = spark.createDataFrame(
        [(i + 1, f"f{i}", 1 / (i + 2)) for i in range(19)], "rank int, feature string, importance double"
    ).repartition(4)
    lines = text.importance_text(table).first()["user_text"].split("\n")
    assert lines[0] == "place 1 = f0, share 0.500000" and lines[9] == "place 10 = f9, share 0.090909" and len(lines) == 11


def test_pair_text(spark):
    scored = spark.createDataFrame(
        [("x", "IT", 8.0, 10.0), ("y", "EEE", 6.5, 12.5)], "student_id string, branch string, cgpa double, predicted_value double"
    )
    pairs = spark.createDataFrame([("x", "y"), ("y", "gone")], "a string, b string")
    rows = text.pair_text(score.pair_comparison(pairs, scored, G, ["branch", "cgpa"]), G, "cgpa").orderBy("a").collect()
    assert rows[0]["user_text"].split("\n")[:7] == [
        "distance = 2.50 LPA", "score a = 10.00 LPA", "Subject a = IT", "Mean grade a = 8.00",
        "score b = 12.50 LPA", "Subject b = EEE", "Mean grade b = 6.50",
    ]
    assert "score b = unknown LPA\nSubject b = unknown\nMean grade b = unknown" in rows[1]["user_text"]


def test_chat(spark, make):
    turns = spark.createDataFrame(
        [(1, 1, "assistant", "hello"), (1, 0, "user", "hi"), (2, 0, "user", "why?")],
        "conv_id int, turn int, role string, text string",
    )
    sentence = text.overview_sentence(make({"salary_lpa": 10.0}, {"salary_lpa": 20.0}, {"placed": 0}), G)
    rows = text.chat_context(turns, sentence.scalar()).orderBy("conv_id").collect()
    assert [r["user_text"][:4] for r in rows] == ["hi\n\n", "why?"]
    assert rows[0]["user_text"].endswith(
        "\n\nrows = 3\nconverted = 66.7 in 100\nlowest = 10.00 LPA\nmean = 15.00 LPA\nhighest = 20.00 LPA"
    )
    silent = spark.createDataFrame([(1, 0, "user", None)], turns.schema)
    assert text.chat_context(silent, sentence.scalar()).first()["user_text"].startswith("\n\nrows = 3")
    assert {r["system_text"] for r in rows} == {text.CHAT_SYSTEM}
    more = spark.createDataFrame([("later", "assistant", 1, 2)], "text string, role string, turn int, conv_id int")
    replay = text.chat_replay(text.append_turns(turns, more)).collect()
    assert [(r["conv_id"], r["turn"], r["text"]) for r in replay] == [
        (1, 0, "hi"), (1, 1, "hello"), (2, 0, "why?"), (2, 1, "later"),
    ]


def test_context_of_an_empty_cohort(spark, make):
    turns = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id int, turn int, role string, text string")
    sentence = text.overview_sentence(make({}).where("false"), G)
    assert text.chat_context(turns, sentence.scalar()).first()["user_text"] == "hi"


def test_context_needs_no_join(spark, make):
    turns = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id int, turn int, role string, text string")
    df = text.chat_context(turns, text.overview_sentence(make({}), G).scalar())
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]

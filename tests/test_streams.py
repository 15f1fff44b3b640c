from pyspark.sql import functions as F

from cohortlab import GRADUATES as G
from cohortlab.operators import cohorts, score, text
from cohortlab.plans.train import train
from cohortlab.streaming import streams


def test_stream_scores_equal_batch_scores(spark, graduates, tmp_path):
    model = train(graduates, G, tune=False, maxIter=4, maxDepth=3).model
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    half = F.col("student_id") < "S00400"
    columns = ["student_id", "predicted_log", "predicted_value"]

    def run():
        arriving = streams.file_stream(spark, folder, "*.parquet", G.schema, files=1)
        streams.start(streams.score_stream(arriving, model, G), out, state).awaitTermination()
        return spark.read.parquet(out).select(columns).orderBy("student_id").collect()

    graduates.where(half).repartition(3).write.parquet(folder)
    batch = score.predict(graduates, model, G).select(columns)
    assert run() == batch.where(half).orderBy("student_id").collect()
    # Only the new files are scored when the query starts again.
    graduates.where(~half).write.mode("append").parquet(folder)
    assert run() == batch.orderBy("student_id").collect()


def test_incomplete_rows_are_filled(spark, graduates, make, tmp_path):
    model = train(graduates, G, tune=False, maxIter=3, maxDepth=3).model
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    make({"cgpa": None, "branch": None}, {}).write.parquet(folder)
    arriving = streams.file_stream(spark, folder, "*.parquet", G.schema)
    streams.start(streams.score_stream(arriving, model, G), out, state).awaitTermination()
    rows = spark.read.parquet(out).orderBy("student_id").collect()
    assert [r["n_filled"] for r in rows] == [2, 0]
    assert rows[0]["predicted_value"] == rows[1]["predicted_value"]


def test_context_stream_equals_batch(spark, graduates, tmp_path):
    turns = spark.createDataFrame(
        [(i // 4, i % 4, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(40)],
        "conv_id int, turn int, role string, text string",
    )
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    turns.write.parquet(folder)
    sentence = F.lit(text.overview_sentence(graduates, G).first()["sentence"])
    arriving = streams.file_stream(spark, folder, "*.parquet", turns.schema)
    streams.start(streams.context_stream(arriving, sentence), out, state).awaitTermination()
    got = spark.read.parquet(out).orderBy("conv_id", "turn").collect()
    assert got == text.chat_context(turns, sentence).orderBy("conv_id", "turn").collect() and len(got) == 20


def test_overview_goes_on_after_a_restart(spark, graduates, tmp_path):
    """Three runs of one query: each adds its new files to what the runs before have counted, once."""
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    for part in range(3):
        rows = graduates.where(F.pmod(F.xxhash64("student_id"), F.lit(3)) == part)
        rows.repartition(2).write.mode("append").parquet(folder)
        arriving = streams.file_stream(spark, folder, "*.parquet", G.schema, files=1)
        report = streams.overview_so_far(arriving, G, state).collect()
        so_far = graduates.where(F.pmod(F.xxhash64("student_id"), F.lit(3)) <= part)
        assert report == cohorts.overview(so_far, G).drop("median_target").collect()
    # Nothing new has arrived.
    assert streams.overview_so_far(streams.file_stream(spark, folder, "*.parquet", G.schema), G, state).count() == 0


def test_append_twice_is_append_once(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    path = str(tmp_path / "turns")
    first = [(1, 0, "user", "a"), (1, 1, None, None), (1, 1, None, None)]
    second = [(1, 2, "assistant", None), (2, 0, None, "")]
    frames = {0: spark.createDataFrame(first, schema), 7: spark.createDataFrame(second, schema)}
    for batch in (0, 7, 7, 0):
        streams.append_batch(frames[batch], path, batch)
    got = streams.appended(spark, path, frames[0].schema)
    assert got.columns == ["conv_id", "turn", "role", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(first + second, key=str)
    replay = text.chat_replay(got).collect()
    assert [(r["conv_id"], r["turn"]) for r in replay] == [(1, 0), (1, 1), (1, 1), (1, 2), (2, 0)]


def test_table_in_parts_arrives_whole(spark, tmp_path):
    """A table may be one file or a folder of part files."""
    turns = spark.createDataFrame([(i, 0, "user", f"t{i}") for i in range(6)], "conv_id int, turn int, role string, text string")
    turns.repartition(3).write.parquet(f"{tmp_path}/parts/turns.parquet")
    turns.coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "one" / "turns.parquet")
    for kind in ("parts", "one"):
        out, state = (str(tmp_path / f"{kind}-{n}") for n in ("out", "state"))
        arriving = streams.table_stream(spark, str(tmp_path / kind), "turns", turns.schema)
        streams.start(arriving, out, state).awaitTermination()
        assert spark.read.parquet(out).orderBy("conv_id").collect() == turns.orderBy("conv_id").collect()

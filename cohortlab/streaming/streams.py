"""Scoring profiles and adding context to chat turns as they arrive, and an overview that moves with the rows."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cohortlab.operators.clean import default_fill
from cohortlab.operators.cohorts import running_overview
from cohortlab.operators.score import predict
from cohortlab.operators.text import chat_context
from cohortlab.session import is_folder
from cohortlab.spec import CohortSpec


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, files: int = 1000) -> DataFrame:
    """New Parquet files of a folder; ``files`` bounds one micro-batch, not the whole input."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files)
        .parquet(folder)
    )


def table_stream(spark: SparkSession, folder: str, table: str, schema) -> DataFrame:
    """The Parquet files of a table, which is a file of ``folder`` or a folder of part files in it."""
    path = f"{folder}/{table}.parquet"
    if is_folder(spark, path):
        return file_stream(spark, path, "*", schema)
    return file_stream(spark, folder, f"{table}.parquet", schema)


def start(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to a Parquet folder; with ``once`` everything available is read and the query ends."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def score_stream(profiles: DataFrame, model: PipelineModel, spec: CohortSpec) -> DataFrame:
    """Missing features get their defaults, as one incomplete row must not end the stream."""
    filled = default_fill(profiles, spec)
    scored = predict(filled, model, spec)
    return scored.select(spec.id, "predicted_log", "predicted_value", "n_filled")


def context_stream(turns: DataFrame, sentence: Column) -> DataFrame:
    """``sentence`` is a literal or a scalar of a static table."""
    return chat_context(turns, sentence)


def overview_so_far(profiles: DataFrame, spec: CohortSpec, checkpoint: str) -> DataFrame:
    """One row: the overview of everything that has arrived so far, this run's rows included.

    The sums are the state of the query and live in ``checkpoint``; a run that starts again goes on from them and reads
    new files only, so no row counts twice. Only the one row of results is held by the driver. No row if nothing has
    arrived since the last run, whose report still holds.
    """
    name = f"overview_{uuid.uuid4().hex}"
    report = running_overview(profiles, spec)
    query = (
        report.writeStream.format("memory").queryName(name).outputMode("complete")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return profiles.sparkSession.table(name)


# Appends that can be repeated


def append_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Append ``rows`` under the number of their batch. A batch that is written again, by a repeated or restarted job,
    takes the place of its first writing, so no row is there twice. Rows keep their columns, nulls included."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={int(batch)}")


def appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches, in no order."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)

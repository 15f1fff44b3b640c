"""From raw documents to token ids: quality rules, near-duplicate removal, pseudonyms, source mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm import hyperminhash, mixing, pieces, pseudonyms, rules
from cohortlab.llm.tables import field, read
from cohortlab.session import new_folder, passing_folders, remove_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned rules reject."""
    return rules.good_documents(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 80 %)."""
    return hyperminhash.one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format."""
    return pseudonyms.pseudonymise(docs).select(*map(field, docs.columns))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's target asks for."""
    return mixing.mix(docs).select(*map(field, docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the byte of the text at which each piece ends."""
    return pieces.encode_texts(docs, digests=True)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("mixing", mixing_sources),
    ("sentencepiece", encoding),
]
# The learned rules, the banding and the library's pieces are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. What a stage wrote for itself, and what it read, goes once its result is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        with passing_folders(spark):
            made = stage(spark, docs, sf_dir)
            made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before is not None:
            remove_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

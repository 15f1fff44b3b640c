"""The registered queries of this package, one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm import (
    brown, chat, hyperminhash, lines, mixing, multiset, nbsvm, pieces, prefixes, pseudonyms, resampling, rules, urls,
)
from cohortlab.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


@query
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_documents(read(spark, folder, "documents"))


@query
def op3_hyperminhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return hyperminhash.near_duplicates(read(spark, folder, "documents"), words=4)


@query
def op2_brown_scores(spark: SparkSession, folder: str) -> DataFrame:
    return brown.score_texts(read(spark, folder, "documents"))


@query
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = chat.with_trap(spark, read(spark, folder, "conversations"))
    return chat.read_back(chat.format_turns(turns))


@query
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_texts(read(spark, folder, "documents"), digests=True, ids=False)


@query
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(read(spark, folder, "pages"))


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = rules.judge(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept"
    )


@query
def op8_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.pseudonymise(read(spark, folder, "documents")).select("doc_id", "text", "n_values")


@query
def op9_repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.drop_repeats(read(spark, folder, "documents")).select("doc_id", "text", "n_removed", "spans")


@query
def op10_multiset_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return multiset.compare_with_next(read(spark, folder, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.shared_openings_trie(read(spark, folder, "conversations"))


@query
def op12_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def op13_quality_nbsvm(spark: SparkSession, folder: str) -> DataFrame:
    return nbsvm.classify(read(spark, folder, "documents"), read(spark, folder, "labels"))

"""Registered queries of the corpus operators, and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinfold.llm import comparison
from twinfold.llm.bag_minhash import near_documents
from twinfold.llm.bpe import round_trips
from twinfold.llm.common import table
from twinfold.llm.context_mixing import score_texts
from twinfold.llm.decontaminate import find_leaks
from twinfold.llm.filter_audit import filter_audit
from twinfold.llm.packing import pack_documents
from twinfold.llm.ranked_search import ranked_documents
from twinfold.llm.secrets import secret_report
from twinfold.llm.sharding import shard_documents
from twinfold.llm.suffix_automata import remove_passages
from twinfold.llm.suffix_buckets import remove_substrings
from twinfold.llm.toxicity import category_labels, score, train
from twinfold.llm.vectors import near_vectors


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents")).drop("key")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels, categories = category_labels(table(spark, sf_dir, "labels"))
    return score(docs, train(docs, labels, categories), categories)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_substrings(table(spark, sf_dir, "documents"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_sharding": op2_sharding,
    "op3_secret_scans": op3_secret_scans,
    "op4_toxicity": op4_toxicity,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_filter_interaction_audit": op11_filter_interaction_audit,
    "op12_ranked_lexical_search": op12_ranked_lexical_search,
    "op13_bpe_round_trip": op13_bpe_round_trip,
}

ORACLE: dict[str, str] = comparison.ORACLE

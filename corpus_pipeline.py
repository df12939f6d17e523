"""Corpus pipeline: documents to packed training sequences, in five stages.

Every stage takes (spark, docs, folder of the tables) and works on all documents that the stage before kept. Stages but
the last return the columns of ``documents``. ``run`` writes each stage as Parquet to the shared folder of the session
(``spark.checkpoint.dir``) and reads it again, so a lost executor costs the stage at hand only.

No comparison SQL: tokens, the fitted chain and BagMinHash are beyond it. ``tests/llm/test_pipeline.py`` holds every
stage against plain versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinfold.llm.bag_minhash import deduplicate
from twinfold.llm.common import table
from twinfold.llm.decontaminate import without_leaks
from twinfold.llm.packing import pack_documents
from twinfold.llm.secrets import mask_secrets
from twinfold.llm.toxicity import category_labels, reject, train
from twinfold.session import ensure_checkpoint_dir

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones among them, does not reject."""
    labels, categories = category_labels(table(spark, sf_dir, "labels"))
    return reject(docs, train(docs, labels, categories))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of every group of near duplicates."""
    return deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or edited."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with values that look like live credentials of their owner masked."""
    return mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", mask_live_secrets),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

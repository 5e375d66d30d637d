"""The training-data pipeline: each stage reads what the one before wrote.

Quality classifier, near-duplicates, repeated passages, mixing of sources, sampled segmentations.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import mixing, near_dups, quality, segmentations, suffix_dups
from shelfmark.llm.common import read_table
from shelfmark.llm.settings import KEPT_SCORE, MIX, PIECES, SAMPLES
from shelfmark.session import ensure_checkpoint_dir, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches ``KEPT_SCORE``; the labels of the data set teach the scores."""
    stats = stored(quality.document_statistics(docs))
    model = quality.fit(stats, read_table(spark, sf_dir, "labels"))
    score = "__quality_score"  # a name that the documents may not have
    return quality.score_texts(docs, model, into=score).where(F.col(score) >= KEPT_SCORE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dups.keep_one_of_each(docs, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that start earlier."""
    return suffix_dups.without_repeats(docs, length=100)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate draws, in a random order."""
    return mixing.mix_sources(docs, **MIX).select(*docs.columns)


def sampled_segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the sampled segmentations of each document."""
    return segmentations.digests(segmentations.sample_segmentations(docs, PIECES, **SAMPLES))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mixture),
    ("SentencePiece encoding and decoding", sampled_segmentations),
]

#: Learning, sketches and sampling can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tables/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs

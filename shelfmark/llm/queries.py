"""Registered queries of the operators, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import captures, collocations, fingerprints, main_text, mixing, near_dups, nearest, quality, segmentations, suffix_dups, token_counts, toxicity, vector_codes
from shelfmark.llm.common import read_table
from shelfmark.llm.settings import KEPT_SCORE, MIX, PIECES, SAMPLES, TOXIC_SCORE
from shelfmark.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op3_mixing", mixing.ORACLE.format(**MIX))
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, **MIX).withColumn("rate", F.round("rate", 6))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(quality.document_statistics(read_table(spark, sf_dir, "documents")))
    model = quality.fit(stats, read_table(spark, sf_dir, "labels"))
    return quality.score_statistics(stats, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= KEPT_SCORE, 1).otherwise(0).alias("predicted"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), PIECES, limit=4096)


@query("op9_near_duplicates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.link(read_table(spark, sf_dir, "documents"), percent=85)


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dups.remove_repeats(read_table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op5_main_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(read_table(spark, sf_dir, "pages"))


@query("op1_nearest")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op8_captures", captures.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = captures.archive(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read_table(spark, sf_dir, "documents"))


@query("op10_segmentations")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return segmentations.digests(segmentations.sample_segmentations(docs, PIECES, **SAMPLES))


@query("op11_toxicity")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", F.when(F.col("score") >= TOXIC_SCORE, 1).otherwise(0))


@query("op12_collocations", collocations.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"), least=30, most=2000)


@query("op13_vector_codes", vector_codes.oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(read_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)

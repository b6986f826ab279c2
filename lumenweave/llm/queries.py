"""One query for every operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm import bpe, class_lm, decontaminate, language_id, lexical_search, license_scan, pu_classifier, quality_rules, sharding, simhash, suffix_dedup, vector_codes, warc
from lumenweave.llm.common import id_crc, table
from lumenweave.llm.sql import SQL

RANKS = "byte_bpe_50k.tiktoken"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), 40)


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc(F.col("doc_id")) % 7 == 2
    corpus = class_lm.prepared(docs, ~held_out)
    scores = class_lm.scored(corpus, class_lm.fit(corpus))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_pu_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pu_classifier.prepared(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_crc(F.col("doc_id")) % 5 != 0)
    weights, _ = pu_classifier.fit(rows)
    return pu_classifier.scored(rows, weights).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), 100)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, shingle=4, seed=42)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out")
    model = language_id.fit(docs.where(id_crc(F.col("doc_id")) % 3 != 1))
    return language_id.identified(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op11_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.built(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 10)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_warc, op2_quality_rules, op3_decontaminate, op4_sharding, op5_class_lm, op6_pu_classifier,
        op7_suffix_dedup, op8_simhash, op9_byte_bpe, op10_language_id,
        op11_block_max, op12_vector_codes, op13_license_scan, pipeline,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return SQL

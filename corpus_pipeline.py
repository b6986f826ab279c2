"""From ``documents`` to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and returns a DataFrame that is written and read again as the next one's
docs; all but the last return the columns of ``documents``. Stages that drop documents decide by the text, and between copies by id, then text.

Defined cases: null, empty and letterless texts go in the first stage; of repeated rows one stays; rows with equal ids and different texts are documents of their own; null ids
stay, but don't stand for a group that has others; very long texts are treated whole; an empty table stays empty; other columns pass through under their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm import bpe, decontaminate, language_id, near_copies, suffix_dedup
from lumenweave.llm.common import shared_dir, table

#: No SQL: language scores, fingerprints, suffixes and token merges are beyond it. The tests compare the whole run with plain versions of the stages.
ORACLE_SQL = None


def _same(docs: DataFrame) -> Column:
    """Decisions hold for an id and the hash of a text: ids may be null, or of several texts."""
    return docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_th"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (null, empty, numerals) go, and no others: scores are relative to the learned languages, so the best of them is no
    evidence that a text is in any, and no threshold was measured that would be. The labelled texts train the model."""
    return language_id.with_language(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more, over any number of links), only the document with the smallest id stays,
    or of null ids alone the text with the smallest hash; of rows with the same id and text one stays."""
    found = near_copies.near_copies(docs.select("doc_id", "text"))
    kept = found.where("keep").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    return docs.join(kept, _same(docs), "left_semi").withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the text."""
    kept = suffix_dedup.with_kept_text(docs, 100)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of byte-level BPE, as count and digest, with the digest of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""A passage in a third of all texts, with other words around it, is spread over tasks."""

import numpy as np
from pyspark.sql import functions as F

from lumenweave.llm import suffix_dedup
from tests.llm import brute


def test_a_hot_passage_is_in_no_task_alone(spark):
    rng = np.random.default_rng(2)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n))
    passage = words(16)[:110]
    docs = [(i, f"{words(3)} {passage} {words(3)}" if i % 3 == 0 else words(20)) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    texts = suffix_dedup.keyed(df)
    assert len(suffix_dedup.hot_grams(texts, 100))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = sorted(r["count"] for r in suffix_dedup._dealt(texts, 100).groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] < 2 * sum(sizes) / len(sizes)
        got = sorted(tuple(r) for r in suffix_dedup.deduplicated(df, 100).collect())
        assert got == sorted(tuple(r) for r in suffix_dedup.deduplicated(df, 100, group_rows=500).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(brute.repeats(docs)) and sum(r[2] > 0 for r in got) == 1999

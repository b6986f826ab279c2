"""Sharding by a keyed permutation of global row numbers.

Rows are numbered from 0 in id order. A Feistel network over the smallest even-width bit domain that holds all numbers, walked
along its cycles until it lands inside, permutes them: ``position = permute(number)``, shard ``position % shards``, slot
``position // shards``. Anyone who knows the number of rows and the key computes where a row is, and ``invert`` computes which row
lies in a slot, without a table. Shard sizes differ by one row at most.

Defined cases: null text counts as no bytes; null ids come first; rows with equal ids are ordered by their text's checksum and size,
so only identical rows are interchangeable; an empty table gives an empty table; texts of any length count by their bytes alone; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.llm.common import written

ROUNDS, KEY = 6, 20260101


def round_keys(key: int) -> list[int]:
    return [xxhash.xxh64_intdigest(str(i), seed=key) for i in range(ROUNDS)]


def _mixed(half: np.ndarray, key: int) -> np.ndarray:
    x = half ^ np.uint64(key)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def _walk(numbers: np.ndarray, rows: int, key: int, backwards: bool) -> np.ndarray:
    half = max(1, ((rows - 1).bit_length() + 1) // 2)
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    keys = round_keys(key)
    out = np.asarray(numbers, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for k in reversed(keys) if backwards else keys:
            if backwards:
                left, right = right ^ (_mixed(left, k) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, k) & mask)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= rows]
    return out.astype(np.int64)


def permute(numbers: np.ndarray, rows: int, key: int) -> np.ndarray:
    return _walk(numbers, rows, key, False)


def invert(positions: np.ndarray, rows: int, key: int) -> np.ndarray:
    return _walk(positions, rows, key, True)


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``row_number``, gapless from 0 in this order, and the count of rows. Only one count per partition reaches the driver."""
    df = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = df.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), "_n")
    rows = before.agg(F.sum("_n")).first()[0] or 0
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    return df.withColumn("_part", part).join(before.drop("_n"), "_part").withColumn("row_number", F.col("_before") + inside).drop("_part", "_before", "_at"), rows


def sharded(docs: DataFrame, shards: int = 40, key: int = KEY) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes and 16), text_crc32, law ``rows``, shard, slot, grown_shard (null), row_number."""
    if shards < 1:
        raise ValueError("at least one shard")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows, count = numbered(narrow, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def position(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), count, key))

    placed = rows.withColumn("_p", position("row_number"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"), F.floor(F.col("_p") / shards).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")

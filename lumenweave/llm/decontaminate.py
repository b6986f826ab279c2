"""Benchmark decontamination by winnowing.

Both sides keep the least hash of every run of nine consecutive five-word grams, so any thirteen words in common have a kept hash in
common. The kept hashes, the fingerprints, are joined; each hit is then extended to the up to nine windows around it, whose 128-bit digests are
joined to those of the benchmark's windows. Benchmark texts shorter than a window are matched whole, by hashes of all runs of their length.
Documents send to the join only fingerprints whose place in a bit map of the benchmark's is set: the map has 16 places a fingerprint, 16 megabytes at
most, and lets no true hit out; beyond that size it merely filters less.

No text leaves its task. Windows with the same set of items form a class, and documents carry classes, not items: item lists are made once for each
set of classes that occurs. Equal texts share one verdict, whatever their ids and number.

Defined cases: null, empty or wordless texts have no words and no hits; wordless benchmark texts and null item ids are no items; texts under one item
id are one item; repeated rows get the same verdict each; a benchmark with no rows contaminates nothing and no documents give no rows. Very long texts
are laid out one at a time. Other columns of ``docs`` don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.common import by_bytes, written

#: Words are runs of letters and digits of ASCII, A-Z lower-cased, and of all bytes beyond it.
WINDOW, GRAM, MOST_BITS = 13, 5, 27
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_APART = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=3) | 1 for b in range(256)], dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word of the texts, and the number of its text."""
    data = _LOWER[np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", dtype=np.uint8)]
    inside = _IS_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = ends - starts
    first = np.cumsum(width) - width
    place = np.arange(int(width.sum())) - np.repeat(first, width)
    powers = np.cumprod(np.full(int(width.max()), _ODD), dtype=np.uint64)
    hashes = _mixed(np.add.reduceat(_BYTE[data[inside]] * powers[place], first))
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(begins, starts, side="right") - 1


def run_hashes(hashes: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every run of ``length`` words, and whether the run stays in one text."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total, factor = np.zeros(n, np.uint64), _ODD
    for i in range(length):
        total += hashes[i : i + n] * factor
        factor = np.uint64(int(factor) * int(_ODD) & 0xFFFFFFFFFFFFFFFF)
    return _mixed(total), text[:n] == text[length - 1 :]


def winnowed(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of the grams that are least in some window."""
    grams, _ = run_hashes(hashes, text, GRAM)
    span = WINDOW - GRAM + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(grams, span).min(axis=1)
    least[text[:n] != text[WINDOW - 1 : WINDOW - 1 + n]] = 0  # windows that leave their text select nothing
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    most = np.lib.stride_tricks.sliding_window_view(padded, span).max(axis=1)
    return np.flatnonzero((most == grams) & (grams > 0))


def prints(texts: list[bytes], short: list[int] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Run length (WINDOW for windows), fingerprints, their texts, and the word each begins at. short: lengths to take all runs of; None: each short text whole."""
    hashes, text = word_hashes(texts)
    begins = np.searchsorted(text, np.arange(len(texts)))
    counts = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
    for length in range(1, WINDOW) if short is None else short:
        runs, same = run_hashes(hashes, text, length)
        of = text[: len(runs)]
        at = np.flatnonzero(same & (counts[of] == length) if short is None and len(runs) else same)
        yield length, runs[at], of[at], at - begins[of[at]]
    at = winnowed(hashes, text)
    grams, _ = run_hashes(hashes, text, GRAM)
    yield WINDOW, grams[at], text[at], at - begins[text[at]]


def slices(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``size`` bytes together, and the number of the first: what is laid out in arrays stays small."""
    first, count = 0, 0
    for i, text in enumerate(texts):
        count += len(text) + 1
        if count >= size:
            yield first, texts[first : i + 1]
            first, count = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def split(text: bytes) -> list[bytes]:
    return text.lower().translate(_APART).split()


def digest(words: list[bytes]) -> tuple[int, int]:
    """Two longs that tell runs of words apart."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(b" ".join(words)))


def _rows(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: pa.array(x, kind) for (name, kind), x in zip(names.items(), zip(*rows, strict=True) if rows else [()] * len(names), strict=True)})


def item_windows(items: DataFrame) -> DataFrame:
    """d1, d2, item_id of every window of the items; a window may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = split(text.encode())
                n = min(WINDOW, len(own))
                found = {digest(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
                yield _rows({"d1": pa.int64(), "d2": pa.int64(), "item_id": pa.string()}, [(*d, item_id) for d in found])

    return items.mapInArrow(run, "d1 long, d2 long, item_id string")


def item_prints(items: DataFrame) -> DataFrame:
    """length, hash of every fingerprint of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices([t.encode() for t in batch["text"].to_pylist()]):
                for length, hashes, _, _ in prints(part, None):
                    yield pa.RecordBatch.from_pydict({"length": pa.array([length] * len(hashes), pa.int32()), "hash": hashes.view(np.int64)})

    return items.mapInArrow(run, "length int, hash long").distinct()


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Packed bits, set at the hashes' places; put together by the executors, so that the driver gets its words, two megabytes of rows at most."""
    bits = min(MOST_BITS, max(16, (16 * hashes.count()).bit_length()))
    slot = F.col("hash").bitwiseAND((1 << bits) - 1)
    word, bit = F.shiftright(slot, 6), F.expr(f"shiftleft(1L, CAST((hash & {(1 << bits) - 1}) % 64 AS INT))")
    words = np.zeros(1 << (bits - 6), np.int64)
    for rows in hashes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        words[rows["word"]] = rows["bits"]
    return words


def text_key() -> list[Column]:
    """Two hashes that tell texts apart."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def window_hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """h1, h2, at, n, d1, d2 of the windows of ``docs`` that have a fingerprint of an item, and d1, d2, item_id of the items' windows."""
    known = written(item_prints(items), "item-prints")
    short = sorted(r["length"] for r in known.where(F.col("length") < WINDOW).select("length").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(known))
    names = {"length": pa.int32(), "hash": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "at": pa.int32(), "n": pa.int32(), "d1": pa.int64(), "d2": pa.int64()}

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        mask = np.uint64(64 * len(words) - 1)
        for batch in by_bytes(batches):
            keys = np.stack([batch["h1"].to_numpy(), batch["h2"].to_numpy()], axis=1)
            once = np.sort(np.unique(keys, axis=0, return_index=True)[1])
            texts = [t.encode() for t in batch["text"].take(pa.array(once)).to_pylist()]
            for first, part in slices(texts):
                cut: dict[int, list[bytes]] = {}
                rows: list[tuple] = []
                for length, hashes, text, at in prints(part, short):
                    slot = (hashes & mask).astype(np.int64)
                    for k in np.flatnonzero(words[slot >> 6] >> (slot & 63) & 1).tolist():
                        i, place = int(text[k]), int(at[k])
                        if i not in cut:
                            cut[i] = split(part[i])
                        own = cut[i]
                        reach = range(max(0, place - (WINDOW - GRAM)), min(place, len(own) - WINDOW) + 1) if length == WINDOW else [place]
                        rows += [(length, int(hashes.view(np.int64)[k]), *keys[once[first + i]].tolist(), a, length, *digest(own[a : a + length])) for a in reach]
                        if len(rows) > 20_000:
                            yield _rows(names, rows)
                            rows = []
                yield _rows(names, rows)

    kind = "length int, hash long, h1 long, h2 long, at int, n int, d1 long, d2 long"
    hits = docs.where("text IS NOT NULL").select("text", *text_key()).mapInArrow(around, kind).join(known, ["length", "hash"], "left_semi").select("h1", "h2", "at", "n", "d1", "d2")
    return hits, written(item_windows(items), "item-windows")


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()


def n_hit(spans: Column) -> Column:
    """Words that an array of places and lengths covers."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def covered(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], x["at"] + x["n"])
        return F.struct(end.alias("end"), (acc["total"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["at"]))).alias("total"))

    return F.aggregate(F.sort_array(spans), start, covered, lambda acc: acc["total"])


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """h1, h2, n_hit, n_items, items_sha256 of the texts of ``docs`` that have hits."""
    hits, windows = window_hits(docs, items_of(benchmark))
    windows = windows.distinct()
    sets = windows.groupBy("d1", "d2").agg(F.expr("bit_xor(xxhash64(item_id))").alias("c1"), F.expr("bit_xor(xxhash64(1, item_id))").alias("c2"))
    found = hits.join(sets, ["d1", "d2"]).groupBy("h1", "h2").agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.collect_set(F.struct("c1", "c2")).alias("classes"))
    found = written(found.select("h1", "h2", n_hit(F.col("spans")).alias("n_hit"), F.sort_array("classes").alias("classes")).withColumn("several", F.md5(F.to_json("classes"))), "hits")
    several = found.groupBy("several").agg(F.first("classes").alias("classes")).select("several", F.explode("classes").alias("c")).select("several", "c.c1", "c.c2")
    of_class = windows.join(sets.join(several.select("c1", "c2").distinct(), ["c1", "c2"], "left_semi"), ["d1", "d2"]).select("c1", "c2", "item_id").distinct()
    lists = several.join(of_class, ["c1", "c2"]).groupBy("several").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    lists = lists.select("several", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return found.join(lists, "several").select("h1", "h2", "n_hit", "n_items", "items_sha256")


def n_words() -> Column:
    """Splitting bytes takes a third of the engine's regular expressions' time. Declared as not deterministic, as the optimizer would else run it once more for a
    filter that it derives from what its result is compared with."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(t.encode().translate(_APART).split()) for t in texts], dtype="int64")

    return count.asNondeterministic()(F.coalesce("text", F.lit(""))).alias("n_words")


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = docs.select("doc_id", *text_key(), n_words()).join(verdicts(docs, benchmark), ["h1", "h2"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = out.select("doc_id", "n_words", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")), F.coalesce("items_sha256", none).alias("items_sha256"))
    return out.withColumn("contaminated", F.expr(CONTAMINATED))


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated; rows with null texts stay."""
    hits, windows = window_hits(docs, items_of(benchmark))
    found = hits.join(windows.select("d1", "d2").distinct(), ["d1", "d2"], "left_semi").groupBy("h1", "h2").agg(n_hit(F.collect_set(F.struct("at", "n"))).alias("n_hit"))
    bad = docs.where("text IS NOT NULL").select(*text_key(), n_words()).distinct().join(found, ["h1", "h2"]).where(CONTAMINATED).select("h1", "h2")
    return docs.join(bad, (F.xxhash64(docs["text"]) == bad["h1"]) & (F.xxhash64(F.lit(1), docs["text"]) == bad["h2"]), "left_anti")

"""SimHash near-duplicates, with pivot distance tables.

Fingerprints are 64 bits over word shingles. Copies of a text collapse into one fingerprint first, so the search runs
over distinct fingerprints only. Two blocks more than the radius leave at least two blocks equal, and so on: the choices of
so many blocks deal fingerprints into cells where every linked pair meets. The number of blocks follows the number of fingerprints (six for radius 4 up
to some millions), so that cells stay small as the corpus grows. Inside a cell, distances to many
reference fingerprints are tabled once; by the triangle inequality a pair whose coordinates differ by more than the
radius in any pivot is no link, and only the rest is verified bit by bit. A cell hands on a spanning forest of its links,
never its pairs. Cells above ``cell_rows`` are dealt out once more, by blocks of the bits that their key leaves open; only what is
still above it, prints that agree in both keys, is cut into chunks that meet pair by pair in tasks of their own.

Defined cases: no documents give no rows; other columns, whatever their names, are not read; very long texts are hashed in parts; null or wordless text has fingerprint 0 and is linked as any other; texts of fewer words than a shingle hash
their whole word sequence; rows with a null id get a component but never name one; repeated rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.common import by_groups, written

PIVOTS = np.array([xxhash.xxh64_intdigest(str(i), seed=7) for i in range(16)], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, width = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(width + 1) - 1
    starts = ends - width
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    spans = list(zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True))
    for at in range(0, len(spans), 1 << 16):
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans[at : at + (1 << 16)]], dtype="<u8")
        total += bit_counts(hashes)
    return majority(total, len(spans))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of some 64-bit hashes each bit is set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes: the bits set in over half of them."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", fp(F.coalesce("text", F.lit(""))).alias("fp"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(blocks: int, radius: int, bits: Sequence[int] = range(64)) -> list[int]:
    """Every choice of ``blocks`` - ``radius`` of so many nearly equal blocks of ``bits``: a pair within the radius is equal in one of them."""
    own = [sum(1 << bit for bit in bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks]) for i in range(blocks)]
    return [_signed(sum(chosen)) for chosen in combinations(own, blocks - radius)]


def best_blocks(rows: int, radius: int) -> int:
    """The number of blocks with the least work for so many fingerprints: more blocks make more tables, of smaller cells. A row that is dealt out counts as ten pairs."""
    return min(range(radius + 2, radius + 6), key=lambda b: comb(b, radius) * (10 * rows + rows**2 / 2 ** (64 * (b - radius) // b + 1)))


def spanning_edges(cell: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each cell. Rows are sorted by cell; fingerprints of a cell are distinct."""
    n = len(fps)
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    parent, alive, step = np.arange(n), np.arange(n - 1), 0
    while True:
        step += 1
        alive = alive[alive < n - step]
        alive = alive[cell[alive] == cell[alive + step]]
        if not len(alive):
            break
        left = alive
        for pivot in range(len(PIVOTS)):
            left = left[np.abs(table[left, pivot] - table[left + step, pivot]) <= radius]
            if len(left) < 32:
                break
        left = left[np.bitwise_count(fps[left] ^ fps[left + step]) <= radius]
        if len(left):
            root = _roots(parent)
            for a, b in zip(*(x[root[left] != root[left + step]].tolist() for x in (left, left + step)), strict=True):
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
    parent = _roots(parent)
    moved = np.flatnonzero(parent != np.arange(n))
    return fps[moved], fps[parent[moved]]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent[:] = above


def _cut(rows: DataFrame, chosen: list[int], radius: int, cell_rows: int) -> DataFrame:
    """Cells that are too large, dealt out again by blocks of the bits that their key leaves open. What is too large even then goes in chunks that meet in pairs."""
    spark = rows.sparkSession
    open_bits = [[bit for bit in range(64) if not mask >> bit & 1] for mask in chosen]
    finer = [(t, s + 1, mask) for t, bits in enumerate(open_bits) for s, mask in enumerate(masks(radius + 2, radius, bits))]
    again = rows.join(F.broadcast(spark.createDataFrame(finer, "t int, s int, mask long")), "t")  # a row a pair of choices: 225 for a radius of 4
    again = written(again.select("t", "key", "s", F.col("fp").bitwiseAND(F.col("mask")).alias("finer"), "fp"), "finer-cells")
    cell = ["t", "key", "s", "finer"]
    parts = again.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select(*cell, F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"))
    chunked = again.join(parts, cell, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    return chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*cell, F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "fp")


def links(nodes: DataFrame, radius: int = 4, cell_rows: int = 20_000) -> DataFrame:
    """Edges ``u``, ``v`` between distinct fingerprints ``fp`` of ``nodes`` whose components are those of all links."""
    if not 0 <= radius <= 16:
        raise ValueError("radius 0 to 16")
    nodes = written(nodes, "nodes")
    chosen = masks(best_blocks(nodes.count(), radius), radius)
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(chosen))))
    dealt = nodes.select("fp", cells.alias("c")).select("fp", "c.t", "c.key")
    keys = ["t", "key", "s", "finer", "a", "b"]
    whole = [F.lit(0).alias(name) for name in keys[2:]]
    large = written(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select("t", "key", F.lit(True).alias("large")), "large-cells")
    if large.isEmpty():
        met = dealt.select("t", "key", *whole, "fp")
    else:
        told = dealt.join(large, ["t", "key"], "left")
        met = told.where("large IS NULL").select("t", "key", *whole, "fp").unionByName(_cut(told.where("large"), chosen, radius, cell_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_groups(keys, 200_000)(batches):
            fps, new = rows["fp"].to_numpy().view(np.uint64), np.zeros(rows.num_rows, bool)
            for key in keys:
                values = rows[key].to_numpy()
                new[1:] |= values[1:] != values[:-1]
            u, v = spanning_edges(np.cumsum(new), fps, radius)
            yield pa.RecordBatch.from_pydict({"u": u.view(np.int64), "v": v.view(np.int64)})

    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame, file_rows: int = 200_000) -> DataFrame:
    """``node``, ``root``: the smallest node reachable, for each node of an edge. Alternates large and small stars; each round's edges are a written table, in files
    of about ``file_rows`` rows, however many tasks made them."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")

    def state(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small.coalesce(max(2, -(-before[0] // file_rows))), "edges")
        now = state(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, cell_rows: int = 20_000) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest id linked, over any number of links)."""
    prints = written(with_fingerprints(docs, shingle, seed), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes.select("fp"), radius, cell_rows))
    named = nodes.join(found, nodes.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

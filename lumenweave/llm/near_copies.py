"""Near copies by SimHash and pivots, of word shingles, verified exactly by Jaccard similarity.

Texts are sets of the 64-bit hashes of their runs of ``SHINGLE`` words; equal sets collapse into one node first. Nodes' SimHash fingerprints are searched as
those of ``simhash``, by bit blocks and tables of distances to pivots, and what links of ``RADIUS`` bits or fewer connect is a cell: no pair within the radius
is lost. A pair of Jaccard 0.8 differs in some ten bits, though, and a radius that holds nearly all such pairs (twenty) holds one random pair in 800 as
well. So the pairs beyond the radius are met by least hashes: a node's 96 least permuted hashes are cut into 24 bands of four, and equal bands deal nodes into
cells; a pair of Jaccard 0.8 misses all of these with probability (1 - 0.8^4)^24 = 3e-6. Cells of the same members are read once. Inside a cell pairs of different sizes or, by the triangle inequality of the Jaccard distance, of different
distances to the cell's pivots are no links; all others that are not yet connected are compared set by set. Cells above ``cell_size`` shingles are cut
into chunks that meet pair by pair in tasks of their own. A cell hands on a spanning forest of its links, never its pairs.

Defined cases: null and wordless texts are one empty set and near copies of each other; texts of fewer words than a shingle are their whole word
sequence; rows with a null id get a component but never name one; repeated rows share it; an empty table gives no rows; very long texts are hashed whole, one at a time; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.llm import simhash
from lumenweave.llm.common import by_bytes, by_groups, written
from lumenweave.llm.simhash import components

SHINGLE, RADIUS, BANDS, ROWS, PIVOTS = 5, 6, 24, 4, 8
_ODD = np.array([xxhash.xxh64_intdigest(str(i), seed=11) | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)
_ADD = np.array([xxhash.xxh64_intdigest(str(i), seed=12) for i in range(BANDS * ROWS)], dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, width = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(width + 1) - 1
    starts, digest, n = ends - width, xxhash.xxh64_intdigest, min(SHINGLE, len(words))
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64))


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles; zero for the empty set."""
    counts = sum((simhash.bit_counts(hashes[at : at + (1 << 16)]) for at in range(0, len(hashes), 1 << 16)), np.zeros(64, np.int64))
    return simhash.majority(counts, len(hashes))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; none for the empty set, which is a node of its own."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[None, at : at + 2048] * _ODD[:, None] + _ADD[:, None]).min(axis=1), out=least)
    mixed = (least ^ (least >> np.uint64(31))) * _ODD
    return mixed.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of Jaccard 0.8 or more that connect what all such links between the sets connect."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    ends = np.cumsum(sizes)
    root, mask, table, edges = np.arange(len(sets)), np.zeros(int(tokens.max()) + 1, bool), [], []
    for i in range(len(sets) - 1):
        able = (root != root[i]) & (5 * np.minimum(sizes, sizes[i]) >= 4 * np.maximum(sizes, sizes[i]))
        able[: i + 1] = False
        for away in table:
            able &= np.abs(away - away[i]) <= 0.2 + 1e-9
        pivot = len(table) < PIVOTS and bool(able.any())
        others = np.arange(len(sets)) if pivot else np.flatnonzero(able)
        if not len(others):
            continue
        mask[tokens[ends[i] - sizes[i] : ends[i]]] = True
        part = tokens if pivot else np.concatenate([tokens[ends[j] - sizes[j] : ends[j]] for j in others.tolist()])
        both = np.add.reduceat(mask[part], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        mask[tokens[ends[i] - sizes[i] : ends[i]]] = False
        if pivot:
            table.append(1 - both / (sizes + sizes[i] - both))
        for j in others[able[others] & (9 * both >= 4 * (sizes[others] + sizes[i]))].tolist():
            if root[j] != root[i]:
                edges.append((i, j))
                root[root == root[j]] = root[i]
    return edges


def alike(prints: DataFrame) -> DataFrame:
    """``fp``, ``root``: for each fingerprint within the radius of another one, what stands for all that such links connect. The empty set has none."""
    return components(simhash.links(prints.where("size > 0").select("fp").distinct(), RADIUS)).select(F.col("node").alias("fp"), "root")


def links(docs: DataFrame, prints: DataFrame, cell_size: int) -> DataFrame:
    """Edges ``u``, ``v`` between nodes whose components are those of all verified links."""
    nodes = prints.where("size > 0").groupBy("node").agg(F.min("th").alias("th"), *(F.first(c).alias(c) for c in ("size", "keys", "fp")))
    nodes = nodes.join(alike(prints), "fp", "left").withColumn("keys", F.concat("keys", F.array(F.coalesce("root", "fp"))))
    dealt = nodes.select("node", "th", "size", F.posexplode("keys").alias("band", "key"))
    cells = dealt.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.expr("bit_xor(xxhash64(node))").alias("a"), F.expr("bit_xor(xxhash64(node, 1))").alias("b"))
    cells = cells.where("n > 1").groupBy("a", "b", "n").agg(F.min(F.struct("band", "key", "shingles")).alias("c"))
    cells = cells.select("c.band", "c.key", F.ceil(F.col("c.shingles") / cell_size).cast("int").alias("parts"))
    own = written(dealt.join(cells, ["band", "key"]).select("band", "key", "parts", "node", "th", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int").alias("chunk")), "cells")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes([batch]):
                yield pa.RecordBatch.from_pydict({"node": part["node"], "hashes": pa.array([shingles(t).tobytes() for t in part["text"].to_pylist()], pa.binary())})

    asked = own.select("node", "th").distinct()
    texts = docs.select("text", F.xxhash64("text").alias("th")).join(asked, "th").dropDuplicates(["node"]).select("node", "text")
    known = texts.mapInArrow(sets, "node long, hashes binary")
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", "key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "node")
    keys = ["band", "key", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_groups(keys, 1000)(batches):
            new = np.zeros(rows.num_rows, bool)
            for key in keys:
                values = rows[key].to_numpy()
                new[1:] |= values[1:] != values[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), rows.num_rows]
            node, held, u, v = rows["node"].to_numpy(), rows["hashes"], [], []
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                for i, j in forest([np.frombuffer(held[k].as_buffer(), np.uint64) for k in range(first, last)]):
                    u.append(int(node[first + i]))
                    v.append(int(node[first + j]))
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return met.join(known, "node").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long").distinct()


def near_copies(docs: DataFrame, cell_size: int = 1_000_000) -> DataFrame:
    """Per row of ``docs``: doc_id, th (hash of the text), component_id (smallest id linked, over any number of links), keep (this id and text
    stand for the component: the smallest id, then the smallest hash; a null id only where all are)."""
    kind = dict(docs.dtypes)["doc_id"]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            sets = [shingles(t) for t in batch["text"].to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed=13) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            fp = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "th": batch["th"], "node": node, "size": pa.array(map(len, sets), pa.int64()), "keys": keys, "fp": fp})

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    prints = written(keyed.mapInArrow(sketched, f"doc_id {kind}, th long, node long, size long, keys array<long>, fp long"), "sketches")
    found = components(links(docs, prints, cell_size))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")
    nodes = prints.groupBy("node").agg(F.min(first).alias("first"))
    named = nodes.join(found, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    classes = named.join(named.groupBy("root").agg(F.min("first").alias("kept")), "root").select("node", "kept")
    keep = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("th") == F.col("kept.th"))
    return prints.select("doc_id", "th", "node").join(classes, "node").select("doc_id", "th", F.col("kept.doc_id").alias("component_id"), keep.alias("keep"))

"""Ranked search for terms, with block-max pruning.

Documents are cut into blocks of consecutive rows. A block is one row of a written table: its terms with the largest impact that each has in a document of the block, the number
of its documents that hold the term, and a forward index, the terms and impacts of each document. An impact depends on the term's occurrences and the document's length
only, so one index serves all queries. Terms, impacts and forward index are compressed bytes, which Spark passes on as they are, and which a task opens a block at a time.

A query's bound of a block is the sum of its terms' weights times their largest impacts there. Three passes read the index, none of which moves it:

1. bounds of all blocks from the narrow columns; the ``LEAD`` blocks of largest bound are each query's first ones;
2. these are scored, which gives each query a threshold, the score of its last wanted place;
3. each task sorts its blocks by bound, scores documents from the forward index until the bound drops below the threshold, which rises with what it finds, and emits its best
   documents of each query. A window with a limit merges them.

No document of the result is lost: a block is left out only if its bound, which no document of it exceeds, is below a score that enough other documents have.
Queries are dealt into batches of some ``BATCH_BYTES`` of text, so that the terms a task holds have a bound; more queries take more passes.

Defined cases: null and empty texts, and those without a term, are no documents of the counts and are never found; a query without a term gives no rows; every row is a
document, and every row of queries a query of its own, whatever its id; equal scores are in order of id, null last; an empty table on either side gives no rows; very long texts are
a block of their own and held one at a time; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.llm.common import by_bytes, written

#: A block has so many documents, or so many terms of documents, at most, or one document.
BLOCK_DOCS, BLOCK_TERMS = 32, 50_000
LEAD, BATCH_BYTES = 4, 8 << 20
#: ASCII letters in lower case, digits, and spaces for all other ASCII; bytes beyond stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_TABLE).split() if text else []


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    m = 10 + 90 * n * documents // terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _packed(*values: np.ndarray) -> bytes:
    return zlib.compress(b"".join(v.astype("<i4").tobytes() for v in values), 1)


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), "<i4")


@dataclass
class Index:
    blocks: DataFrame  # block, docs; packed: terms; peaks (each term's largest impact and documents); forward (each document's number of terms; their places among the terms; impacts)
    documents: int
    terms: int


def built(docs: DataFrame) -> Index:
    """An index of ``doc_id`` and ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in by_bytes(batches):
            for text in batch["text"].to_pylist():
                own = len(terms_of(text))
                n += own > 0
                total += own
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    size = docs.select("text").mapInArrow(count, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    documents, terms, kind = size["n"] or 0, size["total"] or 0, dict(docs.dtypes)["doc_id"]

    def laid(block: int, rows: list[tuple[object, Counter]], doc_type: pa.DataType) -> pa.RecordBatch:
        names = sorted(set().union(*(c for _, c in rows)))
        place = {t: i for i, t in enumerate(names)}
        sizes = np.array([len(c) for _, c in rows])
        at = np.fromiter((place[t] for _, c in rows for t in c), np.int64, sizes.sum())
        tf = np.fromiter((k for _, c in rows for k in c.values()), np.int64, sizes.sum())
        impact = impacts(tf, np.repeat(np.array([sum(c.values()) for _, c in rows], np.int64), sizes), documents, terms)
        largest = np.zeros(len(names), np.int64)
        np.maximum.at(largest, at, impact)
        packed = {"terms": zlib.compress(b" ".join(names), 1), "peaks": _packed(largest, np.bincount(at, minlength=len(names))), "forward": _packed(sizes, at, impact)}
        columns = {"block": pa.array([block], pa.int64()), "docs": pa.array([[d for d, _ in rows]], pa.list_(doc_type))} | {k: pa.array([v], pa.binary()) for k, v in packed.items()}
        return pa.RecordBatch.from_pydict(columns)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count, doc_type = TaskContext.get().partitionId() << 32, [], 0, None
        for batch in by_bytes(batches):
            doc_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = Counter(terms_of(text))
                if not own:
                    continue
                if held and (len(held) == BLOCK_DOCS or count + len(own) > BLOCK_TERMS):
                    yield laid(number, held, doc_type)
                    number, held, count = number + 1, [], 0
                held.append((doc_id, own))
                count += len(own)
        if held:
            yield laid(number, held, doc_type)

    schema = f"block long, docs array<{kind}>, terms binary, peaks binary, forward binary"
    return Index(written(docs.select("doc_id", "text").mapInArrow(lay, schema), "search-index"), documents, terms)


class Batch:
    """Queries that are searched together: their terms, the terms' weights, and which queries have which."""

    def __init__(self, texts: list[str]) -> None:
        own = [sorted(set(terms_of(t))) for t in texts]
        self.names = sorted(set().union(*own))
        self.number = {t: i for i, t in enumerate(self.names)}
        self.terms = [np.array([self.number[t] for t in q], np.int64) for q in own]
        by_term = sorted((int(t), q) for q, ts in enumerate(self.terms) for t in ts)
        self.queries = np.array([q for _, q in by_term], np.int64)
        self.ends = np.searchsorted(np.array([t for t, _ in by_term], np.int64), np.arange(len(self.names) + 1))
        self.weights = np.zeros(len(self.names), np.int64)

    def matched(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Row, numbers of the queries' terms that the block has, and their largest impacts and documents there; and the places of these terms."""
        for i, (terms, peaks) in enumerate(zip(batch["terms"], batch["peaks"], strict=True)):
            names = zlib.decompress(terms.as_py()).split(b" ")
            own = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
            at = np.flatnonzero(own >= 0)
            yield i, own[at], _numbers(peaks.as_py()).reshape(2, -1)[:, at].astype(np.int64), at

    def bounds(self, terms: np.ndarray, largest: np.ndarray) -> np.ndarray:
        """Of every query, the most that a document can score which has these terms with these impacts."""
        out = np.zeros(len(self.terms), np.int64)
        begin, sizes = self.ends[terms], self.ends[terms + 1] - self.ends[terms]
        places = np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)
        np.add.at(out, self.queries[places], np.repeat(self.weights[terms] * largest, sizes))
        return out


class Block:
    """The forward index of one row."""

    def __init__(self, batch: pa.RecordBatch, i: int, terms: np.ndarray, places: np.ndarray) -> None:
        self.terms, self.places, self.docs = terms, places, batch["docs"][i]
        forward, n = _numbers(batch["forward"][i].as_py()), len(self.docs)
        self.starts = np.cumsum(forward[:n]) - forward[:n]
        self.at, self.impact = forward[n:].reshape(2, -1)
        self.names = int(self.at.max()) + 1

    def scores(self, query: np.ndarray, weights: np.ndarray) -> np.ndarray:
        mine = np.isin(self.terms, query, assume_unique=True)
        of = np.zeros(self.names, np.int64)
        of[self.places[mine]] = weights[self.terms[mine]]
        return np.add.reduceat(of[self.at] * self.impact, self.starts)


class Best:
    """The best documents of each query, as far as a task has seen."""

    def __init__(self, least: np.ndarray, top: int) -> None:
        self.least, self.top = least.copy(), top
        self.found: dict[int, list[tuple]] = {}

    def see(self, q: int, block: Block, scores: np.ndarray) -> None:
        rows = np.flatnonzero(scores >= max(1, self.least[q]))
        if not len(rows):
            return
        docs = [block.docs[int(r)].as_py() for r in rows]
        own = self.found.setdefault(q, [])
        own += [(-s, d is None, d if d is not None else 0, d) for s, d in zip(scores[rows].tolist(), docs, strict=True)]
        own.sort(key=lambda x: x[:3])
        del own[self.top :]
        if len(own) == self.top:
            self.least[q] = max(self.least[q], -own[-1][0])

    def rows(self, doc_type: pa.DataType) -> pa.RecordBatch:
        flat = [(q, x[3], -x[0]) for q, own in self.found.items() for x in own]
        q, d, s = zip(*flat, strict=True) if flat else ((), (), ())
        return pa.RecordBatch.from_pydict({"query": pa.array(q, pa.int64()), "doc_id": pa.array(d, doc_type), "score": pa.array(s, pa.int64())})


def _top(rows: DataFrame, order: list, top: int) -> DataFrame:
    """The first rows of each query; each task keeps its own first ones before anything is shuffled."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= top)


def _searched(index: Index, batch: Batch, top: int) -> DataFrame:
    """query, doc_id, score, rank of the queries of one batch."""
    spark, n, kind = index.blocks.sparkSession, len(batch.terms), dict(index.blocks.dtypes)["docs"].removeprefix("array<")[:-1]
    plain = spark.sparkContext.broadcast(batch)

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = plain.value, np.zeros(len(plain.value.names), np.int64)
        for rows in batches:
            for _, terms, peaks, _ in own.matched(rows):
                total[terms] += peaks[1]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": some, "df": total[some]})

    for r in index.blocks.select("terms", "peaks").mapInArrow(holders, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        batch.weights[r["term"]] = weight(index.documents, r["df"])
    shared = spark.sparkContext.broadcast(batch)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        bounds, blocks = np.zeros((n, LEAD), np.int64), np.zeros((n, LEAD), np.int64)
        for rows in batches:
            numbers = rows["block"].to_numpy()
            for i, terms, peaks, _ in own.matched(rows):
                bound, least = own.bounds(terms, peaks[0]), bounds.argmin(axis=1)
                better = np.flatnonzero(bound > bounds[np.arange(n), least])
                bounds[better, least[better]], blocks[better, least[better]] = bound[better], numbers[i]
        q, k = np.nonzero(bounds)
        yield pa.RecordBatch.from_pydict({"query": q, "block": blocks[q, k], "bound": bounds[q, k]})

    first = _top(index.blocks.select("block", "terms", "peaks").mapInArrow(lead, "query long, block long, bound long"), [F.desc("bound"), "block"], LEAD)
    first = first.select("query", "block").toArrow().to_pydict()  # LEAD rows a query of the batch
    asked: dict[int, list[int]] = {}
    for q, b in zip(first["query"], first["block"], strict=True):
        asked.setdefault(b, []).append(q)
    few = spark.sparkContext.broadcast(asked)
    scored = f"query long, doc_id {kind}, score long"

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best, doc_type = shared.value, Best(np.zeros(n, np.int64), top), None
        for rows in batches:
            doc_type = rows.schema.field("docs").type.value_type
            numbers = rows["block"].to_pylist()
            for i, terms, _, at in own.matched(rows):
                block = Block(rows, i, terms, at)
                for q in few.value.get(numbers[i], ()):
                    best.see(q, block, block.scores(own.terms[q], own.weights))
        if doc_type:
            yield best.rows(doc_type)

    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    wanted = spark.createDataFrame([(b,) for b in asked], "block long")
    begun = _top(index.blocks.join(F.broadcast(wanted), "block", "left_semi").mapInArrow(start, scored), order, top)
    least = np.zeros(n, np.int64)
    for r in begun.where(F.col("rank") == top).select("query", "score").collect():
        least[r["query"]] = r["score"]
    threshold = spark.sparkContext.broadcast(least)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best, doc_type = shared.value, Best(threshold.value, top), None
        for rows in batches:
            doc_type = rows.schema.field("docs").type.value_type
            blocks, pairs = {}, []
            for i, terms, peaks, at in own.matched(rows):
                bound = own.bounds(terms, peaks[0])
                for q in np.flatnonzero(bound >= np.maximum(1, best.least)).tolist():
                    pairs.append((-int(bound[q]), i, q))
                    blocks[i] = terms, at
            laid: dict[int, Block] = {}
            for bound, i, q in sorted(pairs):
                if -bound >= best.least[q]:
                    if i not in laid:
                        laid[i] = Block(rows, i, *blocks[i])
                    best.see(q, laid[i], laid[i].scores(own.terms[q], own.weights))
        if doc_type:
            yield best.rows(doc_type)

    return _top(index.blocks.mapInArrow(finish, scored), order, top)


def search(index: Index, queries: DataFrame, top: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the best documents for each row of ``queries`` (item_id, text)."""
    asked = queries.where("text IS NOT NULL").select("item_id", "text")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    batches, spark = max(1, -(-size // BATCH_BYTES)), queries.sparkSession
    kinds = dict(queries.dtypes)["item_id"], dict(index.blocks.dtypes)["docs"].removeprefix("array<")[:-1]
    out = spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    for i in range(batches):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == i).collect()
        if rows and index.documents:
            names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], f"query long, item_id {kinds[0]}")
            found = _searched(index, Batch([r["text"] for r in rows]), top)
            out = out.unionByName(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out

"""Compression of vectors to codes, with integer codebooks.

A component becomes floor(256 * x), and a vector is cut into equal consecutive parts. Each part position has a codebook, which starts as that part of the vectors with the
smallest ids. In every round the codebooks are broadcast (parts x entries x width numbers: bounded by the parameters and the vector's length); each Arrow batch takes all
distances of its parts to all entries as |x|^2 - 2 x.c + |c|^2, with one exact 64-bit integer matrix product a part position, and the first least one. A task adds up the parts
and their number for each entry, so that a round shuffles a row an entry and task, and the merged sums give the next entries.

Defined cases: rows whose vector is null or has null, NaN or infinite components are left out; the vectors' length is that of the first row kept (by id, null last, then components)
whose length the parts divide, and rows of other lengths are returned without code and error; with fewer rows than entries, codebooks are shorter; equal distances go to the
lower entry, so that of equal entries only the first is used; components beyond +-2^18 count as +-2^18, so that no sum overflows; repeated rows are coded each for itself, and equal
ids at the start are in order of components; null labels are summed together, and a label none of whose vectors has a code has no sum; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.common import written

SCALE, LARGEST = 256, 1 << 26
#: Vectors whose distances are held at once.
ROWS = 4096
#: Sums of labels are broadcast up to so many labels, and joined by a shuffle beyond.
FEW_LABELS = 100_000


@dataclass
class Codebooks:
    entries: np.ndarray  # parts x entries x width

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each part, and its squared distance; both rows x parts."""
        parts, _, width = self.entries.shape
        cut = vectors.reshape(len(vectors), parts, width)
        codes, errors = np.empty((len(cut), parts), np.int64), np.empty((len(cut), parts), np.int64)
        rows = np.arange(len(cut))
        for p in range(parts):
            x, c = np.ascontiguousarray(cut[:, p]), self.entries[p]
            away = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None]
            codes[:, p] = away.argmin(axis=1)
            errors[:, p] = away[rows, codes[:, p]]
        return codes, errors


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v, the integer components, of all rows whose vector is whole; a written table."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    number: Column = F.transform("embedding", lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * SCALE))).cast("long"))
    return written(vectors.where(F.col("embedding").isNotNull() & finite).select("vec_id", "label", number.alias("v")), "vectors")


def _matrix(values: pa.Array, length: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, length)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)


def started(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The codebooks of the smallest ids; none without a vector that the parts divide."""
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    fits = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    first = fits.orderBy(*order).select(F.size("v").alias("n")).limit(1).collect()
    if not first:
        return None
    top = fits.where(F.size("v") == first[0]["n"]).orderBy(*order).select("v").limit(entries).collect()
    return Codebooks(np.array([r["v"] for r in top], np.int64).reshape(len(top), parts, -1).transpose(1, 0, 2).copy())


def improved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: every used entry is the mean of its parts, rounded down."""
    parts, entries, width = books.entries.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, counts = shared.value, np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in _slices(batches):
            vectors = _matrix(batch["v"], own.length)
            cell = own.nearest(vectors)[0] + np.arange(parts) * entries
            counts += np.bincount(cell.ravel(), minlength=parts * entries)
            np.add.at(sums, cell.ravel(), vectors.reshape(-1, width))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cell": used, "n": counts[used]} | {f"s{i}": sums[used, i] for i in range(width)})

    fields = ", ".join(f"s{i} long" for i in range(width))
    fits = rows.where(F.size("v") == books.length).select("v")
    merged = fits.mapInArrow(add, f"cell long, n long, {fields}").groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))).toArrow()
    means = np.stack([merged[f"s{i}"].to_numpy() for i in range(width)], axis=1) // merged["n"].to_numpy()[:, None]
    after = books.entries.reshape(-1, width).copy()
    after[merged["cell"].to_numpy()] = means
    return Codebooks(after.reshape(books.entries.shape))


def fit(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks from rows of ``whole``; at most 256 entries, as a code has two hexadecimal digits."""
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries")
    books = started(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = improved(rows, books)
    return books


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part), error (squared distances, summed); both null for vectors of another length."""
    shared, kinds = rows.sparkSession.sparkContext.broadcast(books), dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        parts = own.entries.shape[0]
        for batch in _slices(batches):
            fits = batch["v"].value_lengths().to_numpy() == own.length
            codes, errors = own.nearest(_matrix(batch["v"].filter(pa.array(fits)), own.length))
            digits, at = codes.astype(np.uint8).tobytes().hex(), np.cumsum(fits) - 1
            texts = [digits[2 * parts * i : 2 * parts * (i + 1)] if f else None for i, f in zip(at.tolist(), fits.tolist(), strict=True)]
            found = np.zeros(len(fits), np.int64)
            found[fits] = errors.sum(axis=1)
            yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"], "label": batch["label"], "code": pa.array(texts, pa.string()), "error": pa.array(found, mask=~fits)})

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def restored(codes: DataFrame, books: Codebooks) -> DataFrame:
    """The rows of ``codes`` with ``restored``, the integer components that the code stands for (null without a code)."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<long>")
    def decode(texts):
        own = shared.value
        parts = np.arange(own.entries.shape[0])
        return texts.map(lambda t: None if t is None else own.entries[parts, list(bytes.fromhex(t))].ravel())

    return codes.withColumn("restored", decode("code"))


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Per row whose vector is whole: vec_id, code, error, label_error (of its label), codebooks_sha256."""
    rows = whole(vectors)
    books = fit(rows, parts, entries, rounds)
    if books is None:
        nothing = F.lit(None)
        return rows.select("vec_id", *(nothing.cast(kind).alias(name) for name, kind in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    codes = written(coded(rows, books), "codes")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))

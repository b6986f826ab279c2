"""What the operators share: tables, written intermediates, splits by id, and how oversized groups are cut."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-casing of A-Z alone, for ``translate``.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that parts words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where there is but one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
        import atexit

        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, kept when executors are lost, read with its columns pruned."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def by_groups(keys: list[str], rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.Table]]:
    """Deals a partition sorted by ``keys`` out in tables of ``rows`` rows at most that never cut a group; a larger group is a table of its own."""
    import numpy as np

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < rows:
                continue
            whole = pa.Table.from_batches(held)
            differs = np.zeros(count - 1, bool)
            for key in keys:
                values = whole[key].to_numpy()
                differs |= values[1:] != values[:-1]
            cuts = np.flatnonzero(differs)
            if not len(cuts):
                rows_now = whole.combine_chunks()
                held = rows_now.to_batches()
                continue
            ends, done = cuts + 1, 0
            while done < ends[-1]:
                at = np.searchsorted(ends, done + rows, side="right") - 1
                cut = int(ends[at]) if at >= 0 and ends[at] > done else int(ends[at + 1])
                yield whole.slice(done, cut - done)
                done = cut
            rest = whole.slice(done).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
        if count:
            yield pa.Table.from_batches(held)

    return deal


def by_bytes(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of ``text``, or of one row: what Python holds at once does not grow with the rows of a batch."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        first = 0
        while first < batch.num_rows:
            most = size + (int(ends[first - 1]) if first else 0)
            last = max(first + 1, int(np.searchsorted(ends, most, side="right")))
            yield batch.slice(first, last - first)
            first = last

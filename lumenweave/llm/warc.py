"""WARC archives: writing, normalising monolithic gzip, and reading by offset.

``write_archives`` writes records as streams that are gzipped as a whole, as some crawlers leave them. ``normalise`` inflates each such stream once, in
chunks, writes every record as a gzip member of its own, and leaves an index of offsets beside the archive; it never holds more than a chunk and a
record's header. ``read_records`` opens records by their offsets alone. Files go to a folder that all executors share, through Arrow's file systems,
under names of their own for every attempt; only names that a finished task returns are ever read.

Defined cases: null html is an empty payload; null url becomes ``urn:none``; a null page_id is written without a number and never names a response; rows
that share a payload's smallest page_id are all responses; repeated rows give repeated records; a damaged stream ends the job with its path in the error; an empty table
gives no archives and no rows; very long payloads are held one at a time when written and a chunk at a time when normalised; page ids must be whole numbers, as the
records' own ids are made of them; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import shared_dir, written

CHUNK = 1 << 20
INDEX_SCHEMA = "archive string, at long, size long"


def _file_system(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response, or where ``refers_to`` is given a revisit, which has the payload's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file, of one member or many, in chunks."""
    engine, raw = zlib.decompressobj(31), b""
    while True:
        raw = raw or stream.read(CHUNK)
        if not raw:
            if not engine.eof:
                raise ValueError("the gzip stream ends early")
            return
        if engine.eof:
            engine = zlib.decompressobj(31)
        if out := engine.decompress(raw, CHUNK):
            yield out
        raw = engine.unused_data if engine.eof else engine.unconsumed_tail


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes | None]:
    """The bytes of a WARC stream in parts, with a None after each record."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            left = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            while left > 0:
                part = bytes(held[:left])
                del held[:left]
                left -= len(part)
                yield part
                if left:
                    held += next(chunks, b"")
                    if not held:
                        raise ValueError("the last record ends early")
            yield None
    if held.strip():
        raise ValueError("bytes after the last record")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 64 << 20, level: int = 6) -> DataFrame:
    """Writes page_id, url, html, digest, refers_to as monolithic archives; returns archive, records, raw_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        out, engine, path, raw, count = None, None, "", 0, 0
        closed: list[tuple[str, int, int]] = []

        def close() -> None:
            out.write(engine.flush())
            out.close()
            closed.append((path, count, raw))

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    path, raw, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, engine = fs.open_output_stream(f"{root}/{path}", compression=None), zlib.compressobj(level, wbits=31)
                data = record(page_id, url, (html or "").encode(), base64.b32encode(bytes.fromhex(digest)).decode(), refers_to)
                out.write(engine.compress(data))
                raw, count = raw + len(data), count + 1
                if raw >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({name: pa.array([x[i] for x in closed], kind) for i, (name, kind) in enumerate((("archive", pa.string()), ("records", pa.int64()), ("raw_bytes", pa.int64())))})

    return written(pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "archive string, records long, raw_bytes long"), "archives")


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrites each ``archive`` of the folder with a member a record, ``.idx`` beside it; returns the same index as a table: archive (the new one), at, size of every
    record. So no job has to list the sidecars, and those that lost attempts left are in no index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        for batch in batches:
            for source in batch["archive"].to_pylist():
                target, at, rows = f"{uuid.uuid4().hex}.members.warc.gz", 0, []
                with fs.open_input_stream(f"{root}/{source}", compression=None) as stream, fs.open_output_stream(f"{root}/{target}", compression=None) as out, fs.open_output_stream(f"{root}/{target}.idx") as index:
                    engine, begun = zlib.compressobj(level, wbits=31), 0
                    try:
                        for part in split_records(inflated(stream)):
                            data = engine.flush() if part is None else engine.compress(part)
                            out.write(data)
                            at += len(data)
                            if part is None:
                                index.write(json.dumps({"archive": target, "at": begun, "size": at - begun}).encode() + b"\n")
                                rows.append((target, begun, at - begun))
                                engine, begun = zlib.compressobj(level, wbits=31), at
                    except (ValueError, KeyError, zlib.error) as e:
                        raise ValueError(f"{root}/{source}: {e}") from e
                yield pa.RecordBatch.from_pydict({name: pa.array([x[i] for x in rows], kind) for i, (name, kind) in enumerate((("archive", pa.string()), ("at", pa.int64()), ("size", pa.int64())))})

    return written(archives.select("archive").repartition(tasks(archives)).mapInArrow(run, INDEX_SCHEMA), "members")


def tasks(archives: DataFrame, most: int = 10_000) -> int:
    """A task an archive, ``most`` at most. A number of one's own, as names are too short for the engine to see how much is behind them."""
    return max(1, min(most, archives.count()))


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """archive, at, size of every record that an index file of the folder names, for archives that came from elsewhere."""
    return spark.read.schema(INDEX_SCHEMA).json(f"{folder}/*.members.warc.gz.idx").where("archive IS NOT NULL AND size IS NOT NULL")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record that ``index`` (archive, at, size) has; an archive's
    records should lie in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        name, file = None, None
        number = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
        for batch in batches:
            rows = []
            for archive, at, size in zip(*(batch[c].to_pylist() for c in ("archive", "at", "size")), strict=True):
                if archive != name:
                    name, file = archive, fs.open_input_file(f"{root}/{archive}")
                file.seek(at)
                head, _, block = zlib.decompress(file.read(size), 31).partition(b"\r\n\r\n")
                warc = headers(head)
                http, _, payload = block[: int(warc["content-length"])].partition(b"\r\n\r\n")
                if warc["warc-type"] == "response":
                    rows.append((number(warc["warc-record-id"]), len(payload), digest32(payload), "response", None, warc["warc-target-uri"]))
                else:
                    rows.append((number(warc["warc-record-id"]), int(headers(http)["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:"), "revisit", number(warc["warc-refers-to"]), warc["warc-target-uri"]))
            kinds = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()))
            yield pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in rows], kind) for i, (n, kind) in enumerate(kinds)})

    return index.sortWithinPartitions("archive", "at").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest (hexadecimal SHA-1), refers_to: the smallest page_id of equal payloads, null for that page itself."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    # a written table, so that the engine can split the join on a payload that many pages share
    shared = written(rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "shared")
    return rows.join(shared, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first")).alias("refers_to"))


def round_trip(pages: DataFrame, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes, normalises and reads back ``pages``: see ``read_records`` for the columns."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    _file_system(folder)[0].create_dir(_file_system(folder)[1])
    archives = write_archives(with_revisits(pages), folder, archive_bytes)
    return read_records(normalise(archives, folder).repartition(tasks(archives), "archive"), folder)

"""RIFF image files as a Spark data source, ``riff``: a row a chunk when read, a file a row when written.

Reading lists the files and plans tasks of some ``bytesPerTask`` bytes each; a task opens its files one at a time and jumps from chunk to chunk, so that payloads of tags that a filter
leaves out are never read. Writing gives every attempt a folder of its own; a commit notes the folders of the tasks that finished, and only noted folders are read, so that killed and
repeated attempts leave no row.

Defined cases: a file that is no container, or whose chunk ends beyond it, is a row with its ``error`` (after the rows of the chunks before); an empty folder gives no rows; a null
payload is an empty one; files in a folder without notes are all read; very long payloads are held one at a time."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NOTES = "_committed"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    folder: str


class RiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.most, self.tag = options["path"], int(options.get("bytesPerTask", 64 << 20)), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("tag",):
                self.tag = f.value
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = _opened(self.path)
        every = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file]
        notes = [f for f in every if f"/{NOTES}/" in f.path]
        if notes:
            folders = {line for f in notes for line in system.open_input_stream(f.path).read().decode().split()}
            every = [f for f in every if f.path.rsplit("/", 2)[-2] in folders]
        tasks, size = [[]], 0
        for f in sorted(every, key=lambda f: f.path):
            if tasks[-1] and size + f.size > self.most:
                tasks.append([])
                size = 0
            tasks[-1].append(f.path)
            size += f.size
        return [Files(t) for t in tasks]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _opened(self.path)
        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            with system.open_input_file(path) as file:
                size, at, error = file.size(), 12, None
                head = file.read(12)
                if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WEBP":
                    yield name, None, None, None, None, "no container"
                    continue
                while at + 8 <= size:
                    file.seek(at)
                    tag, n = struct.unpack("<4sI", file.read(8))
                    if at + 8 + n > size:
                        error = "cut"
                        break
                    text = tag.decode("latin-1")
                    if self.tag is None or text == self.tag:
                        yield name, text, at + 8, n, file.read(n), None
                    at += 8 + n + n % 2
                if error and self.tag is None:
                    yield name, None, at, None, None, error


class RiffWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def write(self, rows: Iterator) -> Written:
        system, root = _opened(self.path)
        folder = f"part-{uuid.uuid4().hex}"
        system.create_dir(f"{root}/{folder}", recursive=True)
        for row in rows:
            payload = bytes(row["payload"] or b"")
            pad = len(payload) % 2
            with system.open_output_stream(f"{root}/{folder}/{row['name']}") as file:
                file.write(struct.pack("<4sI4s4sI", b"RIFF", 12 + len(payload) + pad, b"WEBP", b"VP8 ", len(payload)) + payload + b"\0" * pad)
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        system.create_dir(f"{root}/{NOTES}", recursive=True)
        with system.open_output_stream(f"{root}/{NOTES}/{uuid.uuid4().hex}") as file:
            file.write("\n".join(m.folder for m in messages if m).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        for m in messages:
            if m:
                system.delete_dir(f"{root}/{m.folder}")


class RiffSource(DataSource):
    """``spark.read.format("riff").load(folder)``; rows of name and payload are written by ``df.write.format("riff").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "riff"

    def schema(self) -> str:
        return "name string, tag string, at long, size long, payload binary, error string"

    def reader(self, schema: StructType) -> RiffReader:
        return RiffReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> RiffWriter:
        if overwrite:
            raise ValueError("riff files are only appended")
        return RiffWriter(self.options)


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RiffSource)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share (``spark.checkpoint.dir``); a temporary one only where there is but one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        shared = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return f"{shared.rstrip('/')}/riff-{uuid.uuid4().hex}"

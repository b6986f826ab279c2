"""Image files written, read, damaged; attempts that were not committed."""

import os

import pytest
from pyspark.sql import functions as F

from lumenweave.sources import riff


@pytest.fixture()
def folder(spark, tmp_path):
    riff.registered(spark)
    rows = [(f"{i}.webp", bytes(range(i % 50)) * (i % 7)) for i in range(40)] + [("none.webp", None)]
    spark.createDataFrame(rows, "name string, payload binary").repartition(3).write.format("riff").mode("append").save(str(tmp_path))
    return str(tmp_path), {n: p or b"" for n, p in rows}


def test_round_trip(spark, folder):
    path, rows = folder
    read = spark.read.format("riff").option("bytesPerTask", 1000).load(path)
    assert read.rdd.getNumPartitions() > 2
    got = {r.name: r for r in read.collect()}
    assert {n: bytes(r.payload) for n, r in got.items()} == rows
    assert all(r.tag == "VP8 " and r.at == 20 and r.size == len(rows[n]) and r.error is None for n, r in got.items())
    assert read.where("tag = 'VP8 '").count() == len(rows) and read.where("tag = 'EXIF'").count() == 0


def test_uncommitted_attempts_are_not_read(spark, folder):
    path, rows = folder
    os.makedirs(f"{path}/part-killed")
    some = next(f"{path}/{d}/{f}" for d in os.listdir(path) if d.startswith("part-") for f in os.listdir(f"{path}/{d}"))
    with open(some, "rb") as a, open(f"{path}/part-killed/again.webp", "wb") as b:
        b.write(a.read())
    assert spark.read.format("riff").load(path).count() == len(rows)
    riff.RiffWriter({"path": path}).abort([riff.Written("part-killed"), None])
    assert not os.path.exists(f"{path}/part-killed")

    @F.udf("binary")
    def broken(name):
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        spark.range(5).select(F.col("id").cast("string").alias("name"), broken("id").alias("payload")).write.format("riff").mode("append").save(path)
    assert spark.read.format("riff").load(path).count() == len(rows)


def test_damaged_files_are_rows(spark, tmp_path):
    riff.registered(spark)
    chunk = lambda tag, n, own: tag + n.to_bytes(4, "little") + own
    files = {
        "empty": b"", "other": b"RIFX" + b"\0" * 20, "cut": b"RIFF\0\0\0\0WEBP" + chunk(b"EXIF", 3, b"abc\0") + chunk(b"VP8 ", 9, b"short"), "loop": b"RIFF\0\0\0\0WEBP" + chunk(b"LOOP", 0xFFFFFFF8, b""),
        "many": b"RIFF\0\0\0\0WEBP" + chunk(b"EXIF", 1, b"a\0") * 150 + chunk(b"VP8 ", 2, b"ok"), "bare": b"RIFF\0\0\0\0WEBP",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = spark.read.format("riff").load(str(tmp_path)).collect()
    errors = {r.name: (r.error, r.at) for r in rows if r.error}
    assert errors == {"empty": ("no container", None), "other": ("no container", None), "cut": ("cut", 24), "loop": ("cut", 12)}
    assert sum(r.name == "many" for r in rows) == 151 and [bytes(r.payload) for r in rows if r.tag == "VP8 "] == [b"ok"]
    assert [bytes(r.payload) for r in rows if r.name == "cut" and r.tag] == [b"abc"]

"""Files, listings and delimited text."""

import math
import os

import pytest

from lumenweave.plans import records
from lumenweave.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for name, data in (("a.png", b"\x89PNG"), ("b.JPEG", b"\xff\xd8"), ("empty.jpg", b""), ("c.txt", b"text"), ("png", b"no suffix")):
        (path / name).write_bytes(data)
    (path / "inner").mkdir()
    (path / "inner" / "d.jpg").write_bytes(b"\xff")
    return str(path)


def test_whole_files_and_empty_ones(spark, folder):
    wanted = spark.createDataFrame([("a.png",), ("empty.jpg",), ("none.png",)], "name string")
    rows = {r.name: r for r in files.checked(files.binary_files(spark, folder), wanted).collect()}
    assert rows["a.png"].content == b"\x89PNG" and rows["a.png"].length == 4 and rows["a.png"].error is None
    assert rows["empty.jpg"].error == rows["none.png"].error == "empty or missing"


def test_listing_by_suffix(spark, folder):
    assert sorted(os.path.basename(r.path) for r in files.listed(spark, folder).collect()) == ["a.png", "b.JPEG", "d.jpg"]


def test_tables_need_their_columns(spark, tmp_path):
    path = str(tmp_path / "points.tsv")
    with open(path, "w") as out:
        out.write("encoder\tq\tbytes\tpsnr_rgb\textra\nours \t75\t100\tinf\t1\nlib\tx\t200\t31.5\t2\n")
    kinds = {"encoder": "string", "q": "int", "bytes": "bigint", "psnr_rgb": "double"}
    rows = files.table_of(spark, path, kinds).orderBy("bytes").collect()
    assert rows[0] == ("ours", 75, 100, math.inf) and rows[1] == ("lib", None, 200, 31.5)
    with pytest.raises(ValueError, match="ssim_y"):
        files.table_of(spark, path, kinds | {"ssim_y": "double"})


def test_written_tables_read_back(spark, tmp_path):
    rows = [('a "quoted", name', 1.5), ("plain", None)]
    files.write_table(spark.createDataFrame(rows, "file string, us double"), f"{tmp_path}/out")
    back = spark.read.option("header", "true").option("escape", '"').csv(f"{tmp_path}/out").collect()
    assert sorted((r.file, r.us and float(r.us)) for r in back) == sorted(rows, key=str)


def test_scan_of_the_driver_tables(spark, sf_dir):
    rows = {r.table: r for r in records.binary_scan(spark, sf_dir).collect()}
    assert rows["region"].bytes == os.path.getsize(f"{sf_dir}/region.parquet")

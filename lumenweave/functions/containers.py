"""Byte containers as column expressions: chunks of a RIFF file, partition tables of a frame, filtered rows of a picture. Each is a fold over one row's bytes, with no bound on its size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenweave.functions.blocks import load_little_endian


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row: what a fold names in its steps would else be computed in each of them."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(data: Column) -> Column:
    """The chunks of a RIFF file up to its first VP8 one: an array of (at, tag, size), the place of the payload from 0, and ``error``: not a file of this kind, a chunk that ends
    beyond the file or whose padding does, or no image. Every chunk has eight bytes at least, so that the walk has an eighth as many steps as the file has bytes, and most of
    them have nothing to do."""
    return let(data, _chunks)


def _chunks(data: Column) -> Column:
    size = F.octet_length(data).cast("long")
    tag = lambda at: F.substring(data, (at + 1).cast("int"), F.lit(4))
    known = (size >= 12) & (tag(F.lit(0)) == F.lit("RIFF").cast("binary")) & (tag(F.lit(8)) == F.lit("WEBP").cast("binary"))
    one = "array<struct<at:bigint,tag:binary,size:bigint>>"
    start = F.struct(F.lit(12).cast("long").alias("at"), F.array().cast(one).alias("found"), F.when(~known, "no container").alias("error"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        n = load_little_endian(data, (at + 5).cast("int"))
        ends, image = at + 8 + n, tag(at) == F.lit("VP8 ").cast("binary")
        after = ends + n % 2
        error = F.when(ends > size, "cut").when(~image & (after > size), "cut")
        found = F.when(ends > size, s["found"]).otherwise(F.concat(s["found"], F.array(F.struct((at + 8).alias("at"), tag(at).alias("tag"), n.alias("size")))))
        moved = F.struct(after.alias("at"), found.alias("found"), error.alias("error"), image.alias("done"))
        return F.when(s["done"] | s["error"].isNotNull() | (at + 8 > size), s).otherwise(moved)

    steps = F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(size / 8)))
    return F.aggregate(steps, start, step, lambda s: F.struct(s["found"].alias("chunks"), F.when(s["error"].isNotNull(), s["error"]).when(~s["done"], "no image").alias("error")))


def partition_sizes(data: Column, first_partition: Column, partitions: Column) -> Column:
    """Sizes of a frame's token partitions, from the table of three-byte sizes after the first partition; null where the table or what it tells of lies beyond the bytes.

    The table has one size less than there are partitions. They are stored from the second place on, and the last place, which the table's last size had, is what the others leave
    of the bytes; the first place of several stays 0. A single partition has no table."""
    return let(data, lambda d: _partition_sizes(d, first_partition, partitions))


def _partition_sizes(data: Column, first_partition: Column, partitions: Column) -> Column:
    begin = F.lit(10) + first_partition
    table = F.when(partitions > 1, F.transform(F.sequence(F.lit(0), (partitions - 2).cast("int")), lambda i: load_little_endian(data, (begin + i * 3 + 1).cast("int"), 3)))
    total = F.aggregate(table, F.lit(0).cast("long"), lambda a, v: a + v)
    left = F.octet_length(data) - begin - (partitions - 1) * 3
    sizes = F.concat(F.array(F.lit(0).cast("long")), F.slice(table, F.lit(1), (partitions - 2).cast("int")), F.array((left - total).cast("long")))
    return F.when(partitions == 1, F.array((F.octet_length(data) - begin).cast("long"))).when(left < 0, None).when(total > left, None).otherwise(sizes)


def paeth(a: Column, b: Column, c: Column) -> Column:
    """The nearest of left, above and corner to left + above - corner; in this order where equally near."""
    to_a, to_b, to_c = F.abs(b - c), F.abs(a - c), F.abs(a + b - c - c)
    return F.when((to_a <= to_b) & (to_a <= to_c), a).when(to_b <= to_c, b).otherwise(c)


def _guess(kind: Column, left: Column, above: Column, corner: Column) -> Column:
    return F.when(kind == 0, 0).when(kind == 1, left).when(kind == 2, above).when(kind == 3, F.floor((left + above) / 2)).otherwise(paeth(left, above, corner)).cast("long")


def _beside(values: Column, i: Column) -> Column:
    return F.when(i < 0, F.lit(0).cast("long")).otherwise(F.coalesce(F.get(values, i), F.lit(0).cast("long")))


def filtered_row(row: Column, above: Column, kind: Column, step: int) -> Column:
    """A row of bytes less its prediction: filter 0 none, 1 left, 2 above, 3 their mean, 4 Paeth; ``step`` bytes a pixel. All places at once."""
    return F.transform(row, lambda v, i: F.pmod(v - _guess(kind, _beside(row, i - step), _beside(above, i), _beside(above, i - step)), F.lit(256)))


def unfiltered(rows: Column, step: int) -> Column:
    """The rows (structs of kind and v) of a picture as they were: a fold over rows, and in each a fold over its bytes, as every byte waits for the one at its left. The one before the
    first row is zeros; a kind above 4 is a null picture."""
    none = F.array().cast("array<bigint>")

    def line(row: Column, above: Column) -> Column:
        kind, values = row["kind"], row["v"]
        places = F.sequence(F.lit(0), F.size(values) - 1)
        add = lambda out, i: F.concat(out, F.array(F.pmod(F.get(values, i) + _guess(kind, _beside(out, i - step), _beside(above, i), _beside(above, i - step)), F.lit(256))))
        return F.when(F.size(values) == 0, none).otherwise(F.aggregate(places, none, add))

    start = F.struct(none.alias("last"), F.array().cast("array<array<bigint>>").alias("all"))

    def next_row(s: Column, row: Column) -> Column:
        return let(line(row, s["last"]), lambda own: F.struct(own.alias("last"), F.concat(s["all"], F.array(own)).alias("all")))

    return let(rows, lambda r: F.when(F.exists(r, lambda x: ~x["kind"].between(0, 4)), None).otherwise(F.aggregate(r, start, next_row, lambda s: s["all"])))

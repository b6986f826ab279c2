"""Frames of blocks, and what is computed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions import blocks as B
from lumenweave.functions import planes as P

MODES = ("dc", "v", "h", "tm")


def block_frame(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, p: one 8x8 block of samples per vector of 64 numbers."""
    return embeddings.where(F.size("embedding") == 64).select("vec_id", "label", B.pixels(F.col("embedding")).alias("p"))


def sub_blocks(frame: DataFrame) -> DataFrame:
    """vec_id, label, k, s: the four 4x4 blocks of each block."""
    return frame.select("vec_id", "label", F.posexplode(F.array(*(B.sub_block(F.col("p"), k) for k in range(4)))).alias("k", "s"))


def transformed(rows: DataFrame, column: str, passes: list[B.Pass], name: str = "c") -> DataFrame:
    """The rows with ``name``, a transform of the 4x4 values in ``column``. The first pass is a column of its own, so that the second one doesn't compute it anew for each value."""
    first, second = passes
    return rows.withColumn("_first", B.passed(column, *first)).withColumn(name, B.passed("_first", *second)).drop("_first")


def coefficients(subs: DataFrame) -> DataFrame:
    """... c: forward DCT of each 4x4 block against flat 128."""
    return transformed(subs.withColumn("_r", F.transform("s", lambda v: v - 128)), "_r", B.FORWARD_DCT).drop("_r")


def text(values) -> Column:
    return F.array_join(F.transform(values if isinstance(values, Column) else F.array(*values), lambda v: v.cast("string")), ",")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def block_ssim(x: Column, y: Column) -> Column:
    """SSIM of two equally long arrays of samples."""
    times = lambda a, b: total(F.zip_with(a, b, lambda v, w: v * w))
    return P.ssim(F.size(x), total(x), total(y), times(x, x), times(y, y), times(x, y))


def mode_residuals(frame: DataFrame) -> DataFrame:
    """vec_id, mode, d: the lower right 4x4 block less its prediction from the samples around it, a row for each of four modes."""
    p = F.col("p")
    above, left, corner = [p[3 * 8 + 4 + x] for x in range(4)], [p[(4 + y) * 8 + 3] for y in range(4)], p[3 * 8 + 3]
    edges = frame.select("vec_id", B.sub_block(p, 3).alias("s"), F.array(*above).alias("a"), F.array(*left).alias("l"), corner.alias("c"), F.shiftright(B.total(above + left) + 4, 3).alias("m"))
    rows = edges.withColumn("mode", F.explode(F.sequence(F.lit(0), F.lit(len(MODES) - 1))))
    up, side = lambda i: F.get("a", i % 4), lambda i: F.get("l", F.floor(i / 4).cast("int"))
    guess = lambda i: F.when(F.col("mode") == 0, F.col("m")).when(F.col("mode") == 1, up(i)).when(F.col("mode") == 2, side(i)).otherwise(B.clip(side(i) + up(i) - F.col("c"), 0, 255))
    return rows.select("vec_id", "mode", F.transform("s", lambda v, i: v - guess(i)).alias("d"))


def best_modes(residuals: DataFrame) -> DataFrame:
    """The least sum of absolute differences, and of equal ones the lowest mode."""
    costs = residuals.select("vec_id", "mode", total(F.transform("d", F.abs)).alias("sad"))
    return costs.groupBy("vec_id").agg(F.min(F.struct("sad", "mode")).alias("best")).select("vec_id", F.col("best.mode").alias("mode"), F.col("best.sad").alias("sad"))


def hadamard_cost(rows: DataFrame, block: str, name: str) -> DataFrame:
    """Half the sum of the absolute Hadamard coefficients of a 4x4 block, rounded up."""
    whole = transformed(rows, block, B.HADAMARD, "_had")
    return whole.withColumn(name, F.shiftright(total(F.transform("_had", F.abs)) + 1, 1)).drop("_had")


def pruned_modes(residuals: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` modes of least Hadamard cost."""
    costs = hadamard_cost(residuals, "d", "satd")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy("satd", "mode"))
    return costs.select("vec_id", "mode", "satd", place.alias("place")).where(F.col("place") <= keep)

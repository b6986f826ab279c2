"""Blocks of a picture with the samples around them, and what is predicted from these.

A block's prediction needs the last row of the block above it, the last column of the one at its left, a corner, and the samples above at its right. Every block
sends these to the up to four blocks that need them, in one shuffle keyed by where they go; nothing is joined, and no picture is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions import blocks as B
from lumenweave.functions import frames as H
from lumenweave.functions import planes as P
from lumenweave.operators import blocks as O

#: What stands above the first row and left of the first column.
ABOVE, LEFT = 127, 129
ACROSS, DOWN = 4, 3


def macroblocks(embeddings: DataFrame) -> DataFrame:
    """image, r, c, p: macroblocks of 16x16 samples, of four vectors each, in pictures of 4x3; where a vector is missing its samples are 128."""
    mb = F.floor(F.col("vec_id") / 4)
    rows = O.block_frame(embeddings).select(mb.alias("mb"), F.struct((F.col("vec_id") % 4).alias("at"), "p").alias("part"))
    parts = rows.groupBy("mb").agg(F.map_from_entries(F.collect_list("part")).alias("parts"))
    part = lambda i: F.coalesce(F.element_at("parts", i.cast("long")), F.array_repeat(F.lit(128).cast("long"), 64))
    four = parts.withColumn("four", F.transform(F.sequence(F.lit(0), F.lit(3)), part))
    at = lambda i: F.get(F.get("four", (F.floor(i / 128) * 2 + F.floor(i % 16 / 8)).cast("int")), (F.floor(i / 16) % 8 * 8 + i % 8).cast("int"))
    image, place = F.floor(F.col("mb") / (ACROSS * DOWN)), F.col("mb") % (ACROSS * DOWN)
    return four.select(image.alias("image"), F.floor(place / ACROSS).alias("r"), (place % ACROSS).alias("c"), F.transform(F.sequence(F.lit(0), F.lit(255)), at).alias("p"))


def halved(blocks: DataFrame) -> DataFrame:
    """The blocks of 8x8 samples that are means of two by two, as chroma has them."""
    pair = lambda i: (F.floor(i / 8) * 32 + i % 8 * 2).cast("int")
    mean = lambda i: F.shiftright(F.get("p", pair(i)) + F.get("p", pair(i) + 1) + F.get("p", pair(i) + 16) + F.get("p", pair(i) + 17) + 2, 2)
    return blocks.withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(63)), mean))


def with_edges(blocks: DataFrame, n: int) -> DataFrame:
    """image, r, c, p, above, left (n samples, or null at the picture's edge), corner, beyond (four samples above at the right)."""
    line = F.sequence(F.lit(0), F.lit(n - 1))
    last_row = F.slice("p", n * (n - 1) + 1, n)
    last_column = F.transform(line, lambda y: F.get("p", y * n + n - 1))

    def sent(kind: str, down: int, across: int, values: Column) -> Column:
        return F.struct((F.col("r") + down).alias("r"), (F.col("c") + across).alias("c"), F.lit(kind).alias("kind"), values.alias("values"))

    messages = F.array(
        sent("own", 0, 0, F.col("p")), sent("above", 1, 0, last_row), sent("left", 0, 1, last_column), sent("corner", 1, 1, F.slice("p", n * n, 1)), sent("beyond", 1, -1, F.slice(last_row, 1, 4)),
    )
    rows = blocks.select("image", F.explode(messages).alias("m")).select("image", "m.*")
    got = [F.max(F.when(F.col("kind") == k, F.col("values"))).alias(name) for k, name in (("own", "p"), ("above", "above"), ("left", "left"), ("corner", "corner"), ("beyond", "beyond"))]
    return rows.groupBy("image", "r", "c").agg(*got).where("p IS NOT NULL").withColumn("corner", F.get("corner", F.lit(0)))


def bordered(blocks: DataFrame, n: int) -> DataFrame:
    """image, r, c, p, has_above, has_left, e: n + 1 rows of n + 5 samples, the block with what stands around it. At the right of every row are the four samples above at the right,
    which is where predictions of the lower 4x4 blocks look for them; at the picture's right edge the last sample above stands for them."""
    edges = with_edges(blocks, n)
    fill = lambda v, size: F.array_repeat(F.lit(v).cast("long"), size)
    none = F.col("above").isNull()
    beyond = F.when(none, fill(ABOVE, 4)).otherwise(F.coalesce("beyond", F.array_repeat(F.get("above", F.lit(n - 1)), 4)))
    corner = F.when(none, F.lit(ABOVE).cast("long")).when(F.col("left").isNull(), F.lit(LEFT).cast("long")).otherwise(F.col("corner"))
    rows = edges.select(
        "image", "r", "c", "p", (~none).alias("has_above"), F.col("left").isNotNull().alias("has_left"), F.coalesce("above", fill(ABOVE, n)).alias("a"), F.coalesce("left", fill(LEFT, n)).alias("l"), beyond.alias("b"), corner.alias("o"),
    )
    lines = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda y: F.concat(F.array(F.get("l", y)), F.slice("p", y * n + 1, F.lit(n)), F.col("b")))
    return rows.select("image", "r", "c", "p", "has_above", "has_left", F.concat(F.array("o"), "a", "b", F.flatten(lines)).alias("e"))


def predictions(blocks: DataFrame, n: int) -> DataFrame:
    """image, r, c, mode, d: what each of the four modes DC, V, H, TM leaves of a block of ``bordered``, a row a mode."""
    wide, count = n + 5, F.col("has_above").cast("int") + F.col("has_left").cast("int")
    above, left = F.slice("e", 2, n), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda y: F.get("e", y * wide))
    total = F.when(F.col("has_above"), O.total(F.col("a"))).otherwise(0) + F.when(F.col("has_left"), O.total(F.col("l"))).otherwise(0)
    rows = blocks.withColumn("a", above).withColumn("l", left)
    rows = rows.withColumn("mean", F.when(count == 0, 128).otherwise(F.floor((total + F.shiftright(n * count, 1)) / (n * F.greatest(count, F.lit(1))))))
    rows = rows.withColumn("mode", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("o", F.get("e", F.lit(0)))
    up, side = lambda i: F.get("a", i % n), lambda i: F.get("l", F.floor(i / n).cast("int"))
    guess = lambda i: F.when(F.col("mode") == 0, F.col("mean")).when(F.col("mode") == 1, up(i)).when(F.col("mode") == 2, side(i)).otherwise(B.clip(side(i) + up(i) - F.col("o"), 0, 255))
    return rows.select("image", "r", "c", "mode", F.transform("p", lambda v, i: v - guess(i)).alias("d"))


def errors(rows: DataFrame) -> DataFrame:
    """The rows with ``sad`` and ``sse`` in place of the differences d."""
    return rows.withColumn("sad", O.total(F.transform("d", F.abs))).withColumn("sse", O.total(F.transform("d", lambda v: v * v))).drop("d")


def subblock_lines(blocks: DataFrame) -> DataFrame:
    """image, r, c, k, s, line: the sixteen 4x4 blocks of each macroblock of ``bordered``, and the thirteen samples around each, from the lowest at its left to the last above."""
    rows = blocks.select("image", "r", "c", "e", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    base = F.floor(F.col("k") / 4) * 84 + F.col("k") % 4 * 4  # the corner's place, in rows of 21
    place = lambda down, across: F.get("e", (base + (21 * down + across)).cast("int"))
    line = [place(4 - y, 0) for y in range(4)] + [place(0, x) for x in range(9)]
    return rows.select("image", "r", "c", "k", F.array(*(place(1 + i // 4, 1 + i % 4) for i in range(16))).alias("s"), F.array(*line).alias("line"))


def subblock_candidates(lines: DataFrame) -> DataFrame:
    """image, r, c, k, mode, s, guess: a row for each of the ten 4x4 predictions."""
    two, three = H.taps(F.col("line"))
    rows = lines.withColumn("two", two).withColumn("three", three)
    guesses = F.array(*H.subblock_predictions(F.col("line"), F.col("two"), F.col("three")))
    return rows.select("image", "r", "c", "k", "s", F.posexplode(guesses).alias("mode", "guess"))


def rate_distortion(candidates: DataFrame, dc: int, ac: int, weight: int) -> DataFrame:
    """The candidates with ``error`` (squared, after the residual was transformed, quantized and brought back), ``rate`` (of the levels, and one more for every mode but DC) and
    ``cost``: 256 times the error, and ``weight`` times the rate. Every step is a column that the next one reads."""
    step = lambda i: F.when(i == 0, dc).otherwise(ac).cast("long")
    rows = candidates.withColumn("d", F.zip_with("s", "guess", lambda v, g: v - g))
    rows = O.transformed(rows, "d", B.FORWARD_DCT, "coefficients")
    rows = rows.withColumn("q", F.transform("coefficients", lambda v, i: B.quantized(v, step(i))))
    rows = rows.withColumn("back", F.transform("q", lambda v, i: v * step(i)))
    rows = O.transformed(rows, "back", B.INVERSE_DCT, "back")
    again = F.zip_with("guess", "back", lambda g, v: B.clip(g + v, 0, 255))
    rows = rows.withColumn("error", O.total(F.transform(F.zip_with("s", again, lambda v, w: v - w), lambda v: v * v)))
    rows = rows.withColumn("rate", P.block_rate(F.col("q")) + (F.col("mode") > 0).cast("long"))
    return rows.withColumn("cost", F.col("error") * 256 + F.col("rate") * weight)

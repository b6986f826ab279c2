"""Images as pixel rows (name, y, x, r, g, b), as planes (name, plane, y, x, v) and as tiles of 8x8 samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions import blocks as B
from lumenweave.functions import planes as P
from lumenweave.operators import blocks as O

#: The test corpus: pairs of colours, and what each pattern takes of the second one, in 15ths.
PAIRS = (((0, 0, 0), (255, 255, 255)), ((0, 0, 255), (255, 255, 0)), ((17, 34, 51), (254, 253, 252)), ((255, 0, 0), (0, 255, 0)))
PATTERNS = {
    "solid_rgb": "0",
    "checker": "15 * ((x ^ y) & 1)",
    "blockcheck2": "15 * (((x div 2) ^ (y div 2)) & 1)",
    "vsplit": "15 * (x div 8)",
    "hsplit": "15 * (y div 8)",
    "dsplit": "IF(x > y, 15, 0)",
    "hgrad": "x",
    "vgrad": "y",
}


def corpus_names() -> list[tuple[str, str, tuple, tuple]]:
    """name, pattern and both colours of the thirty 16x16 images."""
    text = lambda c: "_".join(f"{v:03}" for v in c)
    out = []
    for pattern in PATTERNS:
        for a, b in PAIRS:
            if pattern.endswith("grad") and a == (17, 34, 51):
                continue  # its steps are no whole numbers
            out.append((f"{pattern}_16x16_{text(a)}" + ("" if pattern == "solid_rgb" else f"_{text(b)}"), pattern, a, b))
    return out


def corpus(spark: SparkSession) -> DataFrame:
    """The pixels of the thirty images."""
    color = lambda c, n: [F.lit(v).cast("long").alias(f"{n}{k}") for k, v in zip("rgb", c, strict=True)]
    specs = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern"), *color(a, "a_"), *color(b, "b_")) for n, p, a, b in corpus_names()))
    rows = spark.range(256).select(F.floor(F.col("id") / 16).alias("y"), (F.col("id") % 16).alias("x"), F.explode(specs).alias("s")).select("y", "x", "s.*")
    weight = F.lit(None)
    for pattern, rule in PATTERNS.items():
        weight = F.when(F.col("pattern") == pattern, F.expr(rule)).otherwise(weight)
    rows = rows.withColumn("w", weight)
    mixed = [F.floor((F.col(f"a_{k}") * (15 - F.col("w")) + F.col(f"b_{k}") * F.col("w")) / 15).alias(k) for k in "rgb"]
    return rows.select("name", "y", "x", *mixed)


def noise_state(n: Column, seed: int = 1) -> Column:
    """The generator's state after ``n`` steps (below 2**32): a jump for each hexadecimal digit of ``n``, so that no step waits for the one before."""
    jumps, factor, term = [], 1664525, 1013904223
    for _ in range(8):
        f, t = 1, 0
        for _ in range(16):
            jumps.append(f"named_struct('low', {f & 0xFFFF}L, 'high', {f >> 16}L, 'term', {t}L)")
            f, t = f * factor & 0xFFFFFFFF, (t * factor + term) & 0xFFFFFFFF
        factor, term = f, t
    table = F.expr(f"array({', '.join(jumps)})")

    def jump(state: Column, j: Column) -> Column:
        upper = (state * j["high"]).bitwiseAND(0xFFFF) * 65536
        return (state * j["low"] + upper + j["term"]).bitwiseAND(0xFFFFFFFF)

    digits = F.reverse(F.hex(n))
    taken = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda k: F.get(table, k * 16 - 17 + F.instr(F.lit("0123456789ABCDEF"), F.substring(digits, k, F.lit(1)))))
    return F.aggregate(taken, F.lit(seed).cast("long"), jump)


GENERATED = ("solid", "rgbgrad", "checker", "noise", "diag")


def generated(specs: DataFrame) -> DataFrame:
    """name, rgb (three bytes a pixel, row by row) of the images that ``specs`` (name, pattern, w, h) asks for: solid, gradient, checker of 8, noise, diagonal.
    Images are dealt by name before they have pixels, and a row draws its own. Of several images of a name, the pixels of the same number stand together."""
    grey = lambda v: v * 0x010101

    def gradient(i: Column, w: Column, h: Column) -> Column:
        x, y = i % w, F.floor(i / w)
        return F.floor(x * 255 / (w - 1)) * 65536 + F.floor(y * 255 / (h - 1)) * 256 + F.floor((x + y) * 255 / (w + h - 2))

    def noise(i: Column, w: Column, h: Column) -> Column:
        one = F.transform(F.array(noise_state(i + 1)), lambda s: s.bitwiseAND(255) * 65536 + s.bitwiseAND(0xFF00) + F.shiftright(s, 16).bitwiseAND(255))
        return F.get(one, F.lit(0))

    rules = {
        "solid": lambda i, w, h: F.lit(0x112233).cast("long"),
        "rgbgrad": gradient,
        "checker": lambda i, w, h: grey(F.when((F.floor(i % w / 8) + F.floor(F.floor(i / w) / 8)) % 2 == 1, 255).otherwise(0)),
        "noise": noise,
        "diag": lambda i, w, h: grey(F.when(F.abs(i % w - F.floor(i / w)) <= 1, 255).otherwise(0)),
    }
    drawn = lambda rule, i, w, h: F.lpad(F.hex(rule(i, w, h)), 6, "0")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)

    def chosen(pattern: Column, draw) -> Column:
        """By the pattern, and the last rule where it is none of the others."""
        *first, last = rules
        out = draw(rules[last])
        for name in first:
            out = F.when(pattern == name, draw(rules[name])).otherwise(out)
        return out

    def together(i: Column) -> Column:
        there = F.filter("images", lambda m: m["w"] * m["h"] > i)
        return F.array_join(F.array_sort(F.transform(there, lambda m: chosen(m["pattern"], lambda rule: drawn(rule, i, m["w"], m["h"])))), "")

    images = specs.where("w * h > 0").groupBy("name").agg(*(F.first(c).alias(c) for c in ("pattern", "w", "h")), F.max(F.col("w") * F.col("h")).alias("n"), F.collect_list(F.struct("pattern", "w", "h")).alias("images"))
    own = chosen(F.col("pattern"), lambda rule: F.transform(upto(F.col("n")), lambda i: drawn(rule, i, F.col("w"), F.col("h"))))
    pixels = F.when(F.size("images") == 1, own).otherwise(F.transform(upto(F.col("n")), together))
    return images.select("name", F.unhex(F.array_join(pixels, "")).alias("rgb"))


def i420(pixels: DataFrame) -> DataFrame:
    """name, plane, y, x, v. A chroma sample is made of two by two pixels; at an odd edge those there are count twice."""
    luma = pixels.select("name", F.lit("y").alias("plane"), "y", "x", B.rgb_to_yuv(*(F.col(c) for c in "rgb"))[0].alias("v"))
    pairs = pixels.groupBy("name", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"))
    sums = pairs.agg(*(F.sum(P.to_linear(F.col(c))).alias(c) for c in "rgb"), F.count("*").alias("n"))
    four = [P.to_gamma(F.floor(F.col(c) * 4 / F.col("n"))) for c in "rgb"]
    colored = sums.select("name", "y", "x", *(c.alias(n) for c, n in zip(four, "rgb", strict=True)))
    u, v = P.chroma(*(F.col(c) for c in "rgb"))
    both = F.explode(F.array(F.struct(F.lit("u").alias("plane"), u.alias("v")), F.struct(F.lit("v").alias("plane"), v.alias("v")))).alias("c")
    return luma.unionByName(colored.select("name", "y", "x", both).select("name", "c.plane", "y", "x", "c.v"))


def padded(planes: DataFrame) -> DataFrame:
    """The planes out to whole macroblocks: the last row and column repeat."""
    side = F.when(F.col("plane") == "y", 16).otherwise(8)
    ends = planes.groupBy("name", "plane").agg(F.max("y").alias("last_y"), F.max("x").alias("last_x"))
    upto = lambda c: F.when(F.col(c) == F.col(f"last_{c}"), F.floor(F.col(c) / side) * side + side - 1).otherwise(F.col(c))
    rows = planes.join(ends, ["name", "plane"]).withColumn("to_y", upto("y")).withColumn("to_x", upto("x"))
    rows = rows.withColumn("y", F.explode(F.sequence("y", "to_y"))).withColumn("x", F.explode(F.sequence("x", "to_x")))
    return rows.select("name", "plane", "y", "x", "v")


def flat_predictions(planes: DataFrame) -> DataFrame:
    """name, plane, my, mx, ref: what DC prediction gives each macroblock, from the row above it and the column at its left; macroblocks
    with neither are left out and stand for 128."""
    side = F.when(F.col("plane") == "y", 16).otherwise(8)
    rows = planes.withColumn("side", side).withColumn("my", F.floor(F.col("y") / side)).withColumn("mx", F.floor(F.col("x") / side))
    above = rows.where("y % side = side - 1").select("name", "plane", (F.col("my") + 1).alias("my"), "mx", "v", "side")
    left = rows.where("x % side = side - 1").select("name", "plane", "my", (F.col("mx") + 1).alias("mx"), "v", "side")
    sums = above.unionByName(left).groupBy("name", "plane", "my", "mx").agg(F.sum("v").alias("v"), F.count("*").alias("n"), F.first("side").alias("side"))
    return sums.select("name", "plane", "my", "mx", F.floor((F.col("v") * 2 * F.col("side") / F.col("n") + F.col("side")) / (2 * F.col("side"))).alias("ref"))


def transform_dump(planes: DataFrame) -> DataFrame:
    """name, plane, my, mx, k, c: coefficients of every 4x4 block of padded planes against its macroblock's flat prediction. The first
    coefficients of a macroblock's luma blocks go through the Walsh-Hadamard transform into a block of plane y2, and are zero in their own."""
    side = F.when(F.col("plane") == "y", 16).otherwise(8)
    at = F.struct((F.col("y") % 4 * 4 + F.col("x") % 4).alias("at"), "v")
    blocks = planes.groupBy(
        "name", "plane", F.floor(F.col("y") / side).alias("my"), F.floor(F.col("x") / side).alias("mx"),
        (F.floor(F.col("y") % side / 4) * side / 4 + F.floor(F.col("x") % side / 4)).cast("int").alias("k"),
    )
    blocks = blocks.agg(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["v"]).alias("s"))
    blocks = blocks.join(flat_predictions(planes), ["name", "plane", "my", "mx"], "left").withColumn("ref", F.coalesce("ref", F.lit(128)))
    residual = blocks.select("name", "plane", "my", "mx", "k", F.transform("s", lambda v: v - F.col("ref")).alias("s"))
    coded = O.transformed(residual, "s", B.FORWARD_DCT).drop("s")
    keys = ["name", "my", "mx"]
    firsts = coded.where("plane = 'y'").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.get("c", F.lit(0)).alias("d")))), lambda s: s["d"]).alias("d"))
    y2 = O.transformed(firsts, "d", B.FORWARD_WHT).select(*keys, F.lit("y2").alias("plane"), F.lit(0).alias("k"), "c")
    without = F.when(F.col("plane") == "y", F.transform("c", lambda v, i: F.when(i == 0, 0).otherwise(v).cast("long"))).otherwise(F.col("c"))
    return coded.withColumn("c", without).unionByName(y2)


def little_endian_hex(values: Column, size: int) -> Column:
    """Numbers as hexadecimal bytes, the least first."""
    one = lambda v: F.concat(*(F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(255)), 2, "0") for i in range(size)))
    return F.array_join(F.transform(values, one), "")


def digest(rows: DataFrame, key: str, order: Column, hexadecimal: Column) -> DataFrame:
    """SHA-256 of the bytes of a key's rows, laid end to end in order."""
    parts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), hexadecimal.alias("h")))).alias("parts"))
    return parts.select(key, F.sha2(F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), "")), 256).alias("sha"))


def pictures(embeddings: DataFrame) -> DataFrame:
    """picture, ty, tx, w, h, r, g, b: pictures of 21x13 pixels, as six tiles of 8x8 samples each; of the last tiles only what lies inside counts."""
    n, p = F.col("vec_id"), F.col("p")
    tiles = embeddings.where(F.size("embedding") == 64).select(F.floor(n / 6).alias("picture"), (F.floor(n / 3) % 2).alias("ty"), (n % 3).alias("tx"), B.pixels(F.col("embedding")).alias("p"))
    right, below = F.col("tx") == 2, F.col("ty") == 1
    return tiles.select(
        "picture", "ty", "tx", F.when(right, 5).otherwise(8).alias("w"), F.when(below, 5).otherwise(8).alias("h"), p.alias("r"), F.reverse(p).alias("g"),
        F.transform(p, lambda v: F.lit(255) - v).alias("b"),
    )


def picture_pixels(embeddings: DataFrame) -> DataFrame:
    """name, y, x, r, g, b of the same pictures, a row a pixel; where a tile is missing its samples are 128."""
    tiles = embeddings.where(F.size("embedding") == 64).select(F.floor(F.col("vec_id") / 6).alias("picture"), F.struct((F.col("vec_id") % 6).alias("i"), B.pixels(F.col("embedding")).alias("p")).alias("tile"))
    rows = tiles.groupBy("picture").agg(F.map_from_entries(F.collect_list("tile")).alias("tiles")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    rows = rows.select("picture", "i", F.posexplode(F.coalesce(F.element_at("tiles", F.col("i")), F.array_repeat(F.lit(128).cast("long"), 64))).alias("k", "v"), F.coalesce(F.element_at("tiles", F.col("i")), F.array_repeat(F.lit(128).cast("long"), 64)).alias("p"))
    y, x = F.floor(F.col("i") / 3) * 8 + F.floor(F.col("k") / 8), F.col("i") % 3 * 8 + F.col("k") % 8
    rows = rows.select(F.col("picture").cast("string").alias("name"), y.alias("y"), x.alias("x"), F.col("v").alias("r"), F.get("p", 63 - F.col("k")).alias("g"), (255 - F.col("v")).alias("b"))
    return rows.where("x < 21 AND y < 13")


def inside(values: Column) -> Column:
    """The samples of a tile that lie in the picture."""
    return F.filter(values, lambda _, i: (i % 8 < F.col("w")) & (F.floor(i / 8) < F.col("h")))


def quality(tiles: DataFrame) -> DataFrame:
    """picture, n, psnr_r, psnr_g, psnr_b, psnr_rgb (of the pooled errors), ssim_y (mean over tiles) of r, g, b against r2, g2, b2. One shuffle, of sums."""
    add = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
    times = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    luma = lambda k: F.zip_with(F.zip_with(f"r{k}", f"g{k}", lambda r, g: 77 * r + 150 * g), f"b{k}", lambda a, b: F.shiftright(a + 29 * b + 128, 8))
    rows = tiles.select("picture", *(inside(F.col(c)).alias(c) for c in ("r", "g", "b", "r2", "g2", "b2")))
    sse = [add(F.zip_with(c, f"{c}2", lambda x, y: (x - y) * (x - y))).alias(f"sse_{c}") for c in "rgb"]
    rows = rows.select("picture", *sse, luma("").alias("x"), luma("2").alias("y"))
    sums = [F.size("x").cast("long").alias("n"), add("x").alias("sx"), add("y").alias("sy"), *(add(times(a, b)).alias(f"s{a}{b}") for a, b in ("xx", "yy", "xy"))]
    rows = rows.select("picture", "sse_r", "sse_g", "sse_b", *sums).withColumn("ssim", P.ssim(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))))
    per = rows.groupBy("picture").agg(F.sum("n").alias("n"), *(F.sum(f"sse_{c}").alias(f"sse_{c}") for c in "rgb"), F.avg("ssim").alias("ssim"))
    pooled = F.col("sse_r") + F.col("sse_g") + F.col("sse_b")
    psnr = lambda e, n: F.round(B.psnr(e, n), 6)
    return per.select("picture", "n", *(psnr(F.col(f"sse_{c}"), F.col("n")).alias(f"psnr_{c}") for c in "rgb"), psnr(pooled, F.col("n") * 3).alias("psnr_rgb"), F.round("ssim", 6).alias("ssim_y"))

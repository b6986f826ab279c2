"""Queries over frame headers, predictors, filters and generated images."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import blocks as B
from lumenweave.functions import frames as H
from lumenweave.operators import blocks as O
from lumenweave.operators import images as I
from lumenweave.plans.blocks import _LEVELS, _PX, AC, DC

LIMIT = 40


def _frame(spark, sf_dir):
    return O.block_frame(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def keyframe_header(spark, sf_dir):
    """Headers made from ``part``, some of them damaged, then parsed."""
    n = F.col("p_partkey").cast("long")
    tag = F.when(n % 5 == 0, 1).otherwise(0) + n % 4 * 2 + n % 2 * 16 + n % 40 * 32
    code = F.when(n % 11 == 0, F.unhex(F.lit("9D012B"))).otherwise(F.unhex(F.lit(H.START_CODE)))
    width, height = n % 7 * 100 + n % 4 * 16384, n % 13 * 50 + n % 3 * 16384
    data = F.concat(B.little_endian(tag, 3), code, B.little_endian(width, 2), B.little_endian(height, 2), F.unhex(F.lit("00" * 30)))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", H.keyframe_header(data).alias("h")).select("p_partkey", "h.*")


def subblock_modes(spark, sf_dir):
    """The best of ten predictors for the 4x4 block at (1, 1), by absolute difference; the lowest of equal ones."""
    p = F.col("p")
    line = [p[8 + 8 * y] for y in reversed(range(4))] + [p[0]] + [p[min(1 + x, 7)] for x in range(8)]
    source = [p[9 + 8 * y + x] for y in range(4) for x in range(4)]
    rows = _frame(spark, sf_dir).select("vec_id", F.array(*source).alias("s"), F.array(*line).alias("line"))
    two, three = H.taps(F.col("line"))
    rows = rows.withColumn("two", two).withColumn("three", three).withColumn("mode", F.explode(F.sequence(F.lit(0), F.lit(9))))
    guess = F.lit(None)
    for i, own in enumerate(H.subblock_predictions(F.col("line"), F.col("two"), F.col("three"))):
        guess = F.when(F.col("mode") == i, own).otherwise(guess)
    costs = rows.select("vec_id", "mode", O.total(F.zip_with("s", guess, lambda v, w: F.abs(v - w))).alias("sad"))
    return costs.groupBy("vec_id").agg(F.min(F.struct("sad", "mode")).alias("best"), F.sum("sad").alias("all_sad")).select("vec_id", "best.mode", "best.sad", "all_sad")


def chroma_upsample(spark, sf_dir):
    """Each 8x8 block as a chroma plane of 16x16 samples, one row of samples a row."""
    rows = _frame(spark, sf_dir).select("vec_id", "p", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("y"))
    return rows.select("vec_id", "y", O.text([H.upsampled(F.col("p"), 8, F.col("y"), F.lit(x)) for x in range(16)]).alias("samples"))


def filter_params(spark, sf_dir):
    """Limits by level and sharpness, which are made of the parts' keys."""
    key = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (key % 64).alias("level"), (F.floor(key / 64) % 8).alias("sharpness"))
    interior, variance = H.filter_limits(F.col("level"), F.col("sharpness"))
    return rows.select("p_partkey", "level", "sharpness", interior.alias("interior"), variance.alias("variance"))


def edge_filter(spark, sf_dir):
    """The upright edge in the middle of each 8x8 block, filtered line by line."""
    rows = _frame(spark, sf_dir).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"), "p")
    p1, p0, q0, q1 = (F.get("p", F.col("y") * 8 + 2 + i) for i in range(4))
    new_p0, new_q0 = H.filtered_edge(p1, p0, q0, q1, LIMIT)
    return rows.select("vec_id", "y", new_p0.alias("p0"), new_q0.alias("q0"))


def skip_probability(spark, sf_dir):
    """Share, in 256ths, of 4x4 blocks with a nonzero level, by group of blocks."""
    step = lambda i: F.when(i == 0, DC).otherwise(AC).cast("long")
    levels = O.coefficients(O.sub_blocks(_frame(spark, sf_dir))).select((F.col("vec_id") % 10).alias("image"), F.transform("c", lambda v, i: B.quantized(v, step(i) * 4)).alias("q"))
    per = levels.groupBy("image").agg(F.count("*").alias("blocks"), F.count_if(~F.forall("q", lambda v: v == 0)).alias("coded"))
    return per.select("image", "blocks", "coded", B.clip(F.floor((F.col("coded") * 256 + F.floor(F.col("blocks") / 2)) / F.col("blocks")), 1, 255).alias("probability"))




def generate_patterns(spark, sf_dir):
    """Digest of a generated image for each part: its key chooses among solid, gradient, checker of 8 pixels, noise and diagonal, and the size, even or odd."""
    key = F.col("p_partkey")
    specs = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        key.alias("name"), F.get(F.array(*map(F.lit, I.GENERATED)), (key % 5).cast("int")).alias("pattern"), (key % 7 + 8).cast("long").alias("w"), (F.col("p_size") % 11 + 8).cast("long").alias("h"),
    )
    return I.generated(specs).select("name", F.sha2("rgb", 256).alias("sha"))


def lcg_noise(spark, sf_dir):
    """Four steps of the noise pattern's generator from each part's key: the channels of the last pixel."""
    state = F.col("p_partkey")
    for _ in range(4):
        state = (state * 1664525 + 1013904223).bitwiseAND(0xFFFFFFFF)
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("seed"), state.alias("state"))
    return rows.select("seed", "state", *(F.shiftright("state", 8 * i).bitwiseAND(255).alias(n) for i, n in enumerate("rgb")))


def _ppm(row):
    """A grey P6 file with a comment in its header; some are damaged: a wrong magic, a missing size, another maximum, a short raster."""
    n = F.col("vec_id")
    magic, width = F.when(n % 17 == 0, "P5").otherwise("P6"), F.when(n % 19 == 0, "x").otherwise("8")
    header = F.concat(magic, F.lit("\n# block "), F.repeat(n.cast("string"), (n % 40).cast("int") + 1), F.lit("\n"), width, F.lit(" 8\n"), F.when(n % 23 == 0, "65535").otherwise("255"), F.lit("\n"))
    samples = F.when(n % 29 == 0, F.slice("p", 1, 63)).otherwise(F.col("p"))
    raster = F.array_join(F.transform(samples, lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), F.lit(3))), "")
    return F.concat(F.encode(header, "utf-8"), F.unhex(raster))


def ppm_parse(spark, sf_dir):
    """P6 files of blocks, some damaged, read again: size, sum and count of sample bytes, or what is wrong. A header may be of any length: comments are cut out of
    the text, one character a byte, and what follows the fourth token and one white space is the raster."""
    rows = _frame(spark, sf_dir).select("vec_id", F.decode(_ppm(F.col("p")), "iso-8859-1").alias("raw"))
    found = F.regexp_extract_all("raw", F.lit(r"^(?:(?:\s|#[^\n]*\n)*([^\s#]+))(?:(?:\s|#[^\n]*\n)+([^\s#]+))(?:(?:\s|#[^\n]*\n)+([^\s#]+))(?:(?:\s|#[^\n]*\n)+([^\s#]+))\s"), F.lit(0))
    rows = rows.withColumn("head", F.get(found, F.lit(0))).withColumn("raster", F.expr("substring(raw, length(head) + 1)"))
    tokens = F.filter(F.split(F.regexp_replace("head", r"#[^\n]*\n", " "), r"\s+"), lambda t: t != "")
    rows = rows.withColumn("t", tokens)
    number = lambda i: F.expr(f"try_cast(t[{i}] AS BIGINT)")
    width, height, maximum = number(1), number(2), number(3)
    error = (
        F.when(F.col("head").isNull() | (F.col("t")[0] != "P6"), "magic")
        .when(width.isNull() | height.isNull() | (width < 1) | (height < 1), "size")
        .when(maximum.isNull() | (maximum != 255), "maximum")
        .when(F.length("raster") < width * height * 3, "short")
    )
    rows = rows.select("vec_id", width.alias("width"), height.alias("height"), maximum.alias("maximum"), error.alias("error"), "raster")
    bytes_ = F.transform(F.sequence(F.lit(1), F.length("raster")), lambda i: F.ascii(F.substring("raster", i, F.lit(1))).cast("long"))
    good = F.col("error").isNull()
    return rows.select("vec_id", "width", "height", "maximum", "error", F.when(good, F.length("raster").cast("long")).alias("samples"), F.when(good, O.total(bytes_)).alias("total"))


def expand_runs(spark, sf_dir):
    """(value, count) runs written out."""
    size, odd = F.col("p_size").cast("long"), F.col("p_partkey").cast("long") % 7
    runs = F.array(F.struct(size.alias("v"), F.lit(3).alias("n")), F.struct(odd.alias("v"), (F.col("p_partkey") % 4).cast("int").alias("n")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", O.text(F.flatten(F.transform(runs, lambda r: F.array_repeat(r["v"], r["n"])))).alias("expanded"))


_ALL = (keyframe_header, subblock_modes, chroma_upsample, filter_params, edge_filter, skip_probability, generate_patterns, lcg_noise, ppm_parse, expand_runs)
QUERIES = {f.__name__: f for f in _ALL}

_N = "n AS (SELECT p_partkey, CAST(p_partkey AS BIGINT) AS n FROM part)"
_LINE = _PX + ", ln AS (SELECT vec_id, p, [p[33], p[25], p[17], p[9], p[1], p[2], p[3], p[4], p[5], p[6], p[7], p[8], p[8]] AS e FROM px)"
_TAPS = """, w AS (SELECT vec_id, p, e, list_transform(range(1, 13), lambda i: (e[i] + e[i + 1] + 1) >> 1) AS t2, list_transform(range(1, 14), lambda i: (e[greatest(i -
 1, 1)] + 2 * e[i] + e[least(i + 1, 13)] + 2) >> 2) AS t3 FROM ln),
g AS (SELECT m, k // 4 AS y, k % 4 AS x FROM (SELECT unnest(range(0, 10)) AS m), (SELECT unnest(range(0, 16)) AS k)),
pr AS (SELECT vec_id, m, p[10 + 8 * y + x] AS s, CASE m
 WHEN 0 THEN (e[1] + e[2] + e[3] + e[4] + e[6] + e[7] + e[8] + e[9] + 4) >> 3
 WHEN 1 THEN least(255, greatest(0, e[4 - y] + e[6 + x] - e[5]))
 WHEN 2 THEN t3[6 + x] WHEN 3 THEN t3[4 - y] WHEN 4 THEN t3[7 + y + x] WHEN 5 THEN t3[5 - y + x]
 WHEN 6 THEN CASE WHEN y = 2 AND x = 0 THEN t3[4] WHEN y = 3 AND x = 0 THEN t3[3] WHEN y = 0 THEN t2[5 + x] WHEN y = 1 THEN t3[5 + x] WHEN y = 2 THEN t2[4 + x] ELSE t3[4 + x] END
 WHEN 7 THEN CASE WHEN y = 0 THEN t2[6 + x] WHEN y = 1 THEN t3[7 + x] WHEN y = 2 AND x < 3 THEN t2[7 + x] WHEN y = 3 AND x < 3 THEN t3[8 + x] WHEN y = 2 THEN t3[11] ELSE t3[12] END
 WHEN 8 THEN [t2[4], t3[5], t3[6], t3[7], t2[3], t3[4], t2[4], t3[5], t2[2], t3[3], t2[3], t3[4], t2[1], t3[2], t2[2], t3[3]][4 * y + x + 1]
 ELSE [t2[3], t3[3], t2[2], t3[2], t2[2], t3[2], t2[1], t3[1], t2[1], t3[1], e[1], e[1], e[1], e[1], e[1], e[1]][4 * y + x + 1] END AS v FROM w, g),
co AS (SELECT vec_id, CAST(m AS INTEGER) AS mode, CAST(sum(abs(s - v)) AS BIGINT) AS sad FROM pr GROUP BY 1, 2)"""
_STEP4 = f"(4 * (CASE WHEN i = 1 THEN {DC} ELSE {AC} END))"
SQL = {
    "keyframe_header": f"""WITH {_N} SELECT p_partkey, n % 4 + 8 * 0 AS profile, n % 2 AS shown, n % 40 AS first_partition, n % 7 * 100 AS width, n % 13 * 50 AS height, n
 % 4 AS x_scale, n % 3 AS y_scale, CASE WHEN n % 5 = 0 THEN 'not a key frame' WHEN n % 11 = 0 THEN 'start code' WHEN n % 7 = 0 OR n % 13 = 0 THEN 'size' WHEN n % 40 > 30
 THEN 'partition' END AS error FROM n""",
    "subblock_modes": f"WITH {_LINE}{_TAPS} SELECT vec_id, arg_min(mode, sad * 16 + mode) AS mode, min(sad) AS sad, CAST(sum(sad) AS BIGINT) AS all_sad FROM co GROUP BY 1",
    "chroma_upsample": f"""WITH {_PX}, g AS (SELECT y, x, least(7, greatest(0, y // 2 + CASE WHEN y % 2 = 1 THEN 1 ELSE -1 END)) AS r, least(7, greatest(0, x // 2 + CASE
 WHEN x % 2 = 1 THEN 1 ELSE -1 END)) AS c FROM (SELECT unnest(range(0, 16)) AS y), (SELECT unnest(range(0, 16)) AS x)), f AS (SELECT vec_id, y, x, p[y // 2 * 8 + x // 2 +
 1] AS a, p[y // 2 * 8 + c + 1] AS b, p[r * 8 + x // 2 + 1] AS d, p[r * 8 + c + 1] AS o FROM px, g) SELECT vec_id, CAST(y AS INTEGER) AS y, string_agg(CAST((((a + b + d +
 o + 8 + 2 * (b + d)) >> 3) + a) >> 1 AS VARCHAR), ',' ORDER BY x) AS samples FROM f GROUP BY 1, 2""",
    "filter_params": """SELECT p_partkey, level, sharpness, greatest(1, CASE WHEN sharpness = 0 THEN level ELSE least(9 - sharpness, CASE WHEN sharpness > 4 THEN level // 4 ELSE level // 2 END) END) AS interior,
 CAST((level >= 15)::INT + (level >= 40)::INT AS INTEGER) AS variance FROM (SELECT p_partkey, p_partkey % 64 AS level, p_partkey // 64 % 8 AS sharpness FROM part)""",
    "edge_filter": f"""WITH {_PX}, e AS (SELECT vec_id, CAST(y AS INTEGER) AS y, p[y * 8 + 3] AS p1, p[y * 8 + 4] AS p0, p[y * 8 + 5] AS q0, p[y * 8 + 6] AS q1 FROM px,
 (SELECT unnest(range(0, 8)) AS y)), a AS (SELECT *, least(127, greatest(-128, least(127, greatest(-128, p1 - q1)) + 3 * (q0 - p0))) AS a, abs(p0 - q0) * 2 + abs(p1 - q1)
 // 2 <= {LIMIT} AS ok FROM e) SELECT vec_id, y, CASE WHEN ok THEN least(255, greatest(0, p0 + (least(127, a + 3) >> 3))) ELSE p0 END AS p0, CASE WHEN ok THEN least(255,
 greatest(0, q0 - (least(127, a + 4) >> 3))) ELSE q0 END AS q0 FROM a""",
    "skip_probability": f"""WITH {_LEVELS}, z AS (SELECT vec_id % 10 AS image, len(list_filter(range(1, 17), lambda i: (abs(c[i]) + {_STEP4} // 2) // {_STEP4} <> 0)) > 0
 AS coded FROM lv), s AS (SELECT image, count(*) AS blocks, count(*) FILTER (coded) AS coded FROM z GROUP BY 1) SELECT image, blocks, coded, least(255, greatest(1, (coded
 * 256 + blocks // 2) // blocks)) AS probability FROM s""",
    "generate_patterns": """WITH sp AS (SELECT p_partkey AS name, p_partkey % 5 AS pattern, p_partkey % 7 + 8 AS w, p_size % 11 + 8 AS h FROM part),
 gr AS (SELECT *, id // w AS y, id % w AS x FROM (SELECT *, unnest(range(0, w * h)) AS id FROM sp)),
 nz AS (SELECT *, CASE WHEN pattern = 3 THEN list_reduce([1] || range(0, id + 1), lambda a, i: (a * 1664525 + 1013904223) % 4294967296) END AS z, CASE WHEN abs(x - y) <= 1 THEN 255 ELSE 0 END AS d, 255 * ((x // 8 + y // 8) % 2) AS c FROM gr),
 px AS (SELECT name, id, CASE pattern WHEN 0 THEN 17 WHEN 1 THEN x * 255 // (w - 1) WHEN 2 THEN c WHEN 3 THEN z & 255 ELSE d END AS r, CASE pattern WHEN 0 THEN 34 WHEN 1 THEN y * 255 // (h - 1) WHEN 2 THEN c WHEN 3 THEN (z >> 8) & 255 ELSE d END AS g,
  CASE pattern WHEN 0 THEN 51 WHEN 1 THEN (x + y) * 255 // (w + h - 2) WHEN 2 THEN c WHEN 3 THEN (z >> 16) & 255 ELSE d END AS b FROM nz)
 SELECT name, sha256(unhex(string_agg(printf('%02x%02x%02x', r, g, b), '' ORDER BY id))) AS sha FROM px GROUP BY 1""",
    "lcg_noise": """WITH s AS (SELECT p_partkey AS seed, list_reduce([p_partkey, 0, 0, 0, 0], lambda a, x: (a * 1664525 + 1013904223) % 4294967296) AS state FROM part)
 SELECT seed, state, state & 255 AS r, (state >> 8) & 255 AS g, (state >> 16) & 255 AS b FROM s""",
    "ppm_parse": f"""WITH {_PX}, e AS (SELECT vec_id, p, vec_id % 19 = 0 AS no_size, CASE WHEN vec_id % 17 = 0 THEN 'magic' WHEN vec_id % 19 = 0 THEN 'size'
 WHEN vec_id % 23 = 0 THEN 'maximum' WHEN vec_id % 29 = 0 THEN 'short' END AS error FROM px)
SELECT vec_id, CASE WHEN no_size THEN NULL ELSE CAST(8 AS BIGINT) END AS width, CAST(8 AS BIGINT) AS height, CAST(CASE WHEN vec_id % 23 = 0 THEN 65535 ELSE 255 END AS BIGINT) AS maximum,
 error, CASE WHEN error IS NULL THEN CAST(192 AS BIGINT) END AS samples, CASE WHEN error IS NULL THEN CAST(3 * list_sum(p) AS BIGINT) END AS total FROM e""",
    "expand_runs": """SELECT p_partkey, array_to_string(flatten([list_transform(range(0, 3), lambda i: CAST(p_size AS BIGINT)), list_transform(range(0, p_partkey % 4),
 lambda i: CAST(p_partkey % 7 AS BIGINT))]), ',') AS expanded FROM part""",
}

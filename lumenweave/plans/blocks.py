"""Queries over 8x8 blocks made from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import blocks as B
from lumenweave.functions.tables import AC_STEPS, DC_STEPS
from lumenweave.operators import blocks as O
from lumenweave.operators.blocks import text

Q75 = 26
DC, AC = DC_STEPS[Q75], AC_STEPS[Q75]


def _frame(spark, sf_dir):
    return O.block_frame(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _subs(spark, sf_dir):
    return O.sub_blocks(_frame(spark, sf_dir))


def _coded(spark, sf_dir):
    return O.coefficients(_subs(spark, sf_dir))


def _distorted():
    """Every sample to the nearest multiple of 16."""
    return F.transform("p", lambda v: B.clip(F.floor((v + 8) / 16) * 16, 0, 255))


def block_quality(spark, sf_dir):
    rows = _frame(spark, sf_dir).withColumn("q", _distorted())
    sse = O.total(F.zip_with("p", "q", lambda v, w: (v - w) * (v - w)))
    rows = rows.select("vec_id", sse.alias("sse"), O.block_ssim(F.col("p"), F.col("q")).alias("ssim"))
    return rows.select("vec_id", "sse", F.round(B.psnr(F.col("sse"), 64), 6).alias("psnr"), F.round("ssim", 6).alias("ssim"))


def block_sad(spark, sf_dir):
    rows = _frame(spark, sf_dir).withColumn("q", _distorted())
    rows = rows.select("vec_id", F.zip_with("p", "q", lambda v, w: v - w).alias("d"))
    weight = lambda i: 1 + (i % 8 == 7).cast("int") + (i >= 56).cast("int")
    squares = F.transform("d", lambda v: v * v)
    return rows.select("vec_id", O.total(F.transform("d", F.abs)).alias("sad"), O.total(squares).alias("sse"), O.total(F.transform("d", lambda v, i: v * v * weight(i))).alias("sse_edge"))


def block_satd(spark, sf_dir):
    rows = _subs(spark, sf_dir).select("vec_id", "k", F.transform("s", lambda v: v - 128).alias("d"))
    return O.hadamard_cost(rows, "d", "satd").select("vec_id", "k", "satd")


def fdct4x4(spark, sf_dir):
    return _coded(spark, sf_dir).select("vec_id", "k", text(F.col("c")).alias("coefficients"))


def idct4x4(spark, sf_dir):
    return O.transformed(_coded(spark, sf_dir), "c", B.INVERSE_DCT, "r").select("vec_id", "k", text(F.col("r")).alias("residual"))


def fwht(spark, sf_dir):
    return O.transformed(_subs(spark, sf_dir), "s", B.FORWARD_WHT).select("vec_id", "k", text(F.col("c")).alias("coefficients"))


def iwht(spark, sf_dir):
    return O.transformed(_subs(spark, sf_dir), "s", B.INVERSE_WHT).select("vec_id", "k", text(F.col("c")).alias("restored"))


def quantize(spark, sf_dir):
    return _coded(spark, sf_dir).select("vec_id", "k", text(F.transform("c", lambda v, i: B.quantized(v, F.when(i == 0, DC).otherwise(AC).cast("long")))).alias("levels"))


def dequantize(spark, sf_dir):
    step = lambda i: F.when(i == 0, DC).otherwise(AC).cast("long")
    return _coded(spark, sf_dir).select("vec_id", "k", text(F.transform("c", lambda v, i: B.wrap16(B.quantized(v, step(i)) * step(i)))).alias("restored"))


def deadzone(spark, sf_dir):
    return _coded(spark, sf_dir).select("vec_id", "k", text(F.transform("c", lambda v, i: F.when(i == 0, B.quantized(v, DC)).otherwise(B.deadzone(v, AC)))).alias("levels"))


def token_class(spark, sf_dir):
    rows = _coded(spark, sf_dir).select("k", F.posexplode("c").alias("i", "v"))
    return rows.groupBy("k", B.token_class(F.abs("v")).alias("token")).agg(F.count("*").alias("n"))


def nonzero_stats(spark, sf_dir):
    rows = _coded(spark, sf_dir).select("vec_id", "k", F.transform("c", lambda v, i: B.quantized(v, F.when(i == 0, DC).otherwise(AC).cast("long"))).alias("q"))
    return rows.groupBy("k").agg(
        F.count("*").alias("blocks"), F.count_if(F.exists("q", lambda v: v != 0)).alias("blocks_nonzero"),
        F.sum(F.size(F.filter("q", lambda v: v != 0))).cast("long").alias("nonzero"), F.max(F.array_max(F.transform("q", F.abs))).alias("abs_max"),
    )


def mode_argmin(spark, sf_dir):
    return O.best_modes(O.mode_residuals(_frame(spark, sf_dir)))


def satd_topk(spark, sf_dir):
    return O.pruned_modes(O.mode_residuals(_frame(spark, sf_dir)), 2)


def mode_histogram(spark, sf_dir):
    return mode_argmin(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("n"))


def segment_sad_rollup(spark, sf_dir):
    rows = _frame(spark, sf_dir).select((F.col("label") % 4).alias("segment"), B.total(F.abs(F.col("p")[i] - 128) for i in range(64)).alias("sad"))
    return rows.rollup("segment").agg(F.sum("sad").alias("sad"), F.count("*").alias("blocks")).where("blocks > 0")


def column_mean(spark, sf_dir):
    rows = _frame(spark, sf_dir).select(F.posexplode("p").alias("i", "v"))
    return rows.groupBy((F.col("i") % 8).alias("x")).agg(F.sum("v").alias("total"), F.round(F.avg("v"), 6).alias("mean"))


def phase_mean(spark, sf_dir):
    phases = _frame(spark, sf_dir).select(F.posexplode("p").alias("i", "v")).groupBy((F.col("i") % 4).alias("phase")).agg(F.avg("v").alias("m"))
    return phases.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("rms"), F.round(F.min("m"), 6).alias("least"), F.round(F.max("m"), 6).alias("most"))


def rgb_to_yuv(spark, sf_dir):
    rows = _frame(spark, sf_dir).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"), "p")
    r, g, b = (F.col("p")[F.col("i") * 3 + j] for j in range(3))
    return rows.select(
        "vec_id", "i", *(c.alias(n) for c, n in zip(B.rgb_to_yuv(r, g, b), "yuv", strict=True)), B.luma(r, g, b).alias("luma"),
        F.shiftright(77 * r + 150 * g + 29 * b, 8).alias("luma_floor"),
    )


def yuv_to_rgb(spark, sf_dir):
    rows = _frame(spark, sf_dir).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"), "p")
    y, u, v = (F.col("p")[F.col("i") * 3 + j] for j in range(3))
    return rows.select("vec_id", "i", *(c.alias(n) for c, n in zip(B.yuv_to_rgb(y, u, v), "rgb", strict=True)))


def fnv1a64(spark, sf_dir):
    return _frame(spark, sf_dir).select("vec_id", B.fnv1a(F.transform("p", lambda v: v - 128)).alias("fnv"))


def adler32(spark, sf_dir):
    return _frame(spark, sf_dir).select("vec_id", B.adler32(F.col("p")).alias("adler"))


def pixel_compare(spark, sf_dir):
    """Samples of each block against the next block's: the largest and the total difference. Blocks are joined, not their samples."""
    rows = _frame(spark, sf_dir).select("vec_id", "p")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    away = rows.join(other, "vec_id").select("vec_id", F.zip_with("p", "q", lambda v, w: F.abs(v - w)).alias("d"))
    return away.select("vec_id", F.array_max("d").alias("max_abs"), O.total(F.col("d")).alias("sad"), F.size("d").cast("long").alias("n"))


_ALL = (
    block_quality, block_sad, block_satd, fdct4x4, idct4x4, fwht, iwht, quantize, dequantize, deadzone, token_class, nonzero_stats, mode_argmin, satd_topk,
    mode_histogram, segment_sad_rollup, column_mean, phase_mean, rgb_to_yuv, yuv_to_rgb, fnv1a64, adler32, pixel_compare,
)
QUERIES = {f.__name__: f for f in _ALL}

_PX = "px AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 0.5) * 255))) AS BIGINT)) AS p FROM embeddings)"
_PQ = _PX + """, pq AS (SELECT vec_id, list_transform(range(1, 65), lambda i: p[i] - least(255, (p[i] + 8) // 16 * 16)) AS d, p, list_transform(p, lambda v: least(255,
 (v + 8) // 16 * 16)) AS q FROM px)"""
_SUB = _PX + ", sub AS (SELECT vec_id, k, list_transform(range(0, 16), lambda j: p[(k // 2) * 32 + (j // 4) * 8 + (k % 2) * 4 + (j % 4) + 1]) AS s FROM px, (SELECT unnest(range(0, 4)) AS k))"
_RES = _SUB + ", r AS (SELECT vec_id, k, list_transform(s, lambda v: v - 128) AS s FROM sub)"


def _pass(source: str, into: str, column: str, out: str, rows: bool, formulas: list[str]) -> str:
    """One pass of a separable transform: along rows, or along columns and laid back row by row. In a formula, {0} to {3} are the line's values."""
    place = (lambda j: f"{column}[4 * i + {j + 1}]") if rows else (lambda j: f"{column}[i + {4 * j + 1}]")
    values = ", ".join(f.format(*(place(j) for j in range(4))) for f in formulas)
    lines = f"flatten(list_transform(range(0, 4), lambda i: [{values}]))"
    if not rows:
        lines = f"list_transform(range(0, 16), lambda j: ({lines})[(j % 4) * 4 + j // 4 + 1])"
    return f"{into} AS (SELECT vec_id, k, {lines} AS {out} FROM {source})"


DCT_ROWS = [
    "({0}+{1}+{2}+{3})*8",
    "((({1}-{2})*2217+({0}-{3})*5352+1812)>>9)",
    "({0}+{3}-{1}-{2})*8",
    "((({0}-{3})*2217-({1}-{2})*5352+937)>>9)",
]
DCT_COLUMNS = [
    "(({0}+{1}+{2}+{3}+7)>>4)",
    "((({1}-{2})*2217+({0}-{3})*5352+12000)>>16)+CAST({0}<>{3} AS BIGINT)",
    "(({0}+{3}-{1}-{2}+7)>>4)",
    "((({0}-{3})*2217-({1}-{2})*5352+51000)>>16)",
]
_DCT = _RES + ", " + _pass("r", "t", "s", "t", True, DCT_ROWS) + ", " + _pass("t", "dct", "t", "c", False, DCT_COLUMNS)
_LINE = [
    "{0}+{2}+(({1}+(({1}*20091)>>16))+(({3}*35468)>>16))", "{0}-{2}+((({1}*35468)>>16)-({3}+(({3}*20091)>>16)))",
    "{0}-{2}-((({1}*35468)>>16)-({3}+(({3}*20091)>>16)))", "{0}+{2}-(({1}+(({1}*20091)>>16))+(({3}*35468)>>16))",
]
WHT = ["{0}+{2}+{1}+{3}", "{0}-{2}+{1}-{3}", "{0}-{2}-{1}+{3}", "{0}+{2}-{1}-{3}"]
_IWHT = ["{0}+{3}+{1}+{2}", "{1}-{2}+{0}-{3}", "{0}+{3}-{1}-{2}", "{0}-{3}-{1}+{2}"]
_HAD = ["{0}+{3}+{1}+{2}", "{0}-{3}+{1}-{2}", "{0}+{3}-{1}-{2}", "{0}-{3}-{1}+{2}"]
_STEP = f"(CASE WHEN i = 1 THEN {DC} ELSE {AC} END)"
_LEVEL = f"sign(c[i]) * ((abs(c[i]) + {_STEP} // 2) // {_STEP})"
_LEVELS = _DCT + f", lv AS (SELECT vec_id, k, c, list_transform(range(1, 17), lambda i: CAST({_LEVEL} AS BIGINT)) AS q FROM dct)"
_SSIM = "((2*mx*my + 6.5025) * (2*(sxy/64 - mx*my) + 58.5225)) / ((mx*mx + my*my + 6.5025) * (sxx/64 - mx*mx + syy/64 - my*my + 58.5225))"
_MODES = _PX + """, mid AS (SELECT vec_id, p, (p[29]+p[30]+p[31]+p[32]+p[36]+p[44]+p[52]+p[60]+4)>>3 AS m FROM px),
pr AS (SELECT vec_id, mode, list_transform(range(0, 16), lambda j: p[(4 + j // 4) * 8 + 4 + j % 4 + 1] - (CASE mode WHEN 0 THEN m WHEN 1 THEN p[29 + j % 4] WHEN 2 THEN
 p[(4 + j // 4) * 8 + 4] ELSE least(255, greatest(0, p[(4 + j // 4) * 8 + 4] + p[29 + j % 4] - p[28])) END)) AS s, 0 AS k FROM mid, (SELECT unnest(range(0, 4)) AS mode)),
ps AS (SELECT vec_id, mode AS k, s FROM pr), """ + _pass("ps", "h1", "s", "s", True, _HAD) + ", " + _pass("h1", "h2", "s", "s", False, _HAD) + """,
mc AS (SELECT ps.vec_id, CAST(ps.k AS INTEGER) AS mode, CAST(list_sum(list_transform(ps.s, lambda v: abs(v))) AS BIGINT) AS sad, (CAST(list_sum(list_transform(h2.s,
 lambda v: abs(v))) AS BIGINT) + 1) >> 1 AS satd FROM ps JOIN h2 ON ps.vec_id = h2.vec_id AND ps.k = h2.k)"""
_BEST = _MODES + ", best AS (SELECT vec_id, mode, sad FROM mc QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sad, mode) = 1)"
_I = "CAST(k AS INTEGER) AS k"
_TRI = _PX + ", tri AS (SELECT vec_id, CAST(i AS INTEGER) AS i, p[3*i+1] AS a, p[3*i+2] AS b, p[3*i+3] AS c FROM px, (SELECT unnest(range(0, 21)) AS i))"
_UNITS = _PX + ", pix AS (SELECT vec_id, CAST(i AS INTEGER) AS i, p[i + 1] AS v FROM px, (SELECT unnest(range(0, 64)) AS i))"
SQL = {
    "block_quality": f"""WITH {_PQ}, m AS (SELECT vec_id, CAST(list_sum(list_transform(d, lambda v: v*v)) AS BIGINT) AS sse, list_sum(p)/64.0 AS mx, list_sum(q)/64.0 AS
 my, CAST(list_sum(list_transform(p, lambda v: v*v)) AS DOUBLE) AS sxx, CAST(list_sum(list_transform(q, lambda v: v*v)) AS DOUBLE) AS syy,
 CAST(list_sum(list_transform(range(1,65), lambda i: p[i]*q[i])) AS DOUBLE) AS sxy FROM pq) SELECT vec_id, sse, round(CASE WHEN sse = 0 THEN CAST('inf' AS DOUBLE) ELSE
 10*log10(65025.0/(sse/64)) END, 6) AS psnr, round({_SSIM}, 6) AS ssim FROM m""",
    "block_sad": f"""WITH {_PQ} SELECT vec_id, CAST(list_sum(list_transform(d, lambda v: abs(v))) AS BIGINT) AS sad, CAST(list_sum(list_transform(d, lambda v: v*v)) AS
 BIGINT) AS sse, CAST(list_sum(list_transform(range(1,65), lambda i: d[i]*d[i]*(1 + CAST((i-1)%8=7 AS BIGINT) + CAST((i-1)//8=7 AS BIGINT)))) AS BIGINT) AS sse_edge FROM
 pq""",
    "block_satd": f"""WITH {_RES}, {_pass('r', 'a', 's', 's', True, _HAD)}, {_pass('a', 'b', 's', 's', False, _HAD)} SELECT vec_id, {_I}, (CAST(list_sum(list_transform(s,
 lambda v: abs(v))) AS BIGINT) + 1) >> 1 AS satd FROM b""",
    "fdct4x4": f"WITH {_DCT} SELECT vec_id, {_I}, array_to_string(c, ',') AS coefficients FROM dct",
    "idct4x4": f"""WITH {_DCT}, {_pass('dct', 'a', 'c', 'c', False, _LINE)}, {_pass('a', 'b', 'c', 'c', True, [f'(({x}+4)>>3)' for x in _LINE])} SELECT vec_id, {_I},
 array_to_string(c, ',') AS residual FROM b""",
    "fwht": f"""WITH {_SUB}, {_pass('sub', 'a', 's', 's', True, WHT)}, {_pass('a', 'b', 's', 's', False, [f'(({x})>>1)' for x in WHT])} SELECT vec_id, {_I},
 array_to_string(s, ',') AS coefficients FROM b""",
    "iwht": f"""WITH {_SUB}, {_pass('sub', 'a', 's', 's', False, _IWHT)}, {_pass('a', 'b', 's', 's', True, [f'(({x}+3)>>3)' for x in _IWHT])} SELECT vec_id, {_I},
 array_to_string(s, ',') AS restored FROM b""",
    "quantize": f"WITH {_LEVELS} SELECT vec_id, {_I}, array_to_string(q, ',') AS levels FROM lv",
    "dequantize": f"WITH {_LEVELS} SELECT vec_id, {_I}, array_to_string(list_transform(range(1, 17), lambda i: q[i] * {_STEP}), ',') AS restored FROM lv",
    "deadzone": f"""WITH {_LEVELS} SELECT vec_id, {_I}, array_to_string(list_transform(range(1, 17), lambda i: CASE WHEN i > 1 AND abs(c[i]) * 100 < {AC} * 60 THEN 0 ELSE
 q[i] END), ',') AS levels FROM lv""",
    "token_class": f"""WITH {_DCT}, v AS (SELECT k, abs(unnest(c)) AS a FROM dct) SELECT {_I}, CAST(CASE WHEN a <= 4 THEN a WHEN a <= 6 THEN 5 WHEN a <= 10 THEN 6 WHEN a
 <= 18 THEN 7 WHEN a <= 34 THEN 8 WHEN a <= 66 THEN 9 ELSE 10 END AS BIGINT) AS token, count(*) AS n FROM v GROUP BY 1, 2""",
    "nonzero_stats": f"""WITH {_LEVELS} SELECT {_I}, count(*) AS blocks, count(*) FILTER (len(list_filter(q, lambda v: v <> 0)) > 0) AS blocks_nonzero,
 CAST(sum(len(list_filter(q, lambda v: v <> 0))) AS BIGINT) AS nonzero, max(list_max(list_transform(q, lambda v: abs(v)))) AS abs_max FROM lv GROUP BY k""",
    "mode_argmin": f"WITH {_BEST} SELECT vec_id, mode, sad FROM best",
    "satd_topk": f"WITH {_MODES} SELECT vec_id, mode, satd, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY satd, mode) AS INTEGER) AS place FROM mc QUALIFY place <= 2",
    "mode_histogram": f"WITH {_BEST} SELECT mode, count(*) AS n FROM best GROUP BY mode",
    "segment_sad_rollup": f"""WITH {_PX} SELECT label % 4 AS segment, CAST(sum(list_sum(list_transform(p, lambda v: abs(v - 128)))) AS BIGINT) AS sad, count(*) AS blocks
 FROM px GROUP BY ROLLUP (label % 4)""",
    "column_mean": f"WITH {_UNITS} SELECT i % 8 AS x, CAST(sum(v) AS BIGINT) AS total, round(avg(v), 6) AS mean FROM pix GROUP BY 1",
    "phase_mean": f"""WITH {_UNITS}, f AS (SELECT i % 4 AS phase, avg(v) AS m FROM pix GROUP BY 1) SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS rms,
 round(min(m), 6) AS least, round(max(m), 6) AS most FROM f""",
    "rgb_to_yuv": f"""WITH {_TRI} SELECT vec_id, i, (16839*a + 33059*b + 6420*c + 32768 + 1048576) >> 16 AS y, least(255, greatest(0, (4*(-9719*a - 19081*b + 28800*c) +
 131072 + 33554432) >> 18)) AS u, least(255, greatest(0, (4*(28800*a - 24116*b - 4684*c) + 131072 + 33554432) >> 18)) AS v, (77*a + 150*b + 29*c + 128) >> 8 AS luma,
 (77*a + 150*b + 29*c) >> 8 AS luma_floor FROM tri""",
    "yuv_to_rgb": f"""WITH {_TRI} SELECT vec_id, i, least(255, greatest(0, (((a*19077)>>8) + ((c*26149)>>8) - 14234) >> 6)) AS r, least(255, greatest(0, (((a*19077)>>8) -
 ((b*6419)>>8) - ((c*13320)>>8) + 8708) >> 6)) AS g, least(255, greatest(0, (((a*19077)>>8) + ((b*33050)>>8) - 17685) >> 6)) AS b FROM tri""",
    "fnv1a64": f"""WITH {_PX}, fed AS (SELECT vec_id, flatten(list_transform(p, lambda v: [CAST(((v-128) >> s) & 255 AS HUGEINT) for s in [0, 8, 16, 24]])) AS l FROM px)
 SELECT vec_id, format('{{:016x}}', CAST(list_reduce(l, lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616, CAST(1469598103934665603 AS HUGEINT)) AS
 UBIGINT)) AS fnv FROM fed""",
    "adler32": f"WITH {_PX} SELECT vec_id, CAST(((64 + list_sum(list_transform(range(1, 65), lambda i: (65 - i) * p[i]))) % 65521) * 65536 + (1 + list_sum(p)) % 65521 AS BIGINT) AS adler FROM px",
    "pixel_compare": f"""WITH {_UNITS} SELECT a.vec_id, max(abs(a.v - b.v)) AS max_abs, CAST(sum(abs(a.v - b.v)) AS BIGINT) AS sad, count(*) AS n FROM pix a JOIN pix b ON
 b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1""",
}

"""Queries over whole images: the test corpus, planes, transform dumps, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import blocks as B
from lumenweave.functions import planes as P
from lumenweave.functions.tables import AC_STEPS, DC_STEPS, qindex
from lumenweave.operators import blocks as O
from lumenweave.operators import halo as N
from lumenweave.operators import images as I
from lumenweave.operators import rate_distortion as R
from lumenweave.plans.blocks import _PX, DCT_COLUMNS, DCT_ROWS, WHT, _pass
from lumenweave.plans.halo import MACROBLOCKS

QUALITIES = (0, 10, 50, 75, 90, 100)


def _pixels(spark, sf_dir):
    """Pixels of pictures of 21x13 that are made of ``embeddings``."""
    return I.picture_pixels(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def corpus_pixels(spark, sf_dir):
    """Every pixel of every picture."""
    return _pixels(spark, sf_dir)


def _digests(pixels):
    rgb = I.digest(pixels, "name", F.struct("y", "x"), I.little_endian_hex(F.array("r", "g", "b"), 1)).withColumnRenamed("sha", "rgb_sha")
    yuv = I.digest(I.i420(pixels), "name", F.struct(F.translate("plane", "yuv", "123"), "y", "x"), I.little_endian_hex(F.array("v"), 1)).withColumnRenamed("sha", "yuv_sha")
    return rgb.join(yuv, "name")


def corpus_digests(spark, sf_dir):
    """SHA-256 of each picture's RGB bytes, and of its planes Y, U, V."""
    return _digests(_pixels(spark, sf_dir))


def gamma_tables(spark, sf_dir):
    """Sums of four linear samples, by part, and four times the sample they stand for."""
    linear = F.col("p_partkey") * 13 % 16381
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", linear.alias("linear"), P.to_gamma(linear).alias("four"), P.to_linear(linear % 256).alias("of_sample"))


def rgb_to_i420(spark, sf_dir):
    """Planes of the pictures; odd sizes repeat their edges."""
    return I.i420(_pixels(spark, sf_dir))


def plane_dump(spark, sf_dir):
    """SHA-256 of the planes' bytes of each picture, padded to whole macroblocks."""
    return I.digest(I.padded(rgb_to_i420(spark, sf_dir)), "name", F.struct(F.translate("plane", "yuv", "123"), "y", "x"), I.little_endian_hex(F.array("v"), 1))


def _dump(spark, sf_dir):
    return I.transform_dump(I.padded(I.i420(_pixels(spark, sf_dir))))


def transform_dump(spark, sf_dir):
    """Coefficients of every 4x4 block, with flat prediction and a second transform of the luma blocks' first coefficients."""
    return _dump(spark, sf_dir).select("name", "plane", "my", "mx", "k", O.text(F.col("c")).alias("coefficients"))


def dump_steps(q: int) -> dict[str, tuple[int, int]]:
    """First and other steps by plane."""
    dc, ac = DC_STEPS[q], AC_STEPS[q]
    return {"y2": (2 * dc, max(8, ac * 155 // 100)), "y": (dc, ac), "u": (min(132, dc), ac), "v": (min(132, dc), ac)}


def quantized_dump(dump):
    """The dump's coefficients as levels, for six qualities; halves go away from zero and nothing is clamped."""
    steps = F.array(*(F.struct(F.lit(quality).alias("q"), F.lit(plane).alias("p"), F.lit(dc).cast("long").alias("dc"), F.lit(ac).cast("long").alias("ac")) for quality in QUALITIES for plane, (dc, ac) in dump_steps(qindex(quality)).items()))
    rows = dump.withColumn("s", F.explode(F.filter(steps, lambda s: s["p"] == F.col("plane"))))
    step = lambda i: F.when(i == 0, F.col("s.dc")).otherwise(F.col("s.ac"))
    level = F.transform("c", lambda v, i: (F.signum(v) * F.floor((F.abs(v) + F.floor(step(i) / 2)) / step(i))).cast("long"))
    return rows.select("name", "plane", "my", "mx", "k", "s.q", level.alias("c"))


def quantized_levels(spark, sf_dir):
    return quantized_dump(_dump(spark, sf_dir)).select("name", "q", "plane", "my", "mx", "k", O.text(F.col("c")).alias("levels"))


def plane_nonzero(spark, sf_dir):
    """Blocks, blocks with a nonzero level and nonzero levels by image, quality and plane."""
    some = F.size(F.filter("c", lambda v: v != 0)).cast("long")
    rows = quantized_dump(_dump(spark, sf_dir)).select("name", "q", "plane", some.alias("some"))
    return rows.groupBy("name", "q", "plane").agg(F.count("*").alias("blocks"), F.count_if(F.col("some") > 0).alias("blocks_nonzero"), F.sum("some").alias("nonzero"))


def ordered_hash(spark, sf_dir):
    """FNV-1a over all coefficients of an image, folded in the order of macroblock, plane and block."""
    order = F.struct("my", "mx", F.element_at(F.create_map(*(F.lit(x) for kv in (("y2", 0), ("y", 1), ("u", 2), ("v", 3)) for x in kv)), F.col("plane")).alias("plane"), "k")
    rows = _dump(spark, sf_dir).groupBy("name").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "c"))).alias("blocks"))
    return rows.select("name", B.fnv1a(F.flatten(F.transform("blocks", lambda b: b["c"]))).alias("fnv"))


def zigzag_levels(spark, sf_dir):
    """Coefficients in the order they are coded."""
    from lumenweave.functions.tables import ZIGZAG

    scanned = F.transform(F.array(*map(F.lit, ZIGZAG)), lambda i: F.get("c", i))
    return _dump(spark, sf_dir).where("plane <> 'y2'").select("name", "plane", "my", "mx", "k", O.text(scanned).alias("scanned"))


def rate_proxies(spark, sf_dir):
    """Cost proxies of blocks by plane; those of y2 count twice."""
    rate = P.block_rate(F.col("c")) * F.when(F.col("plane") == "y2", 2).otherwise(1)
    return quantized_dump(_dump(spark, sf_dir)).groupBy("name", "q", "plane").agg(F.sum(rate).alias("rate"))


def chroma_modes(spark, sf_dir):
    """Absolute coefficients of U and V as one cost of each macroblock, against luma's."""
    rows = _dump(spark, sf_dir).select("name", "my", "mx", F.when(F.col("plane").isin("u", "v"), "uv").otherwise("y").alias("kind"), O.total(F.transform("c", F.abs)).alias("cost"))
    return rows.groupBy("name", "my", "mx").agg(
        F.sum(F.when(F.col("kind") == "uv", F.col("cost")).otherwise(0)).alias("uv"),
        F.sum(F.when(F.col("kind") == "y", F.col("cost")).otherwise(0)).alias("y"),
    )


def _pictures(spark, sf_dir):
    """Pictures, and what is left of them when samples go to multiples of 16; a third of the tiles stays as it is."""
    coarse = lambda c: F.when(F.col("tx") == 1, F.col(c)).otherwise(F.transform(c, lambda v: B.clip(F.floor((v + 8) / 16) * 16, 0, 255)))
    return I.pictures(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumns({f"{c}2": coarse(c) for c in "rgb"})


def image_quality(spark, sf_dir):
    """PSNR by channel and of all, and SSIM, over pictures with partial tiles at two edges."""
    return I.quality(_pictures(spark, sf_dir))


def quality_means(spark, sf_dir):
    """Means over pictures; an infinite PSNR counts as 99."""
    return image_quality(spark, sf_dir).agg(F.count("*").alias("pictures"), F.round(F.avg(F.least(F.lit(99.0), "psnr_rgb")), 5).alias("psnr"), F.round(F.avg("ssim_y"), 5).alias("ssim"))


def quality_gate(spark, sf_dir):
    """Pictures whose PSNR fell by more than 0.05 dB below that of their finer version: the first fifty, and how many more there are."""
    now = image_quality(spark, sf_dir).select("picture", F.col("psnr_rgb").alias("value"))
    finer = _pictures(spark, sf_dir).withColumns({f"{c}2": F.transform(c, lambda v: B.clip(F.floor((v + 4) / 8) * 8, 0, 255)) for c in "rgb"})
    wanted = I.quality(finer).select("picture", F.col("psnr_rgb").alias("value"))
    return R.first_failures(R.differences(wanted, now, "picture", "value", 0.05), ["picture"])


def luma_heat(spark, sf_dir):
    """Five times the luma difference of both versions, up to 255, over what lies inside the picture."""
    luma = lambda k: F.zip_with(F.zip_with(f"r{k}", f"g{k}", lambda r, g: 77 * r + 150 * g), f"b{k}", lambda a, b: F.shiftright(a + 29 * b + 128, 8))
    heat = I.inside(F.zip_with(luma(""), luma("2"), lambda x, y: F.least(F.lit(255).cast("long"), F.abs(x - y) * 5)))
    return _pictures(spark, sf_dir).select("picture", "ty", "tx", O.text(heat).alias("heat"))


def visible_crop(spark, sf_dir):
    """Samples that lie inside the pictures, of those of their tiles."""
    rows = _pictures(spark, sf_dir).select("picture", F.size("r").alias("all"), I.inside(F.col("r")).alias("v"))
    return rows.groupBy("picture").agg(F.sum("all").cast("long").alias("padded"), F.sum(F.size("v")).cast("long").alias("visible"), F.sum(O.total(F.col("v"))).alias("total"))


def column_chroma(spark, sf_dir):
    """Mean luma, Cb and Cr of each column of tiles, without rounding terms."""
    r, g, b = ("r", "g", "b")
    mixed = lambda x, y, z, add: F.transform(F.arrays_zip(r, g, b), lambda p: F.shiftright(x * p[r] + y * p[g] + z * p[b], 8) + add)
    planes = {"luma": mixed(77, 150, 29, 0), "cb": mixed(-43, -85, 128, 128), "cr": mixed(128, -107, -21, 128)}
    rows = _pictures(spark, sf_dir).select("tx", *(O.total(I.inside(v)).alias(k) for k, v in planes.items()), F.size(I.inside(F.col(r))).cast("long").alias("n"))
    return rows.groupBy("tx").agg(*(F.round(F.sum(k) / F.sum("n"), 6).alias(k) for k in planes), F.sum("n").alias("n"))


def three_way(spark, sf_dir):
    """Decoded macroblocks, an oracle's and their segments, by segment: how many only one side has, how many differ, and by how much. The oracle lacks some, and others are its alone."""
    decoded = N.macroblocks(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    at = (F.col("image") * N.DOWN + F.col("r")) * N.ACROSS + F.col("c")
    oracle = decoded.where(at % 11 != 4).withColumn("c", F.when(at % 13 == 5, F.col("c") + N.ACROSS).otherwise(F.col("c")))
    oracle = oracle.select("image", "r", "c", F.transform("p", lambda v: F.when(v % 32 == 0, v + 1).otherwise(v)).alias("q"))
    segments = decoded.select("image", "r", "c", ((F.col("image") + F.col("c")) % 4).alias("segment"))
    key = ["image", "r", "c"]
    away = decoded.join(oracle, key, "full").join(segments, key, "left").withColumn("d", F.zip_with("p", "q", lambda v, w: F.abs(v - w)))
    return away.groupBy("segment").agg(
        F.count("*").alias("macroblocks"), F.count_if(F.col("q").isNull()).alias("only_decoded"), F.count_if(F.col("p").isNull()).alias("only_oracle"),
        F.coalesce(F.sum(O.total(F.col("d"))), F.lit(0)).alias("sad"), F.count_if(F.exists("d", lambda v: v > 0)).alias("differ"),
    )


_ALL = (
    corpus_pixels, corpus_digests, gamma_tables, rgb_to_i420, plane_dump, transform_dump, quantized_levels, plane_nonzero, ordered_hash, zigzag_levels, rate_proxies, chroma_modes,
    image_quality, quality_means, quality_gate, luma_heat, visible_crop, column_chroma, three_way,
)
QUERIES = {f.__name__: f for f in _ALL}

_PICTURES = f"""{_PX.replace('px AS', 'pv AS', 1)}, six AS (SELECT picture, i, coalesce(p, list_transform(range(0, 64), lambda z: 128)) AS p FROM (SELECT picture, unnest(range(0, 6)) AS i FROM (SELECT DISTINCT vec_id // 6 AS picture FROM pv)) t
 LEFT JOIN pv ON vec_id = picture * 6 + i),
px AS (SELECT CAST(picture AS VARCHAR) AS name, i // 3 * 8 + k // 8 AS y, i % 3 * 8 + k % 8 AS x, p[k + 1] AS r, p[64 - k] AS g, 255 - p[k + 1] AS b FROM six, (SELECT unnest(range(0, 64)) AS k) WHERE i // 3 * 8 + k // 8 < 13 AND i % 3 * 8 + k % 8 < 21)"""
_LINEAR = "CAST(floor(4095 * pow({0} / 255.0, 0.8) + 0.5) AS BIGINT)"
_AT = "CAST(floor(255 * pow(128 * ({0}) / 4095.0, 1.25) + 0.5) AS BIGINT)"
_GAMMA = f"(({_AT.format('({0} >> 9) + 1')} * ({{0}} & 511) + {_AT.format('{0} >> 9')} * (512 - ({{0}} & 511)) + 64) >> 7)"
_I420 = f"""lin AS (SELECT name, y // 2 AS y, x // 2 AS x, {', '.join(f'CAST(sum({_LINEAR.format(c)}) AS BIGINT) * 4 // count(*) AS {c}' for c in 'rgb')} FROM px GROUP BY ALL),
four AS (SELECT name, y, x, {', '.join(f'{_GAMMA.format(c)} AS {c}' for c in 'rgb')} FROM lin),
pl AS (SELECT name, 'y' AS plane, y, x, (16839*r + 33059*g + 6420*b + 32768 + 1048576) >> 16 AS v FROM px
 UNION ALL SELECT name, 'u', y, x, least(255, greatest(0, (-9719*r - 19081*g + 28800*b + 131072 + 33554432) >> 18)) FROM four
 UNION ALL SELECT name, 'v', y, x, least(255, greatest(0, (28800*r - 24116*g - 4684*b + 131072 + 33554432) >> 18)) FROM four)"""
_SHA = "sha256(unhex(string_agg({0}, '' ORDER BY {1})))"
_PLANES = _SHA.format("printf('%02x', v)", "translate(plane, 'yuv', '123'), y, x")
_PAD = f"""WITH {_PICTURES}, {_I420},
ends AS (SELECT name, plane, max(y) AS ly, max(x) AS lx, CASE plane WHEN 'y' THEN 16 ELSE 8 END AS side FROM pl GROUP BY ALL),
tall AS (SELECT *, unnest(range(0, (ly // side + 1) * side)) AS y FROM ends),
wide AS (SELECT *, unnest(range(0, (lx // side + 1) * side)) AS x FROM tall),
pad AS (SELECT w.name, w.plane, side, w.y, w.x, v, w.y // side AS my, w.x // side AS mx, w.y % side AS iy, w.x % side AS ix FROM wide w JOIN pl p ON p.name = w.name AND
 p.plane = w.plane AND p.y = least(w.y, ly) AND p.x = least(w.x, lx)),
"""
_DUMP = f"""{_PAD}near AS (SELECT name, plane, my + 1 AS my, mx, v FROM pad WHERE iy = side - 1 UNION ALL SELECT name, plane, my, mx + 1, v FROM pad WHERE ix = side - 1),
flat AS (SELECT name, plane, my, mx, avg(v) AS m FROM near GROUP BY ALL),
r AS (SELECT concat_ws('|', p.name, p.plane, p.my, p.mx) AS vec_id, iy // 4 * (side // 4) + ix // 4 AS k, list(v - coalesce(CAST(floor(m + 0.5) AS BIGINT), 128) ORDER BY iy, ix) AS s
 FROM pad p LEFT JOIN flat f ON f.name = p.name AND f.plane = p.plane AND f.my = p.my AND f.mx = p.mx GROUP BY ALL),
{_pass('r', 't', 's', 't', True, DCT_ROWS)}, {_pass('t', 'dct', 't', 'c', False, DCT_COLUMNS)},
firsts AS (SELECT replace(vec_id, '|y|', '|y2|') AS vec_id, 0 AS k, list(c[1] ORDER BY k) AS s FROM dct WHERE vec_id LIKE '%|y|%' GROUP BY 1),
{_pass('firsts', 'w1', 's', 's', True, WHT)}, {_pass('w1', 'w2', 's', 's', False, [f'(({x})>>1)' for x in WHT])},
every AS (SELECT vec_id, k, CASE WHEN vec_id LIKE '%|y|%' THEN [0] || c[2:] ELSE c END AS c FROM dct UNION ALL SELECT vec_id, k, s FROM w2),
dump AS (SELECT split_part(vec_id, '|', 1) AS name, split_part(vec_id, '|', 2) AS plane, CAST(split_part(vec_id, '|', 3) AS BIGINT) AS my, CAST(split_part(vec_id, '|', 4)
 AS BIGINT) AS mx, CAST(k AS INTEGER) AS k, c FROM every)"""
_STEPS = ", ".join(f"({quality}, '{plane}', {dc}, {ac})" for quality in QUALITIES for plane, (dc, ac) in dump_steps(qindex(quality)).items())
_QUANT = f"""{_DUMP}, lv AS (SELECT name, q, d.plane, my, mx, k, list_transform(range(1, 17), lambda i: CAST(sign(c[i]) * ((abs(c[i]) + (CASE WHEN i = 1 THEN dc ELSE ac
 END) // 2) // (CASE WHEN i = 1 THEN dc ELSE ac END)) AS BIGINT)) AS c
 FROM dump d JOIN (VALUES {_STEPS}) s(q, plane, dc, ac) ON s.plane = d.plane)"""
_COST = "list_sum(list_transform(c, lambda v: CASE WHEN v = 0 THEN 0 ELSE least(6, length(bin(abs(v)))) END)) + CAST(c[1] <> 0 AS BIGINT)"


def _tiles(step: int) -> str:
    """Pictures with samples of the second version at multiples of ``step``; ``spared``: a third of the tiles stays."""
    coarse = f"least(255, (v + {step // 2}) // {step} * {step})"
    second = ", ".join(f"list_transform({c}, lambda v: CASE WHEN spared THEN v ELSE {coarse} END) AS {c}2" for c in "rgb")
    keep = "list_filter(range(1, 65), lambda i: (i - 1) % 8 < w AND (i - 1) // 8 < h)"
    return f"""WITH {_PX},
ti AS (SELECT vec_id // 6 AS picture, vec_id // 3 % 2 AS ty, vec_id % 3 AS tx, CASE WHEN vec_id % 3 = 2 THEN 5 ELSE 8 END AS w, CASE WHEN vec_id // 3 % 2 = 1 THEN 5 ELSE 8 END AS h,
 p AS r, list_reverse(p) AS g, list_transform(p, lambda v: 255 - v) AS b FROM px),
tj AS (SELECT *, {keep} AS ins, {'tx = 1' if step == 16 else 'false'} AS spared FROM ti),
tk AS (SELECT *, {second} FROM tj),
one AS (SELECT picture, tx, ty, {', '.join(f'r{k}[i] AS r{k}, g{k}[i] AS g{k}, b{k}[i] AS b{k}' for k in ('', '2'))}, i FROM (SELECT *, unnest(ins) AS i FROM tk)),
lum AS (SELECT *, (77*r + 150*g + 29*b + 128) >> 8 AS x, (77*r2 + 150*g2 + 29*b2 + 128) >> 8 AS y FROM one)"""


_PSNR = "round(CASE WHEN {0} = 0 THEN CAST('inf' AS DOUBLE) ELSE 10 * log10(65025.0 / ({0} / {1})) END, 6)"
_TILE = "count(*) AS n, sum((r-r2)*(r-r2)) AS er, sum((g-g2)*(g-g2)) AS eg, sum((b-b2)*(b-b2)) AS eb, avg(x) AS mx, avg(y) AS my, avg(x*x) AS xx, avg(y*y) AS yy, avg(x*y) AS xy"
_QUALITY = f"""tile AS (SELECT picture, tx, ty, {_TILE} FROM lum GROUP BY ALL),
ss AS (SELECT *, ((2*mx*my + 6.5025) * (2*(xy - mx*my) + 58.5225)) / ((mx*mx + my*my + 6.5025) * (xx - mx*mx + yy - my*my + 58.5225)) AS s FROM tile),
pic AS (SELECT picture, CAST(sum(n) AS BIGINT) AS n, sum(er) AS er, sum(eg) AS eg, sum(eb) AS eb, avg(s) AS s FROM ss GROUP BY 1),
qu AS (SELECT picture, n, {', '.join(f"{_PSNR.format('e' + c, 'n')} AS psnr_{c}" for c in 'rgb')}, {_PSNR.format('(er + eg + eb)', '(3 * n)')} AS psnr_rgb, round(s, 6) AS ssim_y FROM pic)"""
SQL = {
    "corpus_pixels": f"WITH {_PICTURES} SELECT name, y, x, r, g, b FROM px",
    "corpus_digests": f"""WITH {_PICTURES}, {_I420} SELECT a.name, rgb_sha, yuv_sha FROM (SELECT name, {_SHA.format("printf('%02x%02x%02x', r, g, b)", 'y, x')} AS rgb_sha FROM px GROUP BY 1) a
 JOIN (SELECT name, {_PLANES} AS yuv_sha FROM pl GROUP BY 1) b ON a.name = b.name""",
    "gamma_tables": f"SELECT p_partkey, linear, {_GAMMA.format('linear')} AS four, {_LINEAR.format('(linear % 256)')} AS of_sample FROM (SELECT p_partkey, p_partkey * 13 % 16381 AS linear FROM part)",
    "rgb_to_i420": f"WITH {_PICTURES}, {_I420} SELECT name, plane, y, x, v FROM pl",
    "plane_dump": f"{_PAD[:_PAD.rindex(',')]} SELECT name, {_PLANES} AS sha FROM pad GROUP BY 1",
    "transform_dump": f"{_DUMP} SELECT name, plane, my, mx, k, array_to_string(c, ',') AS coefficients FROM dump",
    "quantized_levels": f"{_QUANT} SELECT name, q, plane, my, mx, k, array_to_string(c, ',') AS levels FROM lv",
    "plane_nonzero": f"""{_QUANT}, z AS (SELECT name, q, plane, len(list_filter(c, lambda v: v <> 0)) AS s FROM lv)
 SELECT name, q, plane, count(*) AS blocks, count(*) FILTER (s > 0) AS blocks_nonzero, CAST(sum(s) AS BIGINT) AS nonzero FROM z GROUP BY ALL""",
    "ordered_hash": f"""{_DUMP}, fl AS (SELECT name, flatten(list(c ORDER BY my, mx, CASE plane WHEN 'y2' THEN 0 WHEN 'y' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, k)) AS c FROM dump GROUP BY 1),
 fed AS (SELECT name, flatten(list_transform(c, lambda v: [CAST((v >> s) & 255 AS HUGEINT) for s in [0, 8, 16, 24]])) AS l FROM fl)
 SELECT name, format('{{:016x}}', CAST(list_reduce(l, lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616, CAST(1469598103934665603 AS HUGEINT)) AS UBIGINT)) AS fnv FROM fed""",
    "zigzag_levels": f"""{_DUMP} SELECT name, plane, my, mx, k, array_to_string(list_transform([1, 2, 5, 9, 6, 3, 4, 7, 10, 13, 14, 11, 8, 12, 15, 16], lambda i: c[i]),
 ',') AS scanned FROM dump WHERE plane <> 'y2'""",
    "rate_proxies": f"{_QUANT} SELECT name, q, plane, CAST(sum(({_COST}) * CASE plane WHEN 'y2' THEN 2 ELSE 1 END) AS BIGINT) AS rate FROM lv GROUP BY ALL",
    "chroma_modes": f"""{_DUMP}, co AS (SELECT name, my, mx, plane IN ('u', 'v') AS uv, list_sum(list_transform(c, lambda v: abs(v))) AS cost FROM dump)
 SELECT name, my, mx, CAST(sum(CASE WHEN uv THEN cost ELSE 0 END) AS BIGINT) AS uv, CAST(sum(CASE WHEN uv THEN 0 ELSE cost END) AS BIGINT) AS y FROM co GROUP BY ALL""",
    "image_quality": f"{_tiles(16)}, {_QUALITY} SELECT * FROM qu",
    "quality_means": f"{_tiles(16)}, {_QUALITY} SELECT count(*) AS pictures, round(avg(least(99.0, psnr_rgb)), 5) AS psnr, round(avg(ssim_y), 5) AS ssim FROM qu",
    "quality_gate": f"""WITH now AS ({_tiles(16)}, {_QUALITY} SELECT picture, psnr_rgb AS current FROM qu), finer AS ({_tiles(8)}, {_QUALITY} SELECT picture, psnr_rgb AS expected FROM qu),
 bad AS (SELECT picture, expected, current FROM finer JOIN now USING (picture) WHERE expected - current > 0.05)
 SELECT picture, expected, current, greatest(0, (SELECT count(*) FROM bad) - 50) AS more FROM bad ORDER BY picture LIMIT 50""",
    "luma_heat": f"{_tiles(16)} SELECT picture, ty, tx, string_agg(CAST(least(255, 5 * abs(x - y)) AS VARCHAR), ',' ORDER BY i) AS heat FROM lum GROUP BY ALL",
    "visible_crop": f"""{_tiles(16)} SELECT o.picture, padded, count(*) AS visible, CAST(sum(r) AS BIGINT) AS total FROM one o JOIN (SELECT picture, count(*) * 64 AS
 padded FROM ti GROUP BY 1) t ON t.picture = o.picture GROUP BY ALL""",
    "column_chroma": f"""{_tiles(16)} SELECT tx, round(avg((77*r + 150*g + 29*b) >> 8), 6) AS luma, round(avg(((-43*r - 85*g + 128*b) >> 8) + 128), 6) AS cb,
 round(avg(((128*r - 107*g - 21*b) >> 8) + 128), 6) AS cr, count(*) AS n FROM one GROUP BY 1""",
    "three_way": f"""{MACROBLOCKS}, a AS (SELECT *, (image * 3 + r) * 4 + c AS n FROM mp), o AS (SELECT image, r, CASE WHEN n % 13 = 5 THEN c + 4 ELSE c END AS c, p AS q FROM a WHERE n % 11 <> 4),
 j AS (SELECT CASE WHEN p IS NULL THEN NULL ELSE (a.image + a.c) % 4 END AS segment, p, q, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN len(list_filter(p, lambda v: v % 32 = 0)) END AS n
 FROM a FULL JOIN o ON o.image = a.image AND o.r = a.r AND o.c = a.c)
 SELECT segment, count(*) AS macroblocks, count(*) FILTER (q IS NULL) AS only_decoded, count(*) FILTER (p IS NULL) AS only_oracle, CAST(coalesce(sum(n), 0) AS BIGINT) AS sad, count(*) FILTER (n > 0) AS differ FROM j GROUP BY 1""",
}

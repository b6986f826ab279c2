"""Queries over macroblocks in pictures of 4x3, with the samples of the blocks around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions.tables import AC_STEPS, DC_STEPS
from lumenweave.operators import blocks as O
from lumenweave.operators import halo as N
from lumenweave.plans.blocks import _LINE, _PX, DCT_COLUMNS, DCT_ROWS, _pass
from lumenweave.plans.frames import _TAPS

DC, AC, WEIGHT = DC_STEPS[60], AC_STEPS[60], 7680
#: What a macroblock of sixteen 4x4 predictions must save in absolute difference over the best of one prediction.
SPLIT_COST, SPLIT = 200, 4
KEY = ("image", "r", "c")


def _blocks(spark, sf_dir):
    return N.macroblocks(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _predicted(spark, sf_dir, n):
    blocks = _blocks(spark, sf_dir) if n == 16 else N.halved(_blocks(spark, sf_dir))
    return N.errors(N.predictions(N.bordered(blocks, n), n))


def predict16(spark, sf_dir):
    """Absolute and squared error of four predictions of each macroblock from the blocks above, at its left and at the corner."""
    return _predicted(spark, sf_dir, 16)


def predict8(spark, sf_dir):
    """The same of the means of two by two samples, as chroma has them."""
    return _predicted(spark, sf_dir, 8)


def neighbours(spark, sf_dir):
    """Sum of each macroblock's samples, and of the samples around it: null where there is none."""
    edges = N.with_edges(_blocks(spark, sf_dir), 16)
    return edges.select(*KEY, *(O.total(F.col(c)).alias(n) for n, c in (("own", "p"), ("above", "above"), ("left", "left"), ("beyond", "beyond"))), "corner")


def _subblocks(spark, sf_dir):
    return N.subblock_candidates(N.subblock_lines(N.bordered(_blocks(spark, sf_dir), 16)))


def subblock_best(spark, sf_dir):
    """The best of ten predictions of each 4x4 block, from the samples around it in its macroblock and the blocks beside; above at the right it is the macroblock above that counts."""
    costs = _subblocks(spark, sf_dir).select(*KEY, "k", "mode", O.total(F.zip_with("s", "guess", lambda v, g: F.abs(v - g))).alias("sad"))
    best = costs.groupBy(*KEY, "k").agg(F.min(F.struct("sad", "mode")).alias("best"), F.sum("sad").alias("all_sad"))
    return best.select(*KEY, "k", "best.mode", "best.sad", "all_sad")


def mode_rd(spark, sf_dir):
    """Mode of least rate-distortion cost of each 4x4 block, what it costs, and how much more the second-best does."""
    rows = N.rate_distortion(_subblocks(spark, sf_dir), DC, AC, WEIGHT)
    found = rows.groupBy(*KEY, "k").agg(F.array_sort(F.collect_list(F.struct("cost", "mode", "error", "rate"))).alias("o"))  # ten a block
    one, two = F.element_at("o", 1), F.element_at("o", 2)
    return found.select(*KEY, "k", one["mode"].alias("mode"), one["cost"].alias("cost"), one["error"].alias("error"), one["rate"].alias("rate"), (two["cost"] - one["cost"]).alias("margin"))


def _modes(spark, sf_dir):
    """image, r, c, ymode (4: sixteen modes of their own), uv_mode, modes (of the sixteen blocks, null unless ymode is 4). Of every seventh picture one of the sixteen is lost."""
    least = F.min(F.struct("sad", "mode"))
    luma = predict16(spark, sf_dir).groupBy(*KEY).agg(least.alias("luma"))
    chroma = predict8(spark, sf_dir).groupBy(*KEY).agg(least.alias("chroma"))
    split = subblock_best(spark, sf_dir).where("NOT (image % 7 = 3 AND k = 5)").groupBy(*KEY).agg(F.sum("sad").alias("sad"), F.collect_list("mode").alias("modes"))
    rows = luma.join(chroma, list(KEY)).join(split, list(KEY))
    own = F.col("sad") + SPLIT_COST < F.col("luma.sad")
    return rows.select(*KEY, F.when(own, SPLIT).otherwise(F.col("luma.mode")).alias("ymode"), F.col("chroma.mode").alias("uv_mode"), F.when(own, F.col("modes")).alias("modes"))


def frame_counters(spark, sf_dir):
    """Macroblocks, and histograms of luma modes, chroma modes, and of the ten 4x4 modes where a macroblock has them, by picture."""
    number = lambda i: F.sum(F.coalesce(F.size(F.filter("modes", lambda m: m == i)), F.lit(0)))
    counts = [F.count_if(F.col("ymode") == i).alias(f"ymode{i}") for i in range(5)] + [F.count_if(F.col("uv_mode") == i).alias(f"uv{i}") for i in range(4)]
    return _modes(spark, sf_dir).groupBy("image").agg(F.count("*").alias("macroblocks"), *counts, *(number(i).cast("long").alias(f"bmode{i}") for i in range(10)))


def conservation(spark, sf_dir):
    """What is wrong with a picture's counts: macroblocks of its grid without a mode, or 4x4 modes that aren't sixteen a macroblock that has them; the largest label of its vectors."""
    rows = frame_counters(spark, sf_dir)
    add = lambda n, k: sum((F.col(f"{n}{i}") for i in range(1, k)), F.col(f"{n}0"))
    missing, off = N.ACROSS * N.DOWN - add("ymode", 5), add("bmode", 10) - 16 * F.col("ymode4")
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy(F.floor(F.col("vec_id") / (4 * N.ACROSS * N.DOWN)).alias("image")).agg(F.max("label").alias("label"))
    bad = rows.where((missing != 0) | (off != 0) | (add("uv", 4) != add("ymode", 5)))
    return bad.join(labels, "image").select("image", "label", missing.alias("missing"), off.alias("off"), "ymode4")


_ALL = (predict16, predict8, neighbours, subblock_best, mode_rd, frame_counters, conservation)
QUERIES = {f.__name__: f for f in _ALL}

MACROBLOCKS = f"""WITH {_PX}, part4 AS (SELECT mb, list(coalesce(px.p, list_transform(range(0, 64), lambda z: 128)) ORDER BY i) AS parts FROM (SELECT mb, unnest(range(0, 4)) AS i FROM (SELECT DISTINCT vec_id // 4 AS mb FROM px)) m
 LEFT JOIN px ON px.vec_id = mb * 4 + i GROUP BY mb),
mp AS (SELECT mb // 12 AS image, mb % 12 // 4 AS r, mb % 4 AS c, list_transform(range(0, 256), lambda i: parts[i // 128 * 2 + i % 16 // 8 + 1][i // 16 % 8 * 8 + i % 8 + 1]) AS p FROM part4)"""
_HALF = """, mh AS (SELECT image, r, c, list_transform(range(0, 64), lambda i: (p[i // 8 * 32 + i % 8 * 2 + 1] + p[i // 8 * 32 + i % 8 * 2 + 2] + p[i // 8 * 32 + i % 8 * 2 + 17] + p[i // 8 * 32 + i % 8 * 2 + 18] + 2) >> 2) AS p FROM mp)"""


def _bordered(source: str, name: str, n: int) -> str:
    """The padded samples of each block, looked up in joined neighbours."""
    w = n + 5
    right = f"CASE WHEN u.p IS NULL THEN 127 WHEN x.p IS NULL THEN u.p[{n * n}] ELSE x.p[{n * (n - 1)} + i % {w} - {n}] END"
    row0 = f"CASE WHEN u.p IS NULL THEN 127 WHEN i > {n} THEN {right} WHEN i > 0 THEN u.p[{n * (n - 1)} + i] WHEN l.p IS NULL THEN 129 ELSE o.p[{n * n}] END"
    rest = f"CASE WHEN i % {w} > {n} THEN {right} WHEN i % {w} > 0 THEN b.p[(i // {w} - 1) * {n} + i % {w}] WHEN l.p IS NULL THEN 129 ELSE l.p[(i // {w} - 1) * {n} + {n}] END"
    beside = lambda alias, r, c: f"LEFT JOIN {source} {alias} ON {alias}.image = b.image AND {alias}.r = b.r + {r} AND {alias}.c = b.c + {c}"
    return f"""{name} AS (SELECT b.image, b.r, b.c, b.p, u.p IS NOT NULL AS has_a, l.p IS NOT NULL AS has_l, u.p AS up, l.p AS lp, x.p AS xp, o.p AS op, list_transform(range(0, {w * (n + 1)}), lambda i: CASE WHEN i < {w} THEN {row0} ELSE {rest} END) AS e
 FROM {source} b {beside('u', -1, 0)} {beside('l', 0, -1)} {beside('o', -1, -1)} {beside('x', -1, 1)})"""


def _errors(source: str, name: str, n: int) -> str:
    w = n + 5
    sums = f"(CASE WHEN has_a THEN list_sum(e[2:{n + 1}]) ELSE 0 END + CASE WHEN has_l THEN list_sum(list_transform(range(1, {n + 1}), lambda y: e[y * {w} + 1])) ELSE 0 END)"
    count = f"({n} * (CAST(has_a AS INTEGER) + CAST(has_l AS INTEGER)))"
    mean = f"CASE WHEN {count} = 0 THEN 128 ELSE CAST(({sums} + {count} // 2) // {count} AS BIGINT) END"
    guess = f"CASE mode WHEN 0 THEN mean WHEN 1 THEN e[i % {n} + 2] WHEN 2 THEN e[(i // {n} + 1) * {w} + 1] ELSE least(255, greatest(0, e[(i // {n} + 1) * {w} + 1] + e[i % {n} + 2] - e[1])) END"
    return f"""{name}_m AS (SELECT image, r, c, p, e, {mean} AS mean, mode FROM {source}, (SELECT unnest(range(0, 4)) AS mode)),
{name}_d AS (SELECT image, r, c, CAST(mode AS INTEGER) AS mode, list_transform(range(0, {n * n}), lambda i: p[i + 1] - {guess}) AS d FROM {name}_m),
{name} AS (SELECT image, r, c, mode, CAST(list_sum(list_transform(d, lambda v: abs(v))) AS BIGINT) AS sad, CAST(list_sum(list_transform(d, lambda v: v * v)) AS BIGINT) AS sse FROM {name}_d)"""


_EDGES = f"{MACROBLOCKS}, {_bordered('mp', 'eb', 16)}"
_SAMPLES = _TAPS.replace("p[10 + 8 * y + x]", "y, x, p[4 * y + x + 1]")
_TEN = f"""{_EDGES}, ln AS (SELECT ((image * 3 + r) * 4 + c) * 16 + k AS vec_id, list_transform(range(0, 16), lambda i: e[k // 4 * 84 + k % 4 * 4 + 21 * (1 + i // 4) + 2 + i % 4]) AS p,
 list_transform([4, 3, 2, 1], lambda y: e[k // 4 * 84 + k % 4 * 4 + 21 * y + 1]) || e[k // 4 * 84 + k % 4 * 4 + 1:k // 4 * 84 + k % 4 * 4 + 9] AS e FROM eb, (SELECT unnest(range(0, 16)) AS k)){_SAMPLES}"""
_ID = "vec_id // 192 AS image, vec_id // 64 % 3 AS r, vec_id // 16 % 4 AS c, CAST(vec_id % 16 AS INTEGER) AS k"
_BEST4 = "bs AS (SELECT vec_id, arg_min(mode, sad * 16 + mode) AS mode, min(sad) AS sad, CAST(sum(sad) AS BIGINT) AS all_sad FROM co GROUP BY 1)"
_RDSTEP = f"(CASE WHEN i = 1 THEN {DC} ELSE {AC} END)"
_RD = f"""{_TEN}, rs AS (SELECT vec_id, m AS k, list(s - v ORDER BY y, x) AS s, list(v ORDER BY y, x) AS g, list(s ORDER BY y, x) AS own FROM pr GROUP BY 1, 2),
{_pass('rs', 't1', 's', 't', True, DCT_ROWS)}, {_pass('t1', 't2', 't', 'c', False, DCT_COLUMNS)},
qd AS (SELECT vec_id, k, list_transform(range(1, 17), lambda i: CAST(sign(c[i]) * ((abs(c[i]) + {_RDSTEP} // 2) // {_RDSTEP}) AS BIGINT)) AS q FROM t2),
dq AS (SELECT vec_id, k, list_transform(range(1, 17), lambda i: q[i] * {_RDSTEP}) AS c FROM qd),
{_pass('dq', 'i1', 'c', 'c', False, _LINE)}, {_pass('i1', 'i2', 'c', 'c', True, [f'(({x}+4)>>3)' for x in _LINE])},
rd AS (SELECT rs.vec_id, CAST(rs.k AS INTEGER) AS mode, CAST(list_sum(list_transform(range(1, 17), lambda i: (own[i] - least(255, greatest(0, g[i] + i2.c[i]))) * (own[i] - least(255, greatest(0, g[i] + i2.c[i]))))) AS BIGINT) AS error,
 CAST(list_sum(list_transform(q, lambda v: CASE WHEN v = 0 THEN 0 ELSE least(6, length(bin(abs(v)))) END)) + CAST(q[1] <> 0 AS BIGINT) + CAST(rs.k > 0 AS BIGINT) AS BIGINT) AS rate
 FROM rs JOIN qd ON qd.vec_id = rs.vec_id AND qd.k = rs.k JOIN i2 ON i2.vec_id = rs.vec_id AND i2.k = rs.k),
rc AS (SELECT *, error * 256 + rate * {WEIGHT} AS cost FROM rd),
ro AS (SELECT *, row_number() OVER o AS place, lead(cost) OVER o - cost AS margin FROM rc WINDOW o AS (PARTITION BY vec_id ORDER BY cost, mode))"""
_SUM = lambda name, k: "(" + " + ".join(f"{name}{i}" for i in range(k)) + ")"
_COUNTERS = f"""{_TEN}, {_BEST4}{_HALF}, {_bordered('mh', 'eh', 8)}, {_errors('eb', 'e16', 16)}, {_errors('eh', 'e8', 8)},
lu AS (SELECT image, r, c, arg_min(mode, sad * 4 + mode) AS mode, min(sad) AS sad FROM e16 GROUP BY ALL), ch AS (SELECT image, r, c, arg_min(mode, sad * 4 + mode) AS uv FROM e8 GROUP BY ALL),
sp AS (SELECT image, r, c, sum(sad) AS sad, list(mode) AS modes FROM (SELECT {_ID}, mode, sad FROM bs) WHERE NOT (image % 7 = 3 AND k = 5) GROUP BY ALL),
mo AS (SELECT lu.image, CASE WHEN sp.sad + {SPLIT_COST} < lu.sad THEN 4 ELSE lu.mode END AS ymode, uv, modes FROM lu JOIN ch USING (image, r, c) JOIN sp USING (image, r, c)),
fc AS (SELECT image, count(*) AS macroblocks, {', '.join(f'count(*) FILTER (ymode = {i}) AS ymode{i}' for i in range(5))}, {', '.join(f'count(*) FILTER (uv = {i}) AS uv{i}' for i in range(4))},
 {', '.join(f'CAST(coalesce(sum(len(list_filter(modes, lambda m: m = {i}))) FILTER (ymode = 4), 0) AS BIGINT) AS bmode{i}' for i in range(10))} FROM mo GROUP BY image)"""
SQL = {
    "predict16": f"{_EDGES}, {_errors('eb', 'er', 16)} SELECT * FROM er",
    "predict8": f"{MACROBLOCKS}{_HALF}, {_bordered('mh', 'eb', 8)}, {_errors('eb', 'er', 8)} SELECT * FROM er",
    "neighbours": f"""{_EDGES} SELECT image, r, c, CAST(list_sum(p) AS BIGINT) AS own, CAST(list_sum(up[241:256]) AS BIGINT) AS above, CAST(list_sum(list_transform(range(1, 17), lambda y: lp[y * 16])) AS BIGINT) AS left,
 CAST(list_sum(xp[241:244]) AS BIGINT) AS beyond, op[256] AS corner FROM eb""",
    "subblock_best": f"{_TEN}, {_BEST4} SELECT {_ID}, mode, sad, all_sad FROM bs",
    "mode_rd": f"{_RD} SELECT {_ID}, mode, cost, error, rate, margin FROM ro WHERE place = 1",
    "frame_counters": f"{_COUNTERS} SELECT * FROM fc",
    "conservation": f"""{_COUNTERS}, la AS (SELECT vec_id // 48 AS image, max(label) AS label FROM embeddings GROUP BY 1),
 ck AS (SELECT image, label, 12 - {_SUM('ymode', 5)} AS missing, {_SUM('bmode', 10)} - 16 * ymode4 AS off, ymode4, {_SUM('uv', 4)} - {_SUM('ymode', 5)} AS odd FROM fc JOIN la USING (image))
 SELECT image, label, missing, off, ymode4 FROM ck WHERE missing <> 0 OR off <> 0 OR odd <> 0""",
}

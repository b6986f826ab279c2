"""Queries over coded tokens: contexts, branch counts, costs, adaptive probabilities. Pictures of 4x3 macroblocks are made from ``embeddings``.

The format's table of 1,056 probabilities is a parameter of the operators, a DataFrame; the queries price with a table made by a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions.tables import AC_STEPS, DC_STEPS
from lumenweave.operators import tokens as T
from lumenweave.plans.blocks import _DCT, WHT, _pass

Q = 26
STEPS = {"y2": (2 * DC_STEPS[Q], max(8, AC_STEPS[Q] * 155 // 100)), "y": (DC_STEPS[Q], AC_STEPS[Q]), "u": (min(132, DC_STEPS[Q]), AC_STEPS[Q]), "v": (min(132, DC_STEPS[Q]), AC_STEPS[Q])}
#: A table in place of the format's: any numbers of 1 to 255 will do, and are updated where the counts pay for it.
PROBABILITY = "1 + (37 * kind + 53 * band + 71 * ctx + 29 * node + 90) % 254"
UPDATE = "255 - (kind + 3 * band + 5 * ctx + 7 * node) % 64"


def _blocks(spark, sf_dir):
    return T.with_contexts(T.coded_blocks(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), STEPS))


def _branches(spark, sf_dir):
    return T.branches(T.tokens(_blocks(spark, sf_dir)))


def base_table(spark):
    """kind, band, ctx, node, probability, update of all 1,056 cells."""
    cells = spark.range(4 * 8 * 3 * 11)
    names = {"kind": "id div 264", "band": "id div 33 % 8", "ctx": "id div 11 % 3", "node": "id % 11"}
    return cells.select(*(F.expr(e).alias(n) for n, e in names.items())).select("*", F.expr(PROBABILITY).alias("probability"), F.expr(UPDATE).alias("update"))


def block_contexts(spark, sf_dir):
    """Context of every block: how many of the last coded blocks before it, in its row and in its column, have levels."""
    return _blocks(spark, sf_dir).select(*T.BLOCK, "kind", "has", "ctx")


def token_counts(spark, sf_dir):
    """Coded tokens by kind, band, context."""
    return T.tokens(_blocks(spark, sf_dir)).groupBy("kind", "band", "ctx", "token").agg(F.count("*").alias("n"), F.count_if("after_zero").alias("after_zero"))


def branch_counts(spark, sf_dir):
    """Zeros and ones of every decision of the token tree, by kind, band, context and node; all of them are the coded bits."""
    return T.branch_counts(_branches(spark, sf_dir))


def branch_margins(spark, sf_dir):
    """The same counts over margins: by node with band, with context, with kind, and by node alone."""
    sets = [[F.col("node"), F.col(c)] for c in ("band", "ctx", "kind")] + [[F.col("node")]]
    rows = _branches(spark, sf_dir).groupingSets(sets, "node", "band", "ctx", "kind")
    return rows.agg(F.count_if(F.col("bit") == 0).alias("zeros"), F.count_if(F.col("bit") == 1).alias("ones"), F.grouping_id().cast("long").alias("margin"))


def block_bits(spark, sf_dir):
    """Cost of every coded block in 256ths of a bit."""
    return T.priced(_branches(spark, sf_dir), base_table(spark)).groupBy(*T.BLOCK).agg(F.sum("cost").alias("bits_q8"), F.count("*").alias("decisions"))


def macroblock_bits(spark, sf_dir):
    """Cost of every macroblock: its modes, and its levels by plane."""
    blocks = _blocks(spark, sf_dir)
    modes = blocks.select("picture", "mb", "mode", "uv_mode").distinct()
    costs = T.priced(T.branches(T.tokens(blocks)), base_table(spark)).groupBy("picture", "mb").pivot("plane", ["y2", "y", "u", "v"]).agg(F.sum("cost"))
    luma = F.get(F.array(*(F.lit(T.code_cost(c, T.LUMA_PROBABILITIES, T.LUMA_CODES)) for c in T.LUMA_CODES)), F.col("mode").cast("int"))
    chroma = F.get(F.array(*(F.lit(T.code_cost(c, T.CHROMA_PROBABILITIES, T.CHROMA_CODES)) for c in T.CHROMA_CODES)), F.col("uv_mode").cast("int"))
    planes = [F.coalesce(F.col(p), F.lit(0)).alias(p) for p in ("y2", "y", "u", "v")]
    rows = modes.join(costs, ["picture", "mb"], "left").select("picture", "mb", "mode", (luma + chroma).cast("long").alias("modes"), *planes)
    return rows.withColumn("total", F.col("modes") + F.col("y2") + F.col("y") + F.col("u") + F.col("v"))


def _adapted(spark, sf_dir, pooled):
    return T.adapted(branch_counts(spark, sf_dir), base_table(spark), pooled)


def adaptive_probabilities(spark, sf_dir):
    """All cells of the table, with the probabilities that the pictures' own counts make worth an update."""
    return _adapted(spark, sf_dir, False)


def pooled_probabilities(spark, sf_dir):
    """The same with priors by band, context and plane, and cells of few decisions left alone."""
    return _adapted(spark, sf_dir, True)


def _repriced(spark, sf_dir, pooled):
    """Cost of all decisions by kind, priced with the table before and after it adapts to them."""
    rows = _branches(spark, sf_dir)
    after = T.adapted(T.branch_counts(rows), base_table(spark), pooled).withColumn("after", F.col("probability") - F.col("old"))
    both = T.priced(rows, base_table(spark)).join(F.broadcast(after.select("kind", "band", "ctx", "node", "old", F.col("probability").alias("new"))), ["kind", "band", "ctx", "node"])
    change = T.bit_cost(F.col("new"), F.col("bit")) - T.bit_cost(F.col("old"), F.col("bit"))
    return both.groupBy("kind").agg(F.sum("cost").alias("before"), F.sum(F.col("cost") + change).alias("after"), F.count("*").alias("decisions"))


def adaptive_cost(spark, sf_dir):
    return _repriced(spark, sf_dir, False)


def pooled_cost(spark, sf_dir):
    return _repriced(spark, sf_dir, True)


_ALL = (block_contexts, token_counts, branch_counts, branch_margins, block_bits, macroblock_bits, adaptive_probabilities, pooled_probabilities, adaptive_cost, pooled_cost)
QUERIES = {f.__name__: f for f in _ALL}


def _rows(rows) -> str:
    return ", ".join(f"({', '.join(map(str, r))})" for r in rows)


def _level(i: str) -> str:
    step = f"(CASE WHEN {i} = 1 THEN dc ELSE ac END)"
    return f"CAST(sign(c[{i}]) * ((abs(c[{i}]) + {step} // 2) // {step}) AS BIGINT)"


# In SQL a context is found in another way than by windows that pass over blocks without levels: those blocks are left out before.
_STEPS = ", ".join(f"('{plane}', {dc}, {ac})" for plane, (dc, ac) in STEPS.items())
_BLOCKS = f"""WITH {_DCT},
tl AS (SELECT d.k, c, label, d.vec_id % 6 AS part, d.vec_id // 6 AS mb, d.vec_id // 72 AS picture, d.vec_id // 6 % 12 // 4 AS r, d.vec_id // 6 % 4 AS m FROM dct d JOIN px ON px.vec_id = d.vec_id),
ml AS (SELECT mb, max(label) % 5 AS mode, min(label) % 4 AS uv_mode FROM tl GROUP BY mb),
gl AS (SELECT picture, mb, mode, uv_mode, r, m, CASE part WHEN 4 THEN 'u' WHEN 5 THEN 'v' ELSE 'y' END AS plane, CASE WHEN part < 4 THEN r * 4 + part // 2 * 2 + k // 2 ELSE r * 2 + k // 2 END AS br,
 CASE WHEN part < 4 THEN m * 4 + part % 2 * 2 + k % 2 ELSE m * 2 + k % 2 END AS bc, c FROM tl JOIN ml USING (mb)),
kb AS (SELECT DISTINCT picture, mb, mode, uv_mode, r, m FROM gl), ki AS (SELECT *, unnest(range(0, 16)) AS i FROM kb WHERE mode <> 4),
fi AS (SELECT ki.mb AS vec_id, 0 AS k, list(coalesce(g.c[1], 0) ORDER BY i) AS s FROM ki LEFT JOIN gl g ON g.mb = ki.mb AND g.plane = 'y' AND g.br % 4 * 4 + g.bc % 4 = i GROUP BY 1),
{_pass('fi', 'w1', 's', 's', True, WHT)}, {_pass('w1', 'w2', 's', 's', False, [f'(({x})>>1)' for x in WHT])},
al AS (SELECT picture, mb, mode, uv_mode, plane, br, bc, CASE WHEN plane = 'y' AND mode <> 4 THEN [0] || c[2:] ELSE c END AS c FROM gl
 UNION ALL SELECT picture, mb, mode, uv_mode, 'y2', r, m, w2.s FROM kb JOIN w2 ON w2.vec_id = kb.mb),
ql AS (SELECT picture, mb, mode, uv_mode, a.plane, br, bc, list_transform(range(1, 17), lambda i: {_level('i')}) AS c FROM al a JOIN (VALUES {_STEPS}) s(plane, dc, ac) ON s.plane = a.plane),
zl AS (SELECT picture, mb, mode, uv_mode, plane, br, bc, CASE WHEN plane = 'y2' THEN 1 WHEN plane <> 'y' THEN 2 WHEN mode = 4 THEN 3 ELSE 0 END AS kind, list_transform([1, 2, 5, 9, 6, 3, 4, 7, 10, 13, 14, 11, 8, 12, 15, 16], lambda i: c[i]) AS z FROM ql),
hl AS (SELECT *, CAST(len(list_filter(z, lambda v: v <> 0)) > 0 AS INTEGER) AS has FROM zl),
cl AS (SELECT *, coalesce(lag(has) OVER (PARTITION BY picture, plane, br ORDER BY bc), 0) + coalesce(lag(has) OVER (PARTITION BY picture, plane, bc ORDER BY br), 0) AS ctx FROM hl)"""
_TOKENS = f"""{_BLOCKS},
el AS (SELECT *, CASE WHEN kind = 0 THEN 1 ELSE 0 END AS first, coalesce(list_max(list_filter(range(0, 16), lambda i: z[i + 1] <> 0)), -1) AS last FROM cl),
ix AS (SELECT *, unnest(range(first, least(15, greatest(last, first - 1) + 1) + 1)) AS i FROM el),
tv AS (SELECT picture, mb, plane, br, bc, kind, [{', '.join(map(str, T.BANDS))}][i + 1] AS band, CASE WHEN i = first THEN ctx ELSE least(2, abs(z[i])) END AS ctx, i > first AND z[i] = 0 AS after_zero, CASE WHEN i <= last THEN z[i + 1] END AS v FROM ix),
tk AS (SELECT *, CASE WHEN v IS NULL THEN 11 WHEN abs(v) < 5 THEN abs(v) ELSE 5 + len(list_filter([7, 11, 19, 35, 67], lambda b: b <= abs(v))) END AS token FROM tv)"""
_BRANCHES = f"""{_TOKENS}, tree AS (SELECT * FROM (VALUES {_rows(T.tree(T.TOKEN_CODES))}) t(token, step, node, bit)),
br AS (SELECT tk.*, step, node, bit FROM tk JOIN tree ON tree.token = tk.token WHERE NOT (after_zero AND step = 0))"""
_CELLS = f"""base AS (SELECT *, {PROBABILITY} AS probability, {UPDATE} AS up FROM (SELECT unnest(range(0, 4)) AS kind), (SELECT unnest(range(0, 8)) AS band), (SELECT unnest(range(0, 3)) AS ctx), (SELECT unnest(range(0, 11)) AS node))"""
# log2 in 256ths of 1 to 255, as a list
_LOG = "[" + ", ".join(f"{2048 - T.whole_log2(x)}" for x in range(1, 256)) + "]"
_EXTRA = "[" + ", ".join("[" + ", ".join(f"[{2048 - T.whole_log2(x)}, {2048 - T.whole_log2(256 - x)}]" for x in p) + "]" for p in T.EXTRA_PROBABILITIES) + "]"
_ABOVE = f"(least(abs(v), {T.LARGEST}) - [{', '.join(map(str, T.CATEGORY_BASES))}][token - 4])"
_MORE = f"""(CASE WHEN token BETWEEN 5 AND 10 THEN list_sum(list_transform(range(1, len(extras[token - 4]) + 1), lambda j: extras[token - 4][j][1 + (({_ABOVE} >> (len(extras[token - 4]) - j)) & 1)])) ELSE 0 END
 + CASE WHEN coalesce(v, 0) <> 0 THEN 256 ELSE 0 END)"""
_PRICED = f"""{_BRANCHES}, {_CELLS}, lists AS (SELECT {_LOG} AS logs, {_EXTRA} AS extras),
pr AS (SELECT br.*, logs[CASE WHEN bit = 0 THEN probability ELSE 256 - probability END] + CASE WHEN step = CAST(after_zero AS INTEGER) THEN {_MORE} ELSE 0 END AS cost
 FROM br JOIN base b ON b.kind = br.kind AND b.band = br.band AND b.ctx = br.ctx AND b.node = br.node, lists)"""
_COUNT = "count(*) FILTER (bit = 0) AS zeros, count(*) FILTER (bit = 1) AS ones"


def _adapt(pooled: bool) -> str:
    weight = "CASE WHEN band >= 6 THEN 96 WHEN band >= 3 THEN 48 ELSE 16 END + ctx * 16 + CASE WHEN kind IN (1, 2) THEN 16 ELSE 0 END" if pooled else "64"
    zeros, ones = ("zeros", "ones") if pooled else ("(zeros + prior)", "(ones + weight - prior)")
    enough = "zeros + ones >= CASE WHEN band >= 6 THEN 32 WHEN band >= 3 THEN 16 ELSE 8 END AND " if pooled else ""
    return f"""co AS (SELECT kind, band, ctx, node, {_COUNT} FROM br GROUP BY ALL), lg AS (SELECT {_LOG} AS l),
ce AS (SELECT b.*, coalesce(zeros, 0) AS zeros, coalesce(ones, 0) AS ones, {weight} AS weight FROM base b LEFT JOIN co USING (kind, band, ctx, node)),
cp AS (SELECT *, (probability * weight + 128) // 256 AS prior FROM ce),
cn AS (SELECT *, least(255, greatest(1, ((zeros + prior) * 256 + (zeros + ones + weight) // 2) // (zeros + ones + weight))) AS fresh FROM cp),
ad AS (SELECT kind, band, ctx, node, zeros, ones, probability AS old, CASE WHEN {enough}abs(fresh - probability) > 1 AND {zeros} * l[probability] + {ones} * l[256 - probability] >
 {zeros} * l[fresh] + {ones} * l[256 - fresh] + l[256 - up] + 2048 - l[up] THEN fresh ELSE probability END AS probability FROM cn, lg)"""


_REPRICE = """SELECT CAST(pr.kind AS BIGINT) AS kind, CAST(sum(cost) AS BIGINT) AS before, CAST(sum(cost + l[CASE WHEN bit = 0 THEN ad.probability ELSE 256 - ad.probability END] - l[CASE WHEN bit = 0 THEN old ELSE 256 - old END]) AS BIGINT) AS after,
 count(*) AS decisions FROM pr JOIN ad ON ad.kind = pr.kind AND ad.band = pr.band AND ad.ctx = pr.ctx AND ad.node = pr.node, lg GROUP BY 1"""
_MODE_COSTS = [f"[{', '.join(str(T.code_cost(c, p, codes)) for c in codes)}]" for codes, p in ((T.LUMA_CODES, T.LUMA_PROBABILITIES), (T.CHROMA_CODES, T.CHROMA_PROBABILITIES))]
_PLANES = ", ".join(f"CAST(coalesce(sum(cost) FILTER (plane = '{p}'), 0) AS BIGINT) AS {p}" for p in ("y2", "y", "u", "v"))
_KEYS = "picture, mb, plane, br, bc"
SQL = {
    "block_contexts": f"""{_BLOCKS} SELECT {_KEYS}, CAST(kind AS BIGINT) AS kind, has, CAST(ctx AS BIGINT) AS ctx FROM cl UNION ALL SELECT k.picture, k.mb, 'y2', k.r, k.m, 1, NULL,
 coalesce((SELECT arg_max(has, o.bc) FROM cl o WHERE o.plane = 'y2' AND o.picture = k.picture AND o.br = k.r AND o.bc < k.m), 0) + coalesce((SELECT arg_max(has, o.br) FROM cl o WHERE o.plane = 'y2' AND
 o.picture = k.picture AND o.bc = k.m AND o.br < k.r), 0) FROM kb k WHERE k.mode = 4""",
    "token_counts": f"{_TOKENS} SELECT CAST(kind AS BIGINT) AS kind, CAST(band AS BIGINT) AS band, CAST(ctx AS BIGINT) AS ctx, CAST(token AS BIGINT) AS token, count(*) AS n, count(*) FILTER (after_zero) AS after_zero FROM tk GROUP BY ALL",
    "branch_counts": f"{_BRANCHES} SELECT CAST(kind AS BIGINT) AS kind, CAST(band AS BIGINT) AS band, CAST(ctx AS BIGINT) AS ctx, CAST(node AS BIGINT) AS node, {_COUNT} FROM br GROUP BY ALL",
    "branch_margins": f"""{_BRANCHES} SELECT CAST(node AS BIGINT) AS node, CAST(band AS BIGINT) AS band, CAST(ctx AS BIGINT) AS ctx, CAST(kind AS BIGINT) AS kind, {_COUNT}, CAST(grouping_id(node, band, ctx, kind) AS BIGINT) AS margin
 FROM br GROUP BY GROUPING SETS ((node, band), (node, ctx), (node, kind), (node))""",
    "block_bits": f"{_PRICED} SELECT {_KEYS}, CAST(sum(cost) AS BIGINT) AS bits_q8, count(*) AS decisions FROM pr GROUP BY ALL",
    "macroblock_bits": f"""{_PRICED}, su AS (SELECT picture, mb, {_PLANES} FROM pr GROUP BY ALL) SELECT kb.picture, kb.mb, CAST(mode AS BIGINT) AS mode, CAST({_MODE_COSTS[0]}[mode + 1] + {_MODE_COSTS[1]}[uv_mode + 1] AS BIGINT) AS modes, y2, y, u, v,
 CAST({_MODE_COSTS[0]}[mode + 1] + {_MODE_COSTS[1]}[uv_mode + 1] + y2 + y + u + v AS BIGINT) AS total FROM kb JOIN su ON su.mb = kb.mb""",
    "adaptive_probabilities": f"{_BRANCHES}, {_CELLS}, {_adapt(False)} SELECT kind, band, ctx, node, zeros, ones, old, probability FROM ad",
    "pooled_probabilities": f"{_BRANCHES}, {_CELLS}, {_adapt(True)} SELECT kind, band, ctx, node, zeros, ones, old, probability FROM ad",
    "adaptive_cost": f"{_PRICED}, {_adapt(False)} {_REPRICE}",
    "pooled_cost": f"{_PRICED}, {_adapt(True)} {_REPRICE}",
}

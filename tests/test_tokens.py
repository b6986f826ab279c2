"""Token contexts, costs and adaptive probabilities against a walk through each picture in coding order."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenweave.functions.tables import ZIGZAG
from lumenweave.operators import tokens as T
from lumenweave.plans import tokens as Q


@pytest.fixture(scope="module")
def blocks(spark, sf_dir):
    coded = T.coded_blocks(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Q.STEPS)
    return coded.cache()


def walked(rows):
    """Counts of (kind, band, ctx, node, bit), and bits of each macroblock in 256ths, with flags kept along a row and over the columns, as a coder keeps them."""
    counts, bits = Counter(), Counter()
    steps = {}
    for symbol, _, node, bit in T.tree(T.TOKEN_CODES):
        steps.setdefault(symbol, []).append((node, bit))
    price = lambda p, bit: 2048 - T.whole_log2(256 - p if bit else p)
    table = lambda kind, band, ctx, node: 1 + (37 * kind + 53 * band + 71 * ctx + 29 * node + 90) % 254
    flags = {}
    for r in sorted(rows, key=lambda r: (r.picture, r.plane, r.br, r.bc)):
        if r.c is None:
            continue
        kind = 1 if r.plane == "y2" else 2 if r.plane != "y" else 3 if r.mode == 4 else 0
        z = [r.c[i] for i in ZIGZAG]
        first = int(kind == 0)
        left, above = (r.picture, r.plane, "row", r.br), (r.picture, r.plane, "column", r.bc)
        ctx, zero = flags.get(left, 0) + flags.get(above, 0), False
        last = max((i for i in range(first, 16) if z[i]), default=first - 1)
        flags[left] = flags[above] = int(last >= first)
        for i in range(first, min(last + 1, 15) + 1):
            size = min(abs(z[i]), T.LARGEST)
            token = T.END if i > last else size if size < 5 else 5 + sum(b <= size for b in T.CATEGORY_BASES[1:])
            for node, bit in steps[token][int(zero) :]:
                counts[kind, T.BANDS[i], ctx, node, bit] += 1
                bits[r.mb] += price(table(kind, T.BANDS[i], ctx, node), bit)
            if 5 <= token <= 10:
                extra, own = size - T.CATEGORY_BASES[token - 5], T.EXTRA_PROBABILITIES[token - 5]
                bits[r.mb] += sum(price(p, extra >> (len(own) - 1 - j) & 1) for j, p in enumerate(own))
            bits[r.mb] += 256 * (token != T.END and z[i] != 0)
            ctx, zero = min(2, abs(z[i])), z[i] == 0
    return counts, bits


def check(spark, blocks):
    counts, bits = walked(blocks.collect())
    rows = T.branches(T.tokens(T.with_contexts(blocks)))
    got = {(r.kind, r.band, r.ctx, r.node, bit): n for r in T.branch_counts(rows).collect() for bit, n in enumerate((r.zeros, r.ones)) if n}
    assert got == dict(counts)
    priced = T.priced(rows, Q.base_table(spark)).groupBy("mb").agg(F.sum("cost").alias("bits")).collect()
    assert {r.mb: r.bits for r in priced} == dict(bits)
    return counts


def test_counts_and_bits_of_pictures(spark, blocks):
    counts = check(spark, blocks)
    assert len({k[0] for k in counts}) == 4 and {k[2] for k in counts} == {0, 1, 2}


def test_sparse_and_extreme_levels(spark, blocks):
    """Empty blocks between others, levels at every category's ends and beyond the largest, blocks that end at their last place."""
    values = F.array(*(F.lit(v).cast("long") for v in (0, 1, -2, 4, 5, -6, 7, 10, 11, 18, -19, 34, 35, 66, 67, 2114, -2115, 30000)))
    at = lambda i: F.xxhash64("picture", "mb", "plane", "br", "bc", i)
    some = F.transform("c", lambda v, i: F.when(F.pmod(at(i), F.lit(5)) == 0, F.get(values, F.pmod(at(i + 16), F.lit(18)).cast("int"))).otherwise(F.lit(0).cast("long")))
    sparse = F.transform("c", lambda v, i: F.when(F.pmod(F.xxhash64("mb", "br", "bc"), F.lit(3)) == 0, F.lit(0).cast("long")).otherwise(F.get(F.col("s"), i)))
    rows = blocks.withColumn("s", some).withColumn("c", F.when(F.col("c").isNotNull(), sparse)).drop("s")
    without = F.when((F.col("plane") == "y") & (F.col("mode") != 4), F.transform("c", lambda v, i: F.when(i == 0, 0).otherwise(v).cast("long"))).otherwise(F.col("c"))
    check(spark, rows.withColumn("c", without).cache())


def test_an_adapted_table_costs_no_more(spark, sf_dir):
    for name in ("adaptive_cost", "pooled_cost"):
        rows = Q.QUERIES[name](spark, sf_dir).collect()
        assert len(rows) == 4 and all(r.after <= r.before for r in rows)


def test_few_decisions_keep_their_probability(spark):
    """Cells with one decision less than their band asks for stay where the prior is pooled."""
    cells = [(0, band, 0, 0, 128, 255, band) for band in (0, 2, 3, 5, 6, 7)]
    base = spark.createDataFrame([c[:6] for c in cells], "kind long, band long, ctx long, node long, probability long, update long").withColumn("update", F.lit(1).cast("long"))
    for least, bands in ((8, (0, 2)), (16, (3, 5)), (32, (6, 7))):
        for n in (least - 1, least):
            counts = spark.createDataFrame([(0, b, 0, 0, 1000 * n, 0) for b in bands], "kind long, band long, ctx long, node long, zeros long, ones long")
            few = counts.withColumn("zeros", F.lit(n).cast("long"))
            taken = {r.band for r in T.adapted(few, base, pooled=True).collect() if r.probability != r.old}
            assert taken <= (set(bands) if n == least else set())
            assert {r.band for r in T.adapted(counts, base, pooled=True).collect() if r.probability != r.old} == set(bands)
    # with an update that costs nothing, the least number is enough for the lowest bands
    free = base.withColumn("update", F.lit(1).cast("long")).where("band = 0")
    one = spark.createDataFrame([(0, 0, 0, 0, 8, 0)], "kind long, band long, ctx long, node long, zeros long, ones long")
    assert T.adapted(one, free, pooled=True).first().zeros == 8


def test_trees_and_costs():
    assert [x[2:] for x in T.tree(T.TOKEN_CODES) if x[0] == 7] == [(0, 1), (1, 1), (2, 1), (3, 1), (6, 1), (8, 0), (9, 0)]
    assert T.code_cost("0", (128,), ("0", "1")) == 256 and T.whole_log2(256) == 2048 and T.whole_log2(1) == 0

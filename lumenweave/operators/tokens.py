"""What the levels of a picture cost as coded tokens, as relations: blocks, tokens, branches (a row a coded binary decision), and the probabilities that price them.

Levels are all known before they are coded, so a block's context, whether the blocks beside it have any, is a window over a row and one over a column of the block grid, and
everything after is joins and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.functions import blocks as B
from lumenweave.functions.tables import ZIGZAG
from lumenweave.operators import blocks as O

#: Fixed values (RFC 6386, sections 8, 11 and 13): the codes of tokens 0 to 11 (zero to four, six categories, end), of the luma modes DC, V, H, TM, B_PRED and of the chroma modes.
TOKEN_CODES = ("10", "110", "11100", "111010", "111011", "111100", "111101", "1111100", "1111101", "1111110", "1111111", "0")
LUMA_CODES = ("100", "101", "110", "111", "0")
CHROMA_CODES = ("0", "10", "110", "111")
#: Probabilities of the modes' decisions, of the categories' extra bits, the categories' least magnitudes, and the band of each place.
LUMA_PROBABILITIES = (145, 156, 163, 128)
CHROMA_PROBABILITIES = (142, 114, 183)
EXTRA_PROBABILITIES = ((159,), (165, 145), (173, 148, 140), (176, 155, 140, 135), (180, 157, 141, 134, 130), (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129))
CATEGORY_BASES = (5, 7, 11, 19, 35, 67)
BANDS = (0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7)
END, SPLIT, LARGEST = 11, 4, 67 + 2**11 - 1
#: Macroblocks in a picture, across and down, where they are made of vectors, and vectors in a macroblock.
ACROSS, DOWN, PARTS = 4, 3, 6
BLOCK = ("picture", "mb", "plane", "br", "bc")


def tree(codes: tuple[str, ...]) -> list[tuple[int, int, int, int]]:
    """symbol, step, node, bit: the decisions of each symbol's code. Nodes are numbered as the sorted beginnings of codes."""
    nodes = {x: i for i, x in enumerate(sorted({c[:i] for c in codes for i in range(len(c))}))}
    return [(s, i, nodes[c[:i]], int(c[i])) for s, c in enumerate(codes) for i in range(len(c))]


def table(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A small table of numbers, as literals in the plan."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f'({', '.join(f'{v}L' for v in r)})' for r in rows)} AS t({', '.join(names)})")


def listed(values) -> Column:
    """Numbers as one literal array."""
    return F.expr(f"array({', '.join(map(str, values))})")


def whole_log2(x: int) -> int:
    """log2 in 256ths, straight between powers of two, of 1 to 256."""
    lead = x.bit_length() - 1
    return lead * 256 + (x - (1 << lead)) * 256 // (1 << lead)


def code_cost(code: str, probabilities: tuple[int, ...], codes: tuple[str, ...]) -> int:
    """Cost of a code in 256ths of a bit."""
    nodes = {x: i for i, x in enumerate(sorted({c[:i] for c in codes for i in range(len(c))}))}
    return sum(2048 - whole_log2(probabilities[nodes[code[:i]]] if code[i] == "0" else 256 - probabilities[nodes[code[:i]]]) for i in range(len(code)))


def coded_blocks(embeddings: DataFrame, steps: dict[str, tuple[int, int]]) -> DataFrame:
    """picture, mb, mode, uv_mode, plane, br, bc, c: quantized 4x4 blocks in the grid of their plane. Six vectors are a macroblock, four of luma, one of U, one of V; its largest
    label gives its mode. Where that isn't B_PRED, the first coefficients of its luma are a block of plane y2; where it is, that block has no levels."""
    n, part = F.col("vec_id"), F.col("vec_id") % PARTS
    coded = O.coefficients(O.sub_blocks(O.block_frame(embeddings)))
    mb = F.floor(n / PARTS)
    rows = coded.select(
        F.floor(n / (PARTS * ACROSS * DOWN)).alias("picture"), mb.alias("mb"), F.floor(mb % (ACROSS * DOWN) / ACROSS).alias("r"), (mb % ACROSS).alias("m"), part.alias("part"), F.col("k").cast("long").alias("k"), "label", "c",
    )
    rows = rows.repartition("picture")  # the one shuffle: all windows below, and the groups of macroblocks, lie within a picture
    of = Window.partitionBy("picture", "mb")
    rows = rows.withColumn("mode", F.max("label").over(of).cast("long") % 5).withColumn("uv_mode", F.min("label").over(of).cast("long") % 4)
    luma, down, across = F.col("part") < 4, F.floor(F.col("k") / 2), F.col("k") % 2
    plane = F.when(luma, "y").when(F.col("part") == 4, "u").otherwise("v")
    br = F.when(luma, F.col("r") * 4 + F.floor(F.col("part") / 2) * 2 + down).otherwise(F.col("r") * 2 + down)
    bc = F.when(luma, F.col("m") * 4 + F.col("part") % 2 * 2 + across).otherwise(F.col("m") * 2 + across)
    about = ("picture", "mb", "mode", "uv_mode")
    blocks = rows.select(*about, "r", "m", plane.alias("plane"), br.alias("br"), bc.alias("bc"), "c")
    first = F.struct((F.col("br") % 4 * 4 + F.col("bc") % 4).alias("at"), F.get("c", F.lit(0)).alias("v"))
    groups = blocks.groupBy(*about, "r", "m").agg(F.collect_list(F.when(F.col("plane") == "y", first)).alias("firsts"))
    placed = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.coalesce(F.element_at(F.map_from_entries("firsts"), i.cast("long")), F.lit(0).cast("long")))
    y2 = O.transformed(groups.withColumn("d", placed), "d", B.FORWARD_WHT)
    y2 = y2.select(*about, F.lit("y2").alias("plane"), F.col("r").alias("br"), F.col("m").alias("bc"), F.when(F.col("mode") != SPLIT, F.col("c")).alias("c"))
    own = F.when((F.col("plane") == "y") & (F.col("mode") != SPLIT), F.transform("c", lambda v, i: F.when(i == 0, 0).otherwise(v).cast("long"))).otherwise(F.col("c"))
    every = blocks.select(*about, "plane", "br", "bc", own.alias("c")).unionByName(y2)
    step = F.lit(None)
    for name, (dc, ac) in steps.items():
        step = F.when(F.col("plane") == name, F.struct(F.lit(dc).cast("long").alias("dc"), F.lit(ac).cast("long").alias("ac"))).otherwise(step)
    every = every.withColumn("step", step)
    return every.withColumn("c", F.transform("c", lambda v, i: B.quantized(v, F.when(i == 0, F.col("step.dc")).otherwise(F.col("step.ac"))))).drop("step")


def with_contexts(blocks: DataFrame) -> DataFrame:
    """The blocks with ``kind`` (0: luma without its first level, 1: y2, 2: chroma, 3: whole luma), ``first`` place, ``has`` (a level that isn't zero from there on; null: not
    coded) and ``ctx``: how many of the last coded blocks before it in its row and in its column have one."""
    kind = F.when(F.col("plane") == "y2", 1).when(F.col("plane") != "y", 2).when(F.col("mode") == SPLIT, 3).otherwise(0).cast("long")
    rows = blocks.withColumn("kind", kind).withColumn("first", F.when(F.col("kind") == 0, 1).otherwise(0))
    rows = rows.withColumn("scanned", F.transform(listed(ZIGZAG), lambda i: F.get("c", i)))
    rows = rows.withColumn("has", F.exists("scanned", lambda v: v != 0).cast("int"))  # a level before the first place is zero
    before = lambda line, order: F.coalesce(F.last("has", ignorenulls=True).over(Window.partitionBy("picture", "plane", line).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("ctx", (before("br", "bc") + before("bc", "br")).cast("long")).drop("c")


def tokens(blocks: DataFrame) -> DataFrame:
    """A row a coded token of ``with_contexts``: the block, kind, band, ctx, after_zero, token, v (its level; null at the end)."""
    last = F.array_max(F.transform("scanned", lambda v, i: F.when(v != 0, i).otherwise(-1)))
    rows = blocks.where("has IS NOT NULL").withColumn("last", F.greatest(last, F.col("first") - 1))
    places = F.sequence("first", F.least(F.lit(15), F.col("last") + 1))
    rows = rows.select(*BLOCK, "kind", "first", "last", F.col("ctx").alias("outer"), "scanned", F.explode(places).alias("i"))
    before = F.abs(F.get("scanned", F.col("i") - 1))
    begins, v = F.col("i") == F.col("first"), F.when(F.col("i") <= F.col("last"), F.get("scanned", F.col("i")))
    return rows.select(
        *BLOCK, "kind", F.get(listed(BANDS), F.col("i")).cast("long").alias("band"), F.when(begins, F.col("outer")).otherwise(F.least(before, F.lit(2).cast("long"))).alias("ctx"),
        (~begins & (before == 0)).alias("after_zero"), F.when(v.isNull(), F.lit(END).cast("long")).otherwise(B.token_class(F.least(F.abs(v), F.lit(LARGEST)))).alias("token"), v.alias("v"),
    )


def branches(rows: DataFrame) -> DataFrame:
    """A row a coded decision: the rows of ``tokens`` joined to the tree's table. After a zero a block can't end, so that the first decision isn't coded."""
    steps = table(rows.sparkSession, tree(TOKEN_CODES), ("token", "at", "node", "bit"))
    return rows.join(F.broadcast(steps), "token").where(~(F.col("after_zero") & (F.col("at") == 0)))


def branch_counts(rows: DataFrame) -> DataFrame:
    """kind, band, ctx, node, zeros, ones of ``branches``."""
    return rows.groupBy("kind", "band", "ctx", "node").agg(F.count_if(F.col("bit") == 0).alias("zeros"), F.count_if(F.col("bit") == 1).alias("ones"))


def bit_cost(probability: Column, bit: Column) -> Column:
    """Cost of a decision in 256ths of a bit; the probability, of 256, is that of a zero."""
    return 2048 - B.log2_q8(F.when(bit == 0, probability).otherwise(256 - probability))


def extra_cost(token: Column, v: Column) -> Column:
    """Cost of a level's sign and of the bits that tell its magnitude within its category."""
    price = lambda x: 2048 - whole_log2(x)
    own = (", ".join(f"struct({len(p) - 1 - j} AS shift, {price(x)}L AS zero, {price(256 - x)}L AS one)" for j, x in enumerate(p)) for p in EXTRA_PROBABILITIES)
    places = F.expr(f"array({', '.join(f'array({o})' for o in own)})")
    above = F.least(F.abs(v), F.lit(LARGEST)) - F.get(listed(CATEGORY_BASES), (token - 5).cast("int"))
    cost = lambda a, p: a + F.when(F.floor(above / F.pow(F.lit(2), p["shift"])) % 2 == 1, p["one"]).otherwise(p["zero"])
    extra = F.when(token.between(5, 10), F.aggregate(F.get(places, (token - 5).cast("int")), F.lit(0).cast("long"), cost)).otherwise(0)
    return extra + F.when(v != 0, 256).otherwise(0)


def priced(rows: DataFrame, probabilities: DataFrame) -> DataFrame:
    """The branches with ``cost``, by a table of kind, band, ctx, node and probability (1,056 rows)."""
    prices = F.broadcast(probabilities.select("kind", "band", "ctx", "node", "probability"))
    cost = bit_cost(F.col("probability"), F.col("bit"))
    once = F.when(F.col("at") == F.when(F.col("after_zero"), 1).otherwise(0), F.coalesce(extra_cost(F.col("token"), F.col("v")), F.lit(0))).otherwise(0)  # with a token's first decision
    return rows.join(prices, ["kind", "band", "ctx", "node"]).withColumn("cost", cost + once)


def adapted(counts: DataFrame, base: DataFrame, pooled: bool = False) -> DataFrame:
    """Every cell of ``base`` (kind, band, ctx, node, probability, update) with zeros, ones, and the probability that ``counts`` make worth its update.

    A new probability is estimated with the old one as a prior of 64 decisions; it is taken if what it saves, over counts and prior, exceeds what telling it costs. Where ``pooled``, the
    prior's weight grows with the band, the context and for y2 and chroma, cells of fewer than 8, 16 or 32 decisions (by band) stay, and the saving is over the counts alone."""
    cells = base.join(counts, ["kind", "band", "ctx", "node"], "left").fillna(0, ["zeros", "ones"])
    old, total = F.col("probability"), F.col("zeros") + F.col("ones")
    weight = F.lit(64).cast("long")
    if pooled:
        weight = F.when(F.col("band") >= 6, 96).when(F.col("band") >= 3, 48).otherwise(16) + F.col("ctx") * 16 + F.when(F.col("kind").isin(1, 2), 16).otherwise(0)
    cells = cells.withColumn("weight", weight.cast("long")).withColumn("prior", F.shiftright(old * F.col("weight") + 128, 8))
    both = total + F.col("weight")
    cells = cells.withColumn("new", B.clip(F.floor(((F.col("zeros") + F.col("prior")) * 256 + F.floor(both / 2)) / both), 1, 255))
    zeros, ones = (F.col("zeros"), F.col("ones")) if pooled else (F.col("zeros") + F.col("prior"), F.col("ones") + F.col("weight") - F.col("prior"))
    zero, one = F.lit(0), F.lit(1)
    cost = lambda p: zeros * bit_cost(p, zero) + ones * bit_cost(p, one)
    telling = bit_cost(F.col("update"), one) + 2048 - bit_cost(F.col("update"), zero)
    enough = total >= F.when(F.col("band") >= 6, 32).when(F.col("band") >= 3, 16).otherwise(8) if pooled else F.lit(True)
    taken = enough & (F.abs(F.col("new") - old) > 1) & (cost(old) > cost(F.col("new")) + telling)
    return cells.select("kind", "band", "ctx", "node", "zeros", "ones", old.alias("old"), F.when(taken, F.col("new")).otherwise(old).alias("probability"))

"""Rate-distortion points: matching, comparing and ranking."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _edges_below(edges: list, value: Column) -> Column:
    """How many of the sorted ``edges`` are below the value: the blocks of edges that are, then the edges of the next block."""
    if not edges:
        return F.lit(0)
    step = isqrt(len(edges)) + 1
    below = lambda part: F.size(F.filter(part, lambda e: e < value))
    blocks = below(F.array(*map(F.lit, edges[step - 1 :: step]))) if step <= len(edges) else F.lit(0)
    return blocks * step + below(F.slice(F.array(*map(F.lit, edges)), blocks * step + 1, step))


def nearest(ours: DataFrame, theirs: DataFrame, group: str, value: str, tie: str, carry: tuple[str, ...] = (), chunk_rows: int = 1_000_000) -> DataFrame:
    """For each row of ``ours`` the row of ``theirs`` in its group with the closest value, as near_<value>, near_<tie> and near_<column> of ``carry``; of two
    as close the smaller value, of equal values the least ``tie``.

    The closest is the last at or below or the first above. Each is a running last in a sort of its own direction, so the cost is that of two sorts. Groups are cut
    at quantiles of all values into chunks of about ``chunk_rows`` rows (64 chunks at least), so that neither a large group nor a crowd of values is one task's, unless they are equal; what a chunk
    lacks comes from the chunks before and after it."""
    names = [value, tie, *carry]
    once = theirs.groupBy(group, value).agg(F.min(F.struct(tie, *carry)).alias("t")).select(group, value, F.struct(value, *(F.col(f"t.{c}").alias(c) for c in (tie, *carry))).alias("mark"))
    every = ours.select(value).union(theirs.select(value))
    number = max(64, -(-every.count() // chunk_rows))
    edges = every.agg(F.percentile_approx(value, [i / number for i in range(1, number)], 100 * number)).first()[0] or []
    both = ours.select(group, value, F.struct(*ours.columns).alias("own"), F.lit(None).cast(once.schema["mark"].dataType).alias("mark")).unionByName(
        once.select(group, value, F.lit(None).cast(ours.select(F.struct(*ours.columns).alias("o")).schema["o"].dataType).alias("own"), "mark")
    )
    both = both.withColumn("chunk", _edges_below(edges, F.col(value)))

    def running(order: Column, of: str, *by: str) -> Column:
        return F.last(of, True).over(Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))

    inside = both.withColumn("below", running(F.asc(value), "mark", group, "chunk")).withColumn("above", running(F.desc(value), "mark", group, "chunk"))
    per = both.groupBy(group, "chunk").agg(F.max("mark").alias("most"), F.min("mark").alias("least"))
    line = Window.partitionBy(group)
    before = F.last("most", True).over(line.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("least", True).over(line.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1))
    outer = per.select(F.col(group).alias("_group"), F.col("chunk").alias("_chunk"), before.alias("before"), after.alias("after"))
    found = inside.where("own IS NOT NULL").join(outer, F.col(group).eqNullSafe(F.col("_group")) & (F.col("chunk") == F.col("_chunk")))
    below, above = F.coalesce("below", "before"), F.coalesce("above", "after")
    found = found.select("own", below.alias("below"), above.alias("above"))
    v = F.col(f"own.{value}")
    near_below = F.col("above").isNull() | (v - F.col(f"below.{value}") <= F.col(f"above.{value}") - v)
    pick = F.when(F.col("below").isNotNull() & near_below, F.col("below")).otherwise(F.col("above"))
    return found.withColumn("pick", pick).select("own.*", *(F.col(f"pick.{c}").alias(f"near_{c}") for c in names))


def differences(expected: DataFrame, current: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Rows whose current value fell more than ``tolerance`` below the expected one."""
    joined = expected.select(key, F.col(value).alias("expected")).join(current.select(key, F.col(value).alias("current")), key)
    return joined.where(F.col("expected") - F.col("current") > tolerance)


def first_failures(failures: DataFrame, order: list[str], most: int = 50) -> DataFrame:
    """The first ``most`` rows, each with the number of rows beyond them."""
    more = failures.select(F.greatest(F.lit(0).cast("long"), F.count("*") - most)).scalar()
    return failures.orderBy(*order).limit(most).withColumn("more", more)

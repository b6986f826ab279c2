"""Queries over points, outliers and manifests made from the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import rate_distortion as R


def _points(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "event_id", F.col("user_id").alias("image"), F.when(F.col("event_id") % 2 == 0, "ours").otherwise("lib").alias("encoder"),
        (F.lit(1000) + F.col("event_id") * 7919 % 50021).alias("bytes"), "value",
    )


def nearest_match(spark, sf_dir):
    p = _points(spark, sf_dir)
    ours = p.where("encoder = 'ours'").select("event_id", "image", "bytes")
    return R.nearest(ours, p.where("encoder = 'lib'"), "image", "bytes", "event_id")


def rd_summary(spark, sf_dir):
    """Mean over images of the mean ratio of bytes to the nearest point's, and mean value difference capped at 99."""
    p = _points(spark, sf_dir)
    ours = p.where("encoder = 'ours'").select("event_id", "image", "bytes", "value")
    near = R.nearest(ours, p.where("encoder = 'lib'"), "image", "bytes", "event_id", ("value",)).where("near_bytes IS NOT NULL")
    delta = F.least(F.lit(99.0), "value") - F.least(F.lit(99.0), "near_value")
    per = near.groupBy("image").agg(F.avg(delta).alias("d"), F.avg(F.col("bytes") / F.col("near_bytes")).alias("r"), F.count("*").alias("n"))
    return per.agg(F.round(F.avg("d"), 6).alias("mean_delta"), F.round(F.avg("r"), 6).alias("mean_ratio"), F.sum("n").alias("pairs"))


def sweep_rank(spark, sf_dir):
    rows = _points(spark, sf_dir).groupBy("image").agg(F.round(F.avg("value"), 6).alias("ssim"), F.sum("bytes").alias("bytes"))
    return rows.orderBy(F.desc("ssim"), "bytes", "image").limit(15)


def _files(spark, sf_dir):
    """Per order, as per file: sizes of two parts, what was used of them, and magnitudes."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(
        F.sum("l_partkey").alias("p0_size"), F.sum("l_suppkey").alias("tok_size"), F.max("l_partkey").alias("abs_max"), F.count("*").alias("partitions"),
        F.sum("l_linenumber").alias("nonzero"),
    )
    return rows.withColumn("p0_used", F.col("p0_size") - F.col("l_orderkey") % 7).withColumn("tok_used", F.col("tok_size") - F.col("l_orderkey") % 11 + 2)


def topk_outliers(spark, sf_dir):
    return _files(spark, sf_dir).select("l_orderkey", "abs_max", "nonzero").orderBy(F.desc("abs_max"), "l_orderkey").limit(10)


def slack_filter(spark, sf_dir):
    return _files(spark, sf_dir).where("p0_size - p0_used <= 2 OR tok_size - tok_used <= 2").select("l_orderkey", "p0_size", "p0_used", "tok_size", "tok_used")


def overread_filter(spark, sf_dir):
    return _files(spark, sf_dir).where("tok_used > tok_size").select("l_orderkey", (F.col("tok_used") - F.col("tok_size")).alias("over"))


def partition_scan(spark, sf_dir):
    return _files(spark, sf_dir).agg(F.count("*").alias("files"), F.max("partitions").alias("most"), F.count_if(F.col("partitions") > 1).alias("several"))


def _manifests(spark, sf_dir):
    """Orders that aren't pending, and what was returned of any order: either has keys that the other lacks."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"), F.floor("o_totalprice").alias("value"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("key")).agg(F.floor(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).alias("value"))
    return orders, lines


def manifest_regressions(spark, sf_dir):
    return R.differences(*_manifests(spark, sf_dir), "key", "value", 1000)


def missing_keys(spark, sf_dir):
    expected, current = _manifests(spark, sf_dir)
    return expected.join(current, "key", "left_anti").select("key")


def extra_keys(spark, sf_dir):
    expected, current = _manifests(spark, sf_dir)
    return current.join(expected, "key", "left_anti").select("key")


def manifest_diff(spark, sf_dir):
    a, b = (x.select("key", F.col("value").alias(n)) for x, n in zip(_manifests(spark, sf_dir), ("expected", "current"), strict=True))
    return a.join(b, "key", "full_outer").where(~F.col("expected").eqNullSafe(F.col("current")))


def min_of_runs(spark, sf_dir):
    """Least value of each image's runs; an image with a negative run is an error (null)."""
    return _points(spark, sf_dir).groupBy("image").agg(F.when(F.bool_or(F.col("value") < 0), None).otherwise(F.min("value")).alias("least"), F.count("*").alias("runs"))


_ALL = (nearest_match, rd_summary, sweep_rank, topk_outliers, slack_filter, overread_filter, partition_scan, manifest_regressions, missing_keys, extra_keys, manifest_diff, min_of_runs)
QUERIES = {f.__name__: f for f in _ALL}
_P = "p AS (SELECT event_id, user_id AS image, event_id % 2 = 0 AS ours, 1000 + event_id * 7919 % 50021 AS bytes, value FROM events)"
_NEAR = _P + """, near AS (SELECT o.event_id, o.image, o.bytes, l.bytes AS near_bytes, l.event_id AS near_event_id FROM p o LEFT JOIN p l ON o.image = l.image AND NOT
 l.ours WHERE o.ours QUALIFY row_number() OVER (PARTITION BY o.event_id ORDER BY abs(l.bytes - o.bytes), l.bytes, l.event_id) = 1)"""
_F = """f0 AS (SELECT l_orderkey, CAST(sum(l_partkey) AS BIGINT) AS p0_size, CAST(sum(l_suppkey) AS BIGINT) AS tok_size, max(l_partkey) AS abs_max, count(*) AS
 partitions, CAST(sum(l_linenumber) AS BIGINT) AS nonzero FROM lineitem GROUP BY 1), f AS (SELECT *, p0_size - l_orderkey % 7 AS p0_used, tok_size - l_orderkey % 11 + 2
 AS tok_used FROM f0)"""
_M = """a AS (SELECT o_orderkey AS key, CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT l_orderkey AS key,
 CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,2)))) AS BIGINT) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"""
SQL = {
    "nearest_match": f"WITH {_NEAR} SELECT * FROM near",
    "rd_summary": f"""WITH {_NEAR}, per AS (SELECT n.image, avg(least(99.0, o.value) - least(99.0, l.value)) AS d, avg(n.bytes / n.near_bytes) AS r, count(*) AS n FROM
 near n JOIN p o ON o.event_id = n.event_id JOIN p l ON l.event_id = n.near_event_id GROUP BY 1) SELECT round(avg(d), 6) AS mean_delta, round(avg(r), 6) AS mean_ratio,
 CAST(sum(n) AS BIGINT) AS pairs FROM per""",
    "sweep_rank": f"WITH {_P} SELECT image, round(avg(value), 6) AS ssim, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT 15",
    "topk_outliers": f"WITH {_F} SELECT l_orderkey, abs_max, nonzero FROM f ORDER BY abs_max DESC, l_orderkey LIMIT 10",
    "slack_filter": f"WITH {_F} SELECT l_orderkey, p0_size, p0_used, tok_size, tok_used FROM f WHERE p0_size - p0_used <= 2 OR tok_size - tok_used <= 2",
    "overread_filter": f"WITH {_F} SELECT l_orderkey, tok_used - tok_size AS over FROM f WHERE tok_used > tok_size",
    "partition_scan": f"WITH {_F} SELECT count(*) AS files, max(partitions) AS most, count(*) FILTER (partitions > 1) AS several FROM f",
    "manifest_regressions": f"WITH {_M} SELECT a.key, a.value AS expected, b.value AS current FROM a JOIN b ON a.key = b.key WHERE a.value - b.value > 1000",
    "missing_keys": f"WITH {_M} SELECT key FROM a WHERE key NOT IN (SELECT key FROM b)",
    "extra_keys": f"WITH {_M} SELECT key FROM b WHERE key NOT IN (SELECT key FROM a)",
    "manifest_diff": f"WITH {_M} SELECT coalesce(a.key, b.key) AS key, a.value AS expected, b.value AS current FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value",
    "min_of_runs": f"WITH {_P} SELECT image, CASE WHEN bool_or(value < 0) THEN NULL ELSE min(value) END AS least, count(*) AS runs FROM p GROUP BY 1",
}

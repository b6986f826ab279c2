"""Queries over fixed tables, strings and bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import blocks as B
from lumenweave.functions.tables import AC_STEPS, DC_STEPS, filter_level, qindex


def _listed(values):
    return F.array(*map(F.lit, values))


def _parts(spark, sf_dir, **numbers):
    """p_partkey, and numbers made of it."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *(v.cast("long").alias(k) for k, v in numbers.items()))


def quant_factors(spark, sf_dir):
    q = F.col("q").cast("int")
    dc, ac = _listed(DC_STEPS)[q].cast("long"), _listed(AC_STEPS)[q].cast("long")
    return _parts(spark, sf_dir, q=F.col("p_partkey") % 128).select(
        "p_partkey", "q", dc.alias("y1_dc"), ac.alias("y1_ac"), (dc * 2).alias("y2_dc"), F.greatest(F.lit(8), F.floor(ac * 155 / 100)).alias("y2_ac"),
        F.least(F.lit(132), dc).alias("uv_dc"), ac.alias("uv_ac"),
    )


def qindex_lookup(spark, sf_dir):
    return _parts(spark, sf_dir, quality=F.col("p_partkey") % 101).withColumn("q", _listed([qindex(i) for i in range(101)])[F.col("quality").cast("int")].cast("long"))


def lf_level(spark, sf_dir):
    return _parts(spark, sf_dir, q=F.col("p_partkey") % 128).withColumn("level", _listed([filter_level(i) for i in range(128)])[F.col("q").cast("int")].cast("long"))


def rdo_lambda(spark, sf_dir):
    """Weight of the rate, for multipliers 1 to 10 over divisors 1 to 4."""
    q = _parts(spark, sf_dir, q=F.col("p_partkey") % 128, mul=F.floor(F.col("p_partkey") / 128) % 10 + 1).withColumn("div", F.explode(F.sequence(F.lit(1), F.lit(4))))
    base = F.floor(F.col("q") * F.col("q") / 24) + 4
    return q.select("p_partkey", "q", "mul", "div", F.floor((base * F.col("mul") + F.floor(F.col("div") / 2)) / F.col("div")).alias("lambda"))


def prob_cost(spark, sf_dir):
    return _parts(spark, sf_dir, p=F.col("p_partkey") % 256 + 1).withColumn("cost", 2048 - B.log2_q8(F.col("p")))


def mb_grid(spark, sf_dir):
    rows = _parts(spark, sf_dir, size=F.col("p_partkey") % 4096 + 1)
    return rows.select("p_partkey", "size", F.floor((F.col("size") + 15) / 16).alias("blocks"), (F.floor((F.col("size") + 15) / 16) * 16).alias("padded"), F.floor((F.col("size") + 1) / 2).alias("chroma"))


def cross_corpus(spark, sf_dir):
    """Every part's image with every nation's and every quality, as a corpus of test images is listed: a few rows on one side, which are literals."""
    quality = F.explode(F.array(*map(F.lit, (10, 50, 75, 90)))).alias("q")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lower(F.translate("n_name", " ", "_")).alias("pattern"))
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").cast("long").alias("size")).distinct()
    rows = sizes.crossJoin(nations).select("pattern", "size", quality)
    return rows.select("pattern", "size", "q", F.concat(F.lit("gen_"), "pattern", F.lit("_"), "size", F.lit("x"), "size", F.lit("_q"), "q").alias("name"))


def union_fragments(spark, sf_dir):
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    parts = [read("region").select(F.lit("region").alias("part"), F.col("r_name").alias("name")), read("nation").select(F.lit("nation").alias("part"), F.col("n_name").alias("name"))]
    return parts[0].unionByName(parts[1])


def kv_parse(spark, sf_dir):
    """psnr and ssim out of lines like ``psnr=31.5 ssim=0.9 path=x``, with ``inf`` as a number; what is missing or no number is null."""
    n = F.col("p_partkey")
    psnr = F.when(n % 10 == 0, "inf").when(n % 13 == 0, "bad").otherwise(F.col("p_size").cast("string"))
    ssim = F.when(n % 17 == 0, "").otherwise(F.concat(F.lit(" ssim=0."), n.cast("string")))
    kv = F.str_to_map(F.concat(F.lit("psnr="), psnr, ssim, F.lit(" path="), n.cast("string")), F.lit(" "), F.lit("="))
    number = F.when(F.try_element_at("kv", F.lit("psnr")) == "inf", F.lit(float("inf"))).otherwise(F.try_element_at("kv", F.lit("psnr")).try_cast("double"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("kv", kv)
    return rows.select("p_partkey", number.alias("psnr"), F.try_element_at("kv", F.lit("ssim")).try_cast("double").alias("ssim"))


def label_extract(spark, sf_dir):
    """Numbers behind their labels in reports; null where a report lacks the label."""
    width = F.when(F.col("p_partkey") % 9 == 0, "Height: ").otherwise("Width: ")
    report = F.concat(width, "p_size", F.lit("\nPartitions: "), (F.col("p_partkey") % 8).cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("report", report)
    found = lambda label: F.regexp_extract("report", rf"{label}: (\d+)", 1).try_cast("bigint")
    return rows.select("p_partkey", found("Width").alias("width"), found("Partitions").alias("partitions"))


def path_parts(spark, sf_dir):
    url = F.col("url")
    base = F.substring_index(url, "/", -1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", base.alias("base"), F.regexp_replace(base, r"\.[^.]*$", "").alias("stem"),
        F.concat(F.lit('"'), F.replace(url, F.lit('"'), F.lit('""')), F.lit('"')).alias("quoted"),
    )


def sha256_texts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))


def riff_wrap(spark, sf_dir):
    data = B.riff_wrapped(F.coalesce("html", F.lit("")).cast("binary"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", F.octet_length(data).cast("long").alias("size"), F.lower(F.hex(F.substring(data, 1, 20))).alias("head"), F.sha2(data, 256).alias("sha"),
    )


def riff_parse(spark, sf_dir):
    """Files of one chunk read again; some are damaged: bytes after the chunk, another kind of chunk, another container."""
    n, whole = F.col("page_id"), B.riff_wrapped(F.coalesce("html", F.lit("")).cast("binary"))
    word, rest = (lambda s: F.lit(s).cast("binary")), (lambda at: F.substring(whole, at, 1 << 30))
    damaged = F.when(n % 7 == 0, F.concat(whole, word("XX"))).when(n % 5 == 0, F.concat(F.substring(whole, 1, 12), word("VP8L"), rest(17)))
    data = damaged.when(n % 11 == 0, F.concat(word("RIFX"), rest(5))).otherwise(whole)
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", data.alias("data"))
    size, payload = B.load_little_endian(F.col("data"), 5), B.load_little_endian(F.col("data"), 17)
    tag = lambda at: F.substring("data", at, 4).cast("string")
    error = F.when(tag(1) != "RIFF", "container").when(size + 8 != F.octet_length("data"), "size").when(tag(13) != "VP8 ", "chunk").when(payload + payload % 2 + 12 != size, "more")
    return rows.select("page_id", size.alias("riff_size"), tag(13).alias("fourcc"), payload.alias("payload_size"), error.alias("error"))


_ALL = (quant_factors, qindex_lookup, lf_level, rdo_lambda, prob_cost, mb_grid, cross_corpus, union_fragments, kv_parse, label_extract, path_parts, sha256_texts, riff_wrap, riff_parse)
QUERIES = {f.__name__: f for f in _ALL}
_DC, _AC = f"{DC_STEPS}", f"{AC_STEPS}"
_LE = "printf('%02x%02x%02x%02x', {0} & 255, ({0} >> 8) & 255, ({0} >> 16) & 255, ({0} >> 24) & 255)"
_RAW = "raw AS (SELECT page_id, encode(coalesce(html, '')) AS b, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages)"
_WRAP = _RAW + f""", w AS (SELECT page_id, n, encode('RIFF') || unhex({_LE.format('(12 + n + n % 2)')}) || encode('WEBPVP8 ') || unhex({_LE.format('n')}) || b || (CASE
 WHEN n % 2 = 1 THEN unhex('00') ELSE encode('') END) AS data FROM raw)"""
SQL = {
    "quant_factors": f"""SELECT p_partkey, q, CAST({_DC}[q+1] AS BIGINT) AS y1_dc, CAST({_AC}[q+1] AS BIGINT) AS y1_ac, CAST({_DC}[q+1]*2 AS BIGINT) AS y2_dc, CAST(greatest(8,
 {_AC}[q+1]*155//100) AS BIGINT) AS y2_ac, CAST(least(132, {_DC}[q+1]) AS BIGINT) AS uv_dc, CAST({_AC}[q+1] AS BIGINT) AS uv_ac FROM (SELECT p_partkey, p_partkey % 128 AS q FROM part)""",
    "qindex_lookup": """SELECT p_partkey, quality, CAST(greatest(0, least(127, floor(127*(1-pow(CASE WHEN quality < 75 THEN quality/100.0*2.0/3.0 ELSE 2.0*quality/100.0-1 END,
 1.0/3))))) AS BIGINT) AS q FROM (SELECT p_partkey, p_partkey % 101 AS quality FROM part)""",
    "lf_level": """SELECT p_partkey, q, CAST(least(63, CASE WHEN q <= 26 THEN (q*8+13)//26 WHEN q <= 38 THEN 8+((q-26)*3+6)//12 WHEN q <= 75 THEN 11+((q-38)*18+18)//37 ELSE
 29+((q-75)*34+26)//52 END + (q >= 32)::INT + (q >= 64)::INT + (q >= 96)::INT) AS BIGINT) AS level FROM (SELECT p_partkey, p_partkey % 128 AS q FROM part)""",
    "rdo_lambda": """SELECT p_partkey, q, mul, CAST(div AS INTEGER) AS div, ((q*q//24+4)*mul + div//2)//div AS lambda FROM (SELECT p_partkey, p_partkey % 128 AS q, p_partkey // 128 % 10 + 1 AS mul FROM part), (SELECT unnest(range(1, 5)) AS div)""",
    "prob_cost": """SELECT p_partkey, p, CAST(CASE WHEN p >= 256 THEN 0 ELSE 2048 - (CAST(floor(log2(p)) AS BIGINT)*256 + (p - (1 << CAST(floor(log2(p)) AS BIGINT)))*256//(1 <<
 CAST(floor(log2(p)) AS BIGINT))) END AS BIGINT) AS cost FROM (SELECT p_partkey, p_partkey % 256 + 1 AS p FROM part)""",
    "mb_grid": "SELECT p_partkey, size, (size+15)//16 AS blocks, (size+15)//16*16 AS padded, (size+1)//2 AS chroma FROM (SELECT p_partkey, p_partkey % 4096 + 1 AS size FROM part)",
    "cross_corpus": """SELECT pattern, size, q, concat('gen_', pattern, '_', size, 'x', size, '_q', q) AS name FROM (SELECT lower(translate(n_name, ' ', '_')) AS pattern FROM nation), (SELECT DISTINCT CAST(p_size AS BIGINT) AS size FROM part),
 (VALUES (10), (50), (75), (90)) c(q)""",
    "union_fragments": "SELECT 'region' AS part, r_name AS name FROM region UNION ALL SELECT 'nation', n_name FROM nation",
    "kv_parse": """SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN CAST('inf' AS DOUBLE) WHEN p_partkey % 13 <> 0 THEN CAST(p_size AS DOUBLE) END AS psnr,
 CASE WHEN p_partkey % 17 <> 0 THEN CAST('0.' || p_partkey AS DOUBLE) END AS ssim FROM part""",
    "label_extract": "SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS BIGINT) END AS width, CAST(p_partkey % 8 AS BIGINT) AS partitions FROM part",
    "path_parts": """SELECT page_id, split_part(url, '/', -1) AS base, regexp_replace(split_part(url, '/', -1), '\\.[^.]*$', '') AS stem, '"' || replace(url, '"', '""') || '"' AS quoted FROM pages""",
    "sha256_texts": "SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents",
    "riff_wrap": f"WITH {_WRAP} SELECT page_id, CAST(octet_length(data) AS BIGINT) AS size, lower(substr(hex(data), 1, 40)) AS head, sha256(data) AS sha FROM w",
    "riff_parse": f"""WITH {_RAW}, e AS (SELECT page_id, n, CASE WHEN page_id % 7 = 0 THEN 'size' WHEN page_id % 5 = 0 THEN 'chunk' WHEN page_id % 11 = 0 THEN 'container' END AS error FROM raw)
 SELECT page_id, 12 + n + n % 2 AS riff_size, CASE error WHEN 'chunk' THEN 'VP8L' ELSE 'VP8 ' END AS fourcc, n AS payload_size, error FROM e""",
}

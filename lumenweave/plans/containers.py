"""Queries over byte containers, some of them damaged: chunk walks over whole pages, partition tables, filtered rows of pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import blocks as B
from lumenweave.functions import containers as C
from lumenweave.operators import blocks as O
from lumenweave.operators import images as I
from lumenweave.sources import riff

def _chunk(tag, payload):
    n = F.octet_length(payload).cast("long")
    return F.concat(tag.cast("binary"), B.little_endian(n), payload, F.when(n % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.lit("").cast("binary")))


def _files(spark, sf_dir):
    """page_id, data: a file a page, with up to 119 chunks of up to four bytes before the image, whose payload is the whole html. Of some the image is of another kind, the last byte
    of padding or all from the 21st byte on is missing, a size reaches round, or the beginning is another's."""
    n = F.col("page_id").cast("long")
    own = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    extra = F.transform(F.sequence(F.lit(0).cast("long"), n % 120), lambda i: F.when(i == n % 120, F.lit("").cast("binary")).otherwise(_chunk(F.lit("EXIF"), F.encode(F.repeat(F.lit("e"), (i % 5).cast("int")), "utf-8"))))
    before = F.aggregate(extra, F.lit("").cast("binary"), lambda a, c: F.concat(a, c))
    round_ = F.when(n % 13 == 7, F.concat(F.lit("LOOP").cast("binary"), F.unhex(F.lit("F8FFFFFF")))).otherwise(F.lit("").cast("binary"))
    body = F.concat(before, round_, _chunk(F.when(n % 5 == 2, "ALPH").otherwise("VP8 "), own))
    head = F.when(n % 19 == 3, "RIFX").otherwise("RIFF").cast("binary")
    whole = F.concat(head, B.little_endian(F.octet_length(body).cast("long") + 4), F.lit("WEBP").cast("binary"), body)
    data = F.when(n % 11 == 4, F.substring("whole", 1, 20)).when(n % 7 == 5, F.expr("substring(whole, 1, octet_length(whole) - 1)")).otherwise(F.col("whole"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", whole.alias("whole")).select("page_id", data.alias("data"))


def _walked(spark, sf_dir):
    return _files(spark, sf_dir).select("page_id", C.chunks(F.col("data")).alias("w"))


def riff_walk(spark, sf_dir):
    """Place and size of the image among the chunks of each file, how many chunks came before it, or what is wrong."""
    last, good = F.try_element_at("w.chunks", F.lit(-1)), F.col("w.error").isNull()
    return _walked(spark, sf_dir).select(
        "page_id", F.when(good, last["at"]).alias("offset"), F.when(good, last["size"]).alias("size"), F.size("w.chunks").cast("long").alias("chunks"), F.col("w.error").alias("error"),
    )


def riff_chunks(spark, sf_dir):
    """A row a chunk, up to the image or what is wrong."""
    rows = _walked(spark, sf_dir).select("page_id", F.posexplode("w.chunks").alias("i", "c"))
    return rows.select("page_id", "i", F.decode("c.tag", "utf-8").alias("tag"), F.col("c.at").alias("offset"), F.col("c.size").alias("size"))


def partition_sizes(spark, sf_dir):
    """Token partitions of a frame for each part: one, two, four or eight, after a first partition; of some the table is cut short, or its sizes reach beyond the bytes."""
    n = F.col("p_partkey")
    size = lambda i: (n * (i + 3) + i * i * 7) % 50
    count = F.pow(F.lit(2), n % 4).cast("long")
    table = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")), lambda i: F.when(i < count - 1, B.little_endian(size(i), 3)).otherwise(F.lit("").cast("binary")))
    data = F.concat(F.unhex(F.repeat(F.lit("00"), (n % 40 + 10).cast("int"))), F.aggregate(table, F.lit("").cast("binary"), lambda a, b: F.concat(a, b)), F.unhex(F.repeat(F.lit("ff"), (n * 7 % 300).cast("int"))))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (n % 40).alias("first"), count.alias("partitions"), data.alias("whole"))
    rows = rows.withColumn("data", F.when(n % 9 == 1, F.expr("substring(whole, 1, first + 12)")).otherwise(F.col("whole")))
    sizes = C.partition_sizes(F.col("data"), F.col("first"), F.col("partitions"))
    return rows.select("p_partkey", "partitions", sizes.alias("s")).select("p_partkey", "partitions", O.text(F.col("s")).alias("sizes"))


def _filtered(spark, sf_dir):
    """picture, rows (kind, v): pictures of 21x13 pixels, three bytes a pixel, whose rows are filtered by kinds that go round; every fifteenth picture has a kind of none in one row."""
    pixels = I.picture_pixels(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    lines = pixels.groupBy("name", "y").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b"))), lambda p: F.array(p["r"], p["g"], p["b"]))).alias("v"))
    pictures = lines.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "v"))), lambda r: r["v"]).alias("lines"))
    n = F.col("name").cast("long")
    kind = lambda y: F.when((n % 15 == 14) & (y == 6), 5).otherwise((n + y) % 5)
    row = lambda v, y: F.struct(kind(y).cast("long").alias("kind"), C.filtered_row(v, F.when(y > 0, F.get("lines", y - 1)).otherwise(F.array().cast("array<bigint>")), kind(y), 3).alias("v"))
    return pictures.select("name", F.transform("lines", row).alias("rows"))


def filtered_rows(spark, sf_dir):
    """Sum of each filtered row's bytes, and of what signed bytes would have it, the usual measure of which filter is best."""
    rows = _filtered(spark, sf_dir).select("name", F.posexplode("rows").alias("y", "row"))
    return rows.select("name", "y", F.col("row.kind").alias("kind"), O.total(F.col("row.v")).alias("total"), O.total(F.transform("row.v", lambda v: F.least(v, 256 - v))).alias("spread"))


def row_filters(spark, sf_dir):
    """Digest of each picture's bytes after its filtered rows were restored; null where a row's filter is unknown."""
    whole = C.unfiltered(F.col("rows"), 3)
    rows = _filtered(spark, sf_dir).select("name", F.flatten(whole).alias("v"))
    return rows.select("name", F.size(F.coalesce("v", F.array().cast("array<bigint>"))).alias("bytes"), F.when(F.col("v").isNotNull(), F.sha2(F.unhex(I.little_endian_hex(F.col("v"), 1)), 256)).alias("sha"))


def riff_files(spark, sf_dir):
    """Every page as an image file of its own, written through the data source and read back: size and digest of the payload."""
    folder, html = riff.shared_folder(spark), F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat("page_id", F.lit(".webp")).alias("name"), html.alias("payload"))
    riff.registered(spark)
    rows.write.format("riff").mode("append").save(folder)
    found = spark.read.format("riff").load(folder).where("tag = 'VP8 '")
    return found.select(F.substring_index("name", ".", 1).cast("long").alias("page_id"), F.col("at").alias("offset"), "size", F.sha2("payload", 256).alias("sha"))


_ALL = (riff_files, riff_walk, riff_chunks, partition_sizes, filtered_rows, row_filters)
QUERIES = {f.__name__: f for f in _ALL}

_EXTRA = "list_transform(range(0, n % 120), lambda i: 8 + i % 5 + i % 5 % 2)"
# the place of each chunk is known from how the files are made
_WALK = f"""WITH o AS (SELECT page_id, CAST(page_id AS BIGINT) AS n, octet_length(encode(coalesce(html, ''))) AS own FROM pages),
x AS (SELECT *, {_EXTRA} AS extra, CASE WHEN n % 13 = 7 THEN 8 ELSE 0 END AS loop FROM o), y AS (SELECT *, CAST(coalesce(list_sum(extra), 0) AS BIGINT) AS before FROM x),
z AS (SELECT *, 12 + before + loop + 8 + own + own % 2 AS whole FROM y), t AS (SELECT *, CASE WHEN n % 11 = 4 THEN least(20, whole) WHEN n % 7 = 5 THEN whole - 1 ELSE whole END AS total FROM z),
c AS (SELECT page_id, n, total, loop, own, before, unnest(range(0, n % 120 + 1)) AS i, extra FROM t),
p AS (SELECT page_id, n, total, loop, own, before, i, 12 + CAST(coalesce(list_sum(extra[1:i]), 0) AS BIGINT) AS here, i = n % 120 AS image FROM c),
q AS (SELECT *, CASE WHEN image THEN CASE WHEN loop > 0 THEN 'LOOP' WHEN n % 5 = 2 THEN 'ALPH' ELSE 'VP8 ' END ELSE 'EXIF' END AS tag, CASE WHEN image THEN CASE WHEN loop > 0 THEN 4294967288 ELSE own END ELSE i % 5 END AS size FROM p WHERE n % 19 <> 3),
r AS (SELECT *, here + 8 <= total AND here + 8 + size <= total AS fits, here + 8 > total AS ended, tag <> 'VP8 ' AND here + 8 + size + size % 2 > total AS padless FROM q),
s AS (SELECT *, coalesce(bool_and(fits AND NOT padless) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS reached FROM r)"""
_SIZES = "list_transform(range(0, 7), lambda i: (p_partkey * (i + 3) + i * i * 7) % 50)"
_ROWS = f"""name, y, list(v ORDER BY x, k) AS v FROM (SELECT name, y, x, 1 AS k, r AS v FROM px UNION ALL SELECT name, y, x, 2, g FROM px UNION ALL SELECT name, y, x, 3, b FROM px) GROUP BY ALL"""


def _sql() -> dict[str, str]:
    from lumenweave.plans.images import _PICTURES

    left, above, corner = "(CASE WHEN i > 3 THEN v[i - 3] ELSE 0 END)", "coalesce(up[i], 0)", "(CASE WHEN i > 3 THEN coalesce(up[i - 3], 0) ELSE 0 END)"
    near = lambda a, b: f"abs({left} + {above} - {corner} - {a}) <= abs({left} + {above} - {corner} - {b})"
    guess = f"CASE kind WHEN 1 THEN {left} WHEN 2 THEN {above} WHEN 3 THEN ({left} + {above}) // 2 WHEN 0 THEN 0 ELSE CASE WHEN {near(left, above)} AND {near(left, corner)} THEN {left} WHEN {near(above, corner)} THEN {above} ELSE {corner} END END"
    return {
        "riff_files": """SELECT CAST(page_id AS BIGINT) AS page_id, CAST(20 AS BIGINT) AS "offset", CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size, sha256(coalesce(html, '')) AS sha FROM pages""",
        "riff_walk": f"""{_WALK} SELECT t.page_id, CASE WHEN e IS NULL THEN s.here + 8 END AS "offset", CASE WHEN e IS NULL THEN CAST(s.size AS BIGINT) END AS size, coalesce(k, 0) AS chunks, e AS error FROM
 (SELECT t.page_id, k, CASE WHEN t.n % 19 = 3 THEN 'no container' WHEN cut THEN 'cut' WHEN NOT coalesce(image, false) THEN 'no image' END AS e FROM t LEFT JOIN (SELECT page_id, count(*) FILTER (reached AND fits) AS k,
 bool_or(reached AND NOT ended AND (NOT fits OR padless)) AS cut, bool_or(reached AND fits AND tag = 'VP8 ') AS image FROM s GROUP BY 1) g ON g.page_id = t.page_id) t LEFT JOIN s ON s.page_id = t.page_id AND s.tag = 'VP8 '""",
        "riff_chunks": f"""{_WALK} SELECT page_id, CAST(i AS INTEGER) AS i, tag, here + 8 AS "offset", CAST(size AS BIGINT) AS size FROM s WHERE reached AND fits""",
        "partition_sizes": f"""WITH p AS (SELECT p_partkey, p_partkey % 40 AS first, 1 << (p_partkey % 4) AS k, {_SIZES} AS sizes, p_partkey * 7 % 300 AS tokens FROM part),
 l AS (SELECT *, CASE WHEN p_partkey % 9 = 1 THEN least(2, 3 * (k - 1) + tokens) ELSE 3 * (k - 1) + tokens END AS rest FROM p),
 s AS (SELECT *, coalesce(list_sum(sizes[1:k - 1]), 0) AS total FROM l)
 SELECT p_partkey, CAST(k AS BIGINT) AS partitions, CASE WHEN k = 1 THEN CAST(rest AS VARCHAR) WHEN rest >= 3 * (k - 1) AND total <= rest - 3 * (k - 1) THEN array_to_string([0] || sizes[1:k - 2] || [rest - 3 * (k - 1) - total], ',') END AS sizes FROM s""",
        "filtered_rows": f"""WITH {_PICTURES}, li AS (SELECT {_ROWS}), ki AS (SELECT *, CASE WHEN CAST(name AS BIGINT) % 15 = 14 AND y = 6 THEN 5 ELSE (CAST(name AS BIGINT) + y) % 5 END AS kind, lag(v) OVER (PARTITION BY name ORDER BY y) AS up FROM li),
 fi AS (SELECT name, y, kind, list_transform(range(1, 64), lambda i: (v[i] - ({guess}) + 512) % 256) AS f FROM ki)
 SELECT name, CAST(y AS INTEGER) AS y, CAST(kind AS BIGINT) AS kind, CAST(list_sum(f) AS BIGINT) AS total, CAST(list_sum(list_transform(f, lambda v: least(v, 256 - v))) AS BIGINT) AS spread FROM fi""",
        "row_filters": f"""WITH {_PICTURES} SELECT name, CAST(CASE WHEN CAST(name AS BIGINT) % 15 = 14 THEN 0 ELSE 3 * count(*) END AS INTEGER) AS bytes,
 CASE WHEN CAST(name AS BIGINT) % 15 <> 14 THEN sha256(unhex(string_agg(printf('%02x%02x%02x', r, g, b), '' ORDER BY y, x))) END AS sha FROM px GROUP BY name""",
    }


SQL = _sql()

"""Queries over records: containers, headers and reports as text or bytes, some of them damaged, and what compares them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import blocks as B
from lumenweave.functions import frames as H
from lumenweave.functions import planes as P
from lumenweave.plans.blocks import _PX
from lumenweave.sources.files import binary_files, has_suffix, parsed, quoted


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_scan(spark, sf_dir):
    """The driver's files as a corpus: name of the table, number of files and bytes. No SQL: only the engine sees the files."""
    table = F.regexp_extract("path", r"/([a-z]+)\.parquet", 1)
    return binary_files(spark, sf_dir, "*.parquet").select(table.alias("table"), "length").groupBy("table").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def _chunk(tag: str, payload):
    n = F.octet_length(payload).cast("long")
    return F.concat(F.lit(tag).cast("binary"), B.little_endian(n), payload, F.when(n % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.lit("").cast("binary")))


def png_chunk(spark, sf_dir):
    """Part names as PNG chunks: big-endian length, type, data and the CRC-32 of both."""
    data = F.col("p_name").cast("binary")
    big = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    typed = F.concat(F.lit("tEXt").cast("binary"), data)
    whole = F.concat(big(F.octet_length(data).cast("long")), typed, big(F.crc32(typed)))
    return _read(spark, sf_dir, "part").select("p_partkey", F.crc32(typed).alias("crc"), F.lower(F.hex(whole)).alias("chunk"))


def samples_8bit(spark, sf_dir):
    """16-bit grey with alpha as 8-bit colour: the upper byte of each, and the grey thrice."""
    grey, alpha = (F.col("l_partkey") * 7919) % 65536, (F.col("l_suppkey") * 104729) % 65536
    top = lambda v: F.shiftright(v, 8)
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(top(grey).alias(c) for c in "rgb"), top(alpha).alias("a"))


def token_extra(spark, sf_dir):
    """Token, extra bits and what they add, of magnitudes that are capped at 2114."""
    size = F.least(F.lit(2114).cast("long"), F.abs(F.col("l_partkey") * F.col("l_linenumber") - 5000) % 4000)
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", size.alias("size"), B.token_class(size).alias("token"))
    base = F.element_at(F.array(*map(F.lit, (0, 1, 2, 3, 4, 5, 7, 11, 19, 35, 67))), (F.col("token") + 1).cast("int"))
    bits = F.element_at(F.array(*map(F.lit, (0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 11))), (F.col("token") + 1).cast("int"))
    return rows.select("l_orderkey", "l_linenumber", "size", "token", bits.alias("bits"), (F.col("size") - base).alias("extra"))


def bool_cost(spark, sf_dir):
    """Cost of a coded bit, in 256ths, by probability of a zero."""
    rows = _read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 255 + 1).alias("p"), F.explode(F.array(F.lit(0), F.lit(1))).alias("bit"))
    cost = 2048 - B.log2_q8(F.when(F.col("bit") == 0, F.col("p")).otherwise(256 - F.col("p")))
    bits = F.floor(cost * 8 / 256)
    return rows.select("p_partkey", "p", "bit", cost.alias("cost"), F.shiftright(cost * 8, 11).alias("token_rate"), F.floor((bits + 7) / 8).alias("mode_rate"))


def scaled_steps(spark, sf_dir):
    """Shares of quantizer steps, of 1 to 2047."""
    rows = _read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 159 + 1).alias("step"), F.explode(F.array(*(F.lit(p).cast("long") for p in (0, 1, 60, 100, 115, 130, 2000)))).alias("percent"))
    return rows.select("p_partkey", "step", "percent", P.scaled_step(F.col("step"), F.col("percent")).alias("scaled"))


def axis_ticks(spark, sf_dir):
    """Six ticks over the sizes of each image's points, where they lie on an axis of 600, and as text."""
    e = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    rows = e.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("at", P.tick(F.col("i"), F.col("low"), F.col("high"), 6))
    pad = (F.col("high") - F.col("low")) * 0.03
    place = F.when(F.col("high") == F.col("low"), 300.0).otherwise((F.col("at") - F.col("low") + pad) / (F.col("high") - F.col("low") + pad * 2) * 600)
    return rows.select("user_id", "i", F.round("at", 4).alias("at"), F.round(place, 3).alias("x"))


def number_texts(spark, sf_dir):
    """Numbers as reports print them: with six places or ``inf``, and with fewer places the larger they are."""
    value = F.col("p_size").cast("double") * F.col("p_partkey") / 8
    six = F.when(F.col("p_partkey") % 10 == 0, "inf").otherwise(F.format_string("%.6f", value))
    return _read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("psnr_rgb="), six).alias("six"), P.number_text(value).alias("short"))


def mode_names(spark, sf_dir):
    """Mode names by number, the number itself beyond them, and the sub-block mode that stands for a luma mode."""
    mode = (F.col("p_partkey") % 7).cast("int")
    stands = F.coalesce(F.get(F.array(*map(F.lit, P.SUBBLOCK_OF)), mode), F.lit(0))
    return _read(spark, sf_dir, "part").select("p_partkey", P.mode_name(mode).alias("name"), stands.alias("bmode"))


#: What each spelling of an encoder's mode means.
MODE_ALIASES = {"bpred": "bpred", "bpred-rdo": "bpred-rdo", "bpred_rdo": "bpred-rdo", "i16": "i16", "i16x16": "i16", "dc": "dc", "dc_pred": "dc"}


def option_parse(spark, sf_dir):
    """Whole numbers within 32 bits and modes by any of their spellings; others are errors (null)."""
    n = F.col("p_partkey")
    raw = F.when(n % 7 == 0, F.concat(n.cast("string"), F.lit("x"))).when(n % 5 == 0, F.concat(F.lit("-99999"), n.cast("string"), F.lit("0000"))).when(n % 11 == 0, "").otherwise((n - 100).cast("string"))
    spelling = F.element_at(F.array(*map(F.lit, [*MODE_ALIASES, "i4", "DC"])), (n % 9 + 1).cast("int"))
    number = F.when(raw.rlike(r"^[+-]?\d+$"), raw.try_cast("bigint"))
    number = F.when(F.abs(number) <= 2147483647, number)
    known = F.create_map(*(F.lit(x) for kv in MODE_ALIASES.items() for x in kv))
    return _read(spark, sf_dir, "part").select("p_partkey", number.alias("number"), F.try_element_at(known, spelling).alias("mode"))


def text_escapes(spark, sf_dir):
    """Texts quoted for CSV and escaped for XML."""
    text = F.coalesce("text", F.lit(""))
    xml = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        xml = F.replace(xml, F.lit(raw), F.lit(safe))
    return _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')).alias("csv"), xml.alias("xml"))


def csv_lines(spark, sf_dir):
    """Timings as lines of a CSV file: the least of three runs, or ERR where a run failed."""
    e = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("least"), F.min("event_id").alias("first"))
    cell = F.when(F.col("first") % 5 == 0, "ERR").otherwise(F.floor(F.col("least") * 1000).cast("string"))
    return e.select("user_id", F.concat(F.lit('"file '), F.col("user_id").cast("string"), F.lit('.webp",'), cell).alias("line"))


def csv_points(spark, sf_dir):
    """Events as quoted lines of delimited text and back, some of them damaged: a value that is no number, a value too few, one too many. Bad lines come back as they are."""
    n = F.col("event_id")
    kind = F.when(n % 5 == 1, F.concat(F.lit('a "b", '), "event_type")).otherwise(F.col("event_type"))
    value = F.when(n % 17 == 3, F.lit("x1y")).otherwise(F.round("value", 2).cast("decimal(20,2)").cast("string"))
    line = quoted(n, F.col("user_id"), kind, value)
    line = F.when(n % 19 == 4, quoted(n, F.col("user_id"))).when(n % 23 == 5, F.concat(line, F.lit(",7"))).otherwise(line)
    rows = _read(spark, sf_dir, "events").select("event_id", parsed(line, "id BIGINT, user BIGINT, kind STRING, value DOUBLE").alias("p"))
    good = lambda c: F.when(F.col("p.bad").isNull(), F.col(f"p.{c}"))
    return rows.select("event_id", *(good(c).alias(c) for c in ("id", "user", "kind", "value")), F.col("p.bad").alias("bad"))


def manifest_lines(spark, sf_dir):
    """Lines of a manifest, some damaged, as path, quality and digest, or what is wrong."""
    n = F.col("p_partkey")
    sha = F.sha2(F.col("p_name").cast("binary"), 256)
    line = F.when(n % 13 == 0, "# comment").when(n % 11 == 0, F.concat(F.lit("a.png  "), F.substring(sha, 1, 9))).when(n % 7 == 0, F.concat(F.lit("a.png  q=x  "), sha)).otherwise(F.concat(F.lit("dir/"), n.cast("string"), F.lit(".png  q="), (n % 101).cast("string"), F.lit("  "), sha))
    rows = _read(spark, sf_dir, "part").select("p_partkey", line.alias("line")).where("NOT startswith(line, '#')")
    pattern = r"^(\S+)\s+q=(\S+)\s+([0-9a-f]{64})$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    error = F.when(part(1) == "", "form").when(part(2).try_cast("int").isNull(), "quality")
    return rows.select(
        "p_partkey", F.when(error.isNull(), part(1)).alias("path"), F.when(error.isNull(), part(2).try_cast("int")).alias("q"),
        F.when(error.isNull(), part(3)).alias("sha"), error.alias("error"),
    )


def report_lines(spark, sf_dir):
    """Frame headers as the lines of a report."""
    rows = H.keyframe_header(_headers())
    h = _read(spark, sf_dir, "part").select("p_partkey", rows.alias("h"))
    line = F.when(F.col("h.error").isNotNull(), F.concat(F.lit("error: "), F.col("h.error"))).otherwise(F.concat_ws("\n", F.concat(F.lit("Dimensions: "), F.col("h.width").cast("string"), F.lit("x"), F.col("h.height").cast("string")), F.concat(F.lit("Profile: "), F.col("h.profile").cast("string"))))
    return h.select("p_partkey", line.alias("report"))


def _headers():
    n = F.col("p_partkey").cast("long")
    tag = F.when(n % 5 == 0, 1).otherwise(0) + n % 4 * 2 + 16 + n % 30 * 32
    code = F.when(n % 11 == 0, F.unhex(F.lit("9D012B"))).otherwise(F.unhex(F.lit(H.START_CODE)))
    return F.concat(B.little_endian(tag, 3), code, B.little_endian(n % 9 * 100, 2), B.little_endian(n % 13 * 50 + 16384, 2), F.unhex(F.lit("00" * 30)))


def header_gates(spark, sf_dir):
    """Frames by what keeps them from being decoded; more than one token partition is not supported."""
    partitions = F.pow(F.lit(2), F.col("p_partkey") % 4)
    rows = _read(spark, sf_dir, "part").select(H.keyframe_header(_headers()).alias("h"), partitions.alias("n"))
    error = F.coalesce(F.col("h.error"), F.when(F.col("n") != 1, "partitions"), F.lit("none"))
    return rows.groupBy(error.alias("error")).agg(F.count("*").alias("files"))


def header_compare(spark, sf_dir):
    """Header fields of two tools' reports, file by file; fields that both lack are equal."""
    ours = _read(spark, sf_dir, "part").select("p_partkey", H.keyframe_header(_headers()).alias("h")).select("p_partkey", "h.width", "h.height", "h.error")
    n = F.col("p_partkey").cast("long")
    theirs = _read(spark, sf_dir, "part").where("p_size > 3").select(
        "p_partkey", (n % 9 * 100).alias("w"), F.when(n % 17 != 0, n % 13 * 50).alias("t"),
        F.when(n % 5 == 0, "not a key frame").when(n % 11 == 0, "start code").alias("e"),
    )
    joined = ours.join(theirs, "p_partkey", "left")
    same = {k: F.col(a).eqNullSafe(F.col(b)) for k, a, b in (("width", "width", "w"), ("height", "height", "t"), ("error", "error", "e"))}
    return joined.select(*(v.alias(k) for k, v in same.items())).groupBy("width", "height", "error").agg(F.count("*").alias("files"))


def byte_equal(spark, sf_dir):
    """Pages of two crawls by whether their bytes are the same; the digest of a page's bytes is joined, not the bytes."""
    sha = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    ours = _read(spark, sf_dir, "pages").select("page_id", sha.alias("a"))
    theirs = _read(spark, sf_dir, "pages").select("page_id", F.sha2(F.coalesce(F.rtrim("html"), F.lit("")).cast("binary"), 256).alias("b"))
    return ours.join(theirs, "page_id").groupBy((F.col("a") == F.col("b")).alias("equal")).agg(F.count("*").alias("pages"))


def finite_points(spark, sf_dir):
    """Points with a finite value, by size; of values that aren't, only the number is kept."""
    value = F.when(F.col("event_id") % 10 == 0, F.lit(float("inf"))).when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(finite).alias("finite"), F.count_if(~finite).alias("other"), F.max(F.when(finite, value)).alias("most"))


def image_paths(spark, sf_dir):
    """Paths with the suffix of an image, whatever its case."""
    suffix = F.element_at(F.array(*map(F.lit, ("jpg", "JPEG", "png", "webp", "txt"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    path = F.when(F.col("p_partkey") % 23 == 0, "png").otherwise(F.concat(F.lit("dir.x/"), F.col("p_partkey").cast("string"), F.lit("."), suffix))
    return _read(spark, sf_dir, "part").select("p_partkey", path.alias("path")).where(has_suffix(F.col("path")))


def sorted_manifest(spark, sf_dir):
    """All part names in byte order with their digests, by a sort in ranges."""
    return _read(spark, sf_dir, "part").select("p_name", "p_partkey", F.sha1(F.col("p_name").cast("binary")).alias("sha")).orderBy("p_name", "p_partkey")


def first_path(spark, sf_dir):
    """The first page path in byte order of each host."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    return _read(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.min("url").alias("first"), F.count("*").alias("pages"))


def curve_points(spark, sf_dir):
    """Each image's points in order of size, as the points of a curve."""
    e = _read(spark, sf_dir, "events").where("event_id % 2 = 0").select("user_id", F.struct((F.lit(1000) + F.col("event_id") * 7919 % 50021).alias("bytes"), "event_id").alias("p"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["bytes"].cast("string")), " ")
    return e.groupBy("user_id").agg(line.alias("points"))


def nonzero_outliers(spark, sf_dir):
    """The ten orders with most lines' worth of numbers; ties by key."""
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("nonzero"), F.max("l_partkey").alias("abs_max"))
    return rows.orderBy(F.desc("nonzero"), "l_orderkey").limit(10)


def xorshift(spark, sf_dir):
    """Five steps of the 32-bit xorshift generator from 200 seeds."""
    def step(x, _):
        x = x.bitwiseXOR(F.shiftleft(x, 13)).bitwiseAND(0xFFFFFFFF)
        x = x.bitwiseXOR(F.shiftright(x, 17))
        return x.bitwiseXOR(F.shiftleft(x, 5)).bitwiseAND(0xFFFFFFFF)

    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("seed"), F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.col("p_partkey"), step).alias("state"))


def filter_levels(spark, sf_dir):
    """Filter level and limits by segment and deltas; whether inner edges are filtered; level zero filters nothing."""
    n = F.col("p_partkey").cast("long")
    segment = F.when(n % 3 != 0, n % 150 - 75)
    reference, mode = F.when(n % 4 != 0, n % 21 - 10), F.when((n % 4 != 0) & (n % 5 == 4), F.lit(-6))
    level = H.filter_level(n % 64, segment, n % 2 == 1, reference, mode)
    rows = _read(spark, sf_dir, "part").select("p_partkey", level.alias("level"), (n % 8).alias("sharpness"), ((n % 5 == 4) | (n % 6 < 3)).alias("inner")).where("level > 0")
    interior, variance = H.filter_limits(F.col("level"), F.col("sharpness"))
    return rows.select(
        "p_partkey", "level", interior.alias("interior"), variance.alias("variance"), ((F.col("level") + 2) * 2 + interior).alias("outer_limit"),
        F.when(F.col("inner"), F.col("level") * 2 + interior).alias("inner_limit"),
    )


def edge_kinds(spark, sf_dir):
    """What the normal loop filter does along the middle of each block's lines."""
    from lumenweave.operators.blocks import block_frame

    rows = block_frame(_read(spark, sf_dir, "embeddings")).select((F.col("label") % 4).alias("segment"), "p", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"))
    kind = H.edge_kind([F.get("p", F.col("y") * 8 + i) for i in range(8)], F.lit(60), F.lit(90), F.lit(40))
    return rows.groupBy("segment", kind.alias("kind")).agg(F.count("*").alias("edges"))


def macroblock_lookup(spark, sf_dir):
    """Macroblocks by index, with an error for an index that the frame doesn't have."""
    frames = _read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 12).alias("asked"))
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).cast("long").alias("mb"), "l_partkey")
    found = frames.join(lines, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("asked") == F.col("mb")), "left")
    return found.select("o_orderkey", "asked", F.col("l_partkey").alias("value"), F.when(F.col("l_partkey").isNull(), "range").alias("error"))


def step_lookup(spark, sf_dir):
    """Steps by index, from a table of 128 rows that is joined; a table of fixed size is broadcast."""
    from lumenweave.functions.tables import AC_STEPS, DC_STEPS

    steps = F.array(*(F.struct(F.lit(i).cast("long").alias("q"), F.lit(dc).cast("long").alias("dc"), F.lit(ac).cast("long").alias("ac")) for i, (dc, ac) in enumerate(zip(DC_STEPS, AC_STEPS, strict=True))))
    table = spark.range(1).select(F.explode(steps).alias("s")).select("s.*")
    rows = _read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 128).alias("q"))
    return rows.join(F.broadcast(table), "q").groupBy("q").agg(F.count("*").alias("blocks"), F.sum("dc").alias("dc"), F.sum("ac").alias("ac"))


_ALL = (
    binary_scan, png_chunk, samples_8bit, token_extra, bool_cost, scaled_steps, axis_ticks, number_texts, mode_names, option_parse, text_escapes, csv_lines, csv_points, manifest_lines, report_lines,
    header_gates, header_compare, byte_equal, finite_points, image_paths, sorted_manifest, first_path, curve_points, nonzero_outliers, xorshift, filter_levels, edge_kinds, macroblock_lookup, step_lookup,
)
QUERIES = {f.__name__: f for f in _ALL}

_H = """n AS (SELECT p_partkey, p_size, CAST(p_partkey AS BIGINT) AS n FROM part),
h AS (SELECT p_partkey, p_size, n, n % 4 AS profile, n % 9 * 100 AS width, n % 13 * 50 AS height,
 CASE WHEN n % 5 = 0 THEN 'not a key frame' WHEN n % 11 = 0 THEN 'start code' WHEN n % 9 = 0 OR n % 13 = 0 THEN 'size' END AS error FROM n)"""
_LOG2 = "CAST(floor(log2({0})) AS BIGINT)"
_CLIP63 = "least(63, greatest(0, {0}))"


def _steps_sql() -> str:
    from lumenweave.functions.tables import AC_STEPS, DC_STEPS

    return f"SELECT l_partkey % 128 AS q, count(*) AS blocks, CAST(sum({DC_STEPS}[l_partkey % 128 + 1]) AS BIGINT) AS dc, CAST(sum({AC_STEPS}[l_partkey % 128 + 1]) AS BIGINT) AS ac FROM lineitem GROUP BY 1"


SQL = {
    "png_chunk": """WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1,
 3988292384) ELSE c >> 1 END)) AS t),
 b AS (SELECT p_partkey, list_transform(string_split('tEXt' || p_name, ''), lambda c: CAST(ord(c) AS BIGINT)) AS b FROM part),
 c AS (SELECT p_partkey, b, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS crc FROM b, t)
 SELECT p_partkey, crc, printf('%08x', len(b) - 4) || array_to_string(list_transform(b, lambda x: printf('%02x', x)), '') || printf('%08x', crc) AS chunk FROM c""",
    "samples_8bit": """SELECT l_orderkey, l_linenumber, ((l_partkey * 7919) % 65536) >> 8 AS r, ((l_partkey * 7919) % 65536) >> 8 AS g, ((l_partkey * 7919) % 65536) >> 8
 AS b, ((l_suppkey * 104729) % 65536) >> 8 AS a FROM lineitem""",
    "token_extra": """WITH s AS (SELECT l_orderkey, l_linenumber, least(2114, abs(l_partkey * l_linenumber - 5000) % 4000) AS size FROM lineitem),
 t AS (SELECT *, CASE WHEN size <= 4 THEN size WHEN size <= 6 THEN 5 WHEN size <= 10 THEN 6 WHEN size <= 18 THEN 7 WHEN size <= 34 THEN 8 WHEN size <= 66 THEN 9 ELSE 10 END AS token FROM s)
 SELECT l_orderkey, l_linenumber, size, token, CASE token WHEN 10 THEN 11 ELSE greatest(0, token - 4) END AS bits, size - CASE token WHEN 5 THEN 5 WHEN 6 THEN 7 WHEN 7
 THEN 11 WHEN 8 THEN 19 WHEN 9 THEN 35 WHEN 10 THEN 67 ELSE token END AS extra FROM t""",
    "bool_cost": f"""WITH r AS (SELECT p_partkey, p, bit, CASE bit WHEN 0 THEN p ELSE 256 - p END AS x FROM (SELECT p_partkey, p_partkey % 255 + 1 AS p FROM part), (SELECT unnest([0, 1]) AS bit)),
 l AS (SELECT p_partkey, p, bit, 2048 - ({_LOG2.format('x')} * 256 + (x - (1 << {_LOG2.format('x')})) * 256 // (1 << {_LOG2.format('x')})) AS cost FROM r)
 SELECT p_partkey, p, bit, cost, (cost * 8) >> 11 AS token_rate, (cost * 8 // 256 + 7) // 8 AS mode_rate FROM l""",
    "scaled_steps": """SELECT p_partkey, step, CAST(percent AS BIGINT) AS percent, least(2047, greatest(1, (step * CASE percent WHEN 0 THEN 100 ELSE percent END + 50) // 100)) AS
 scaled FROM (SELECT p_partkey, p_partkey % 159 + 1 AS step FROM part), (SELECT unnest([0, 1, 60, 100, 115, 130, 2000]) AS percent)""",
    "axis_ticks": """WITH m AS (SELECT user_id, min(value) AS low, max(value) AS high FROM events GROUP BY 1),
 t AS (SELECT *, low + i * (high - low) / 5 AS tick FROM m, (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS i))
 SELECT user_id, i, round(tick, 4) AS at, round(CASE WHEN high = low THEN 300.0 ELSE (tick - low + (high - low) * 0.03) / ((high - low) + (high - low) * 0.03 * 2) * 600 END, 3) AS x FROM t""",
    "number_texts": """WITH v AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * p_partkey / 8 AS v FROM part)
 SELECT p_partkey, 'psnr_rgb=' || CASE WHEN p_partkey % 10 = 0 THEN 'inf' ELSE printf('%.6f', v) END AS six,
 CASE WHEN v >= 100 THEN CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) WHEN v >= 10 THEN printf('%d.%d', CAST(floor(v * 10 + 0.5) AS BIGINT) // 10, CAST(floor(v * 10 +
 0.5) AS BIGINT) % 10) ELSE printf('%.3f', v) END AS short FROM v""",
    "mode_names": """SELECT p_partkey, coalesce(['DC_PRED', 'V_PRED', 'H_PRED', 'TM_PRED', 'B_PRED'][p_partkey % 7 + 1], CAST(p_partkey % 7 AS VARCHAR)) AS name,
 coalesce([0, 2, 3, 1][p_partkey % 7 + 1], 0) AS bmode FROM part""",
    "option_parse": """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 OR p_partkey % 11 = 0 THEN NULL ELSE p_partkey - 100 END AS number,
 ['bpred', 'bpred-rdo', 'bpred-rdo', 'i16', 'i16', 'dc', 'dc'][p_partkey % 9 + 1] AS mode FROM part)
 SELECT p_partkey, CAST(number AS BIGINT) AS number, mode FROM r""",
    "text_escapes": """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
 SELECT doc_id, '"' || replace(t, '"', '""') || '"' AS csv, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM t""",
    "csv_lines": """SELECT user_id, '"file ' || user_id || '.webp",' || CASE WHEN min(event_id) % 5 = 0 THEN 'ERR' ELSE CAST(CAST(floor(min(value) * 1000) AS BIGINT) AS VARCHAR) END AS line FROM events GROUP BY 1""",
    "csv_points": """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 5 = 1 THEN 'a "b", ' || event_type ELSE event_type END AS kind, CAST(round(value, 2) AS DECIMAL(20, 2)) AS v, event_id % 17 = 3 AS no_number,
  event_id % 19 = 4 AS few, event_id % 23 = 5 AS many FROM events),
 l AS (SELECT *, CASE WHEN few THEN '"' || event_id || '","' || user_id || '"' ELSE '"' || event_id || '","' || user_id || '","' || replace(kind, '"', '""') || '","' || CASE WHEN no_number THEN 'x1y' ELSE CAST(v AS VARCHAR) END || '"' || CASE WHEN many THEN ',7' ELSE '' END END AS line FROM e)
 SELECT event_id, CASE WHEN good THEN event_id END AS id, CASE WHEN good THEN user_id END AS user, CASE WHEN good THEN kind END AS kind, CASE WHEN good THEN CAST(v AS DOUBLE) END AS value, CASE WHEN NOT good THEN line END AS bad
 FROM (SELECT *, NOT (few OR many OR no_number) AS good FROM l)""",
    "manifest_lines": """SELECT p_partkey, CASE WHEN good THEN 'dir/' || p_partkey || '.png' END AS path, CASE WHEN good THEN CAST(p_partkey % 101 AS INTEGER) END AS q,
 CASE WHEN good THEN sha256(p_name) END AS sha,
 CASE WHEN p_partkey % 11 = 0 THEN 'form' WHEN p_partkey % 7 = 0 THEN 'quality' END AS error FROM (SELECT *, p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AS good FROM part WHERE p_partkey % 13 <> 0)""",
    "report_lines": f"""WITH {_H} SELECT p_partkey, CASE WHEN error IS NOT NULL THEN 'error: ' || error ELSE 'Dimensions: ' || width || 'x' || height || chr(10) ||
 'Profile: ' || profile END AS report FROM h""",
    "header_gates": f"WITH {_H} SELECT coalesce(error, CASE WHEN n % 4 <> 0 THEN 'partitions' END, 'none') AS error, count(*) AS files FROM h GROUP BY 1",
    "header_compare": f"""WITH {_H}, c AS (SELECT p_size > 3 AS there, n, height, CASE WHEN n % 5 = 0 THEN 'not a key frame' WHEN n % 11 = 0 THEN 'start code' END AS e, error FROM h)
 SELECT there AS width, there AND n % 17 <> 0 AS height, CASE WHEN there THEN e IS NOT DISTINCT FROM error ELSE error IS NULL END AS error, count(*) AS files FROM c GROUP BY ALL""",
    "byte_equal": "SELECT coalesce(html, '') = coalesce(rtrim(html, ' '), '') AS equal, count(*) AS pages FROM pages GROUP BY 1",
    "finite_points": """SELECT user_id, count(*) FILTER (event_id % 10 <> 0 AND event_id % 17 <> 0) AS finite, count(*) FILTER (event_id % 10 = 0 OR event_id % 17 = 0)
 AS other, max(value) FILTER (event_id % 10 <> 0 AND event_id % 17 <> 0) AS most FROM events GROUP BY 1""",
    "image_paths": "SELECT p_partkey, 'dir.x/' || p_partkey || '.' || ['jpg', 'JPEG', 'png'][p_partkey % 5 + 1] AS path FROM part WHERE p_partkey % 5 < 3 AND p_partkey % 23 <> 0",
    "sorted_manifest": "SELECT p_name, p_partkey, sha1(p_name) AS sha FROM part ORDER BY p_name, p_partkey",
    "first_path": "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, min(url) AS first, count(*) AS pages FROM pages GROUP BY 1",
    "curve_points": """SELECT user_id, string_agg(CAST(1000 + event_id * 7919 % 50021 AS VARCHAR), ' ' ORDER BY 1000 + event_id * 7919 % 50021, event_id) AS points FROM
 events WHERE event_id % 2 = 0 GROUP BY 1""",
    "nonzero_outliers": "SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS nonzero, max(l_partkey) AS abs_max FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "xorshift": """WITH RECURSIVE s(seed, i, state) AS (SELECT seed, 0, seed FROM (SELECT p_partkey AS seed FROM part) UNION ALL
 SELECT seed, i + 1, xor(b, (b << 5) & 4294967295) FROM (SELECT seed, i, xor(a, a >> 17) AS b FROM (SELECT seed, i, xor(state, (state << 13) & 4294967295) AS a FROM s WHERE i < 5)))
 SELECT seed, state FROM s WHERE i = 5""",
    "filter_levels": f"""WITH n AS (SELECT p_partkey, CAST(p_partkey AS BIGINT) AS n FROM part),
 b AS (SELECT *, {_CLIP63.format('CASE WHEN n % 3 = 0 THEN n % 64 WHEN n % 2 = 1 THEN n % 150 - 75 ELSE n % 64 + n % 150 - 75 END')} AS b FROM n),
 l AS (SELECT *, CASE WHEN n % 4 = 0 THEN b ELSE {_CLIP63.format('b + n % 21 - 10 - CASE WHEN n % 5 = 4 THEN 6 ELSE 0 END')} END AS level, n % 8 AS sh FROM b),
 i AS (SELECT *, greatest(1, CASE WHEN sh = 0 THEN level ELSE least(9 - sh, level >> CASE WHEN sh > 4 THEN 2 ELSE 1 END) END) AS interior FROM l WHERE level > 0)
 SELECT p_partkey, level, interior, CAST((level >= 15)::INT + (level >= 40)::INT AS INTEGER) AS variance, (level + 2) * 2 + interior AS outer_limit, CASE WHEN n % 5 = 4
 OR n % 6 < 3 THEN level * 2 + interior END AS inner_limit FROM i""",
    "edge_kinds": f"""WITH {_PX}, e AS (SELECT label % 4 AS segment, list_slice(p, y * 8 + 1, y * 8 + 8) AS e FROM px, (SELECT unnest(range(0, 8)) AS y)),
 d AS (SELECT segment, list_transform(range(1, 8), lambda i: abs(e[i] - e[i + 1])) AS d, abs(e[3] - e[6]) AS outer_ FROM e),
 k AS (SELECT segment, CASE WHEN d[4] * 2 + (outer_ >> 1) > 210 OR greatest(d[1], d[2], d[3], d[5], d[6], d[7]) > 90 THEN 'skip' WHEN greatest(d[3], d[5]) > 40 THEN
 'sharp' ELSE 'smooth' END AS kind FROM d)
 SELECT segment, kind, count(*) AS edges FROM k GROUP BY ALL""",
    "macroblock_lookup": """SELECT o_orderkey, o_custkey % 12 AS asked, l_partkey AS value, CASE WHEN l_partkey IS NULL THEN 'range' END AS error FROM orders LEFT JOIN
 lineitem ON o_orderkey = l_orderkey AND l_linenumber - 1 = o_custkey % 12""",
    "step_lookup": _steps_sql(),
}

"""SQL of the queries that SQL can express, over the driver's tables."""

from __future__ import annotations

from lumenweave.llm.common import LOWER, UPPER
from lumenweave.llm.license_scan import BASE, SHARE, TEMPLATES, numbered
from lumenweave.llm.quality_rules import QUANTILES, RULES
from lumenweave.llm.sharding import KEY, round_keys

_BITS = "(strpos('0123456789abcdef', substr(h, 5 * (i // 4) + {0}, 1)) - 1)"
_FIVE = f"(({_BITS.format(1)} << 16) + ({_BITS.format(2)} << 12) + ({_BITS.format(3)} << 8) + ({_BITS.format(4)} << 4) + {_BITS.format(5)})"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_NONE = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

#: CRC-32 of ASCII text, as a table of 256 rows and a fold over characters.
_CRC_TABLE = "crc_table AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_CRC = "xor(list_reduce([4294967295] || list_transform(string_split({0}, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295)"
_CUTS = ", ".join(f"list_sort(list({r}))[CAST(greatest(1, ceil(p * count(*))) AS BIGINT)] AS cut_{r}" for r in RULES)
_FIRED = " OR ".join(f"coalesce({r} > cut_{r}, false)" for r in RULES)
_SHARE = "count(*) FILTER ({1} AND {0} > cut_{0}) / greatest(1, count(*) FILTER ({1}))"
_KEPT = ", ".join(f"CASE WHEN {_SHARE.format(r, 'NOT good')} - 5 * {_SHARE.format(r, 'good')} > 0 THEN cut_{r} END AS cut_{r}" for r in RULES)
_CUT_NAMES = ", ".join(f"cut_{r}" for r in RULES)

#: A Feistel network on a state of two halves of 40 bits at most, packed into one number; ``list_reduce`` walks over the round keys.
_WIDE, _TWO40, _TWO64 = "CAST({0} AS UHUGEINT)", 1 << 40, 1 << 64
_MIX = "xor(s % {0}, k)".format(_WIDE.format(_TWO40))
for _factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 1):
    _MIX = f"((xor({_MIX}, {_MIX} // {_WIDE.format(1 << 33)}) * {_WIDE.format(_factor)}) % {_WIDE.format(_TWO64)})"
_KEYS = "[" + ", ".join(_WIDE.format(k) for k in round_keys(KEY)) + "]"
_FEISTEL = f"list_reduce([({{0}} // wide) * {_WIDE.format(_TWO40)} + {{0}} % wide] || {_KEYS}, lambda s, k: (s % {_WIDE.format(_TWO40)}) * {_WIDE.format(_TWO40)} + xor(s // {_WIDE.format(_TWO40)}, {_MIX} % wide))"
_NEXT = f"(({_FEISTEL}) // {_WIDE.format(_TWO40)}) * wide + ({_FEISTEL}) % {_WIDE.format(_TWO40)}"
_BYTE = "(strpos('0123456789ABCDEF', c[1]) - 1) * 16 + strpos('0123456789ABCDEF', c[2]) - 1"

#: What splits into terms (op11), and the licence templates (op13) as rows.
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_LICENCES = ", ".join(f"({i}, '{label}', {base}, {k}, {drift}, {len(words)}, {words})" for i, label, base, k, drift, words in numbered(BASE, TEMPLATES))


def _codebook_round(i: int) -> str:
    """Assignments a{i} to the entries of c{i}, and from them the entries of c{i + 1}."""
    return f"""a{i} AS (SELECT r, p, arg_min(e, away * 64 + e) AS e, min(away) AS away FROM (SELECT r, px.p, e, list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS away
  FROM px JOIN c{i} ON c{i}.p = px.p) GROUP BY r, p),
 m{i} AS (SELECT p, e, list(CAST(floor(t / n) AS BIGINT) ORDER BY k) AS c FROM (SELECT px.p, e, k, sum(s[k]) AS t, count(*) AS n FROM a{i} JOIN px ON px.r = a{i}.r AND px.p = a{i}.p, wid, unnest(range(1, d + 1)) u(k) GROUP BY ALL) GROUP BY p, e),
 c{i + 1} AS (SELECT c{i}.p, c{i}.e, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON m{i}.p = c{i}.p AND m{i}.e = c{i}.e)"""


SQL = {
    "op11_block_max": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents), p AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
 g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM p),
 i AS (SELECT q, item_id, unnest(list_distinct(w)) AS t FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark)),
 tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS t FROM p) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
 df AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY t),
 s AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + 90 * n * docs // terms)))) AS BIGINT) AS score FROM i JOIN tf ON tf.t = i.t JOIN df ON df.t = i.t, g GROUP BY ALL)
 SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op12_vector_codes": f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(greatest(-67108864, least(67108864, floor(CAST(x AS DOUBLE) * 256))) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 x AS (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, * FROM k), wid AS (SELECT len(v) // 16 AS d FROM x WHERE r = 1),
 px AS (SELECT r, p, v[p * d + 1:(p + 1) * d] AS s FROM x, wid, unnest(range(0, 16)) u(p)), c0 AS (SELECT p, r - 1 AS e, s AS c FROM px WHERE r <= 64),
 {_codebook_round(0)}, {_codebook_round(1)}, {_codebook_round(2)},
 book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS sha FROM c2),
 one AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(away) AS BIGINT) AS error FROM a2 JOIN x ON x.r = a2.r GROUP BY x.r, vec_id, label)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM one, book""",
    "op13_license_scan": f"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), licences AS (SELECT * FROM (VALUES {_LICENCES}) v(template, label, base, k, drift, size, words)),
 tg AS (SELECT template, k, i, array_to_string(words[i + 1:i + k], ' ') AS g FROM (SELECT template, k, words, unnest(range(0, size - k + 1)) AS i FROM licences)),
 dg AS (SELECT r, k, place, array_to_string(w[place + 1:place + k], ' ') AS g FROM (SELECT r, k, w, unnest(range(0, greatest(0, len(w) - k + 1))) AS place FROM texts, (SELECT DISTINCT k FROM licences))),
 hits AS (SELECT r, template, k, place - i AS diagonal, place FROM dg JOIN tg USING (k, g)),
 beside AS (SELECT *, least(k, coalesce(lead(place) OVER (PARTITION BY r, template, diagonal ORDER BY place) - place, k)) AS c FROM hits),
 dia AS (SELECT r, template, diagonal, sum(c) AS covered, min(place) AS start, max(place) + any_value(k) AS stop FROM beside GROUP BY ALL),
 cut AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > drift, true) AS apart FROM dia JOIN licences USING (template)),
 runs AS (SELECT *, sum(CAST(apart AS INT)) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM cut),
 merged AS (SELECT r, label, base, k, min(start) AS start, least(1.0, sum(covered) / greatest(size, max(stop) - min(start))) AS share FROM runs GROUP BY r, template, label, base, k, size, span),
 told AS (SELECT *, share >= CASE WHEN k > 2 THEN {SHARE} ELSE 1.0 END AS verified FROM merged),
 f AS (SELECT r, count(*) FILTER (base AND verified) AS n_base, min(start) FILTER (base AND verified) AS first_word, max(start) FILTER (base AND verified) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND verified) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS labels, max(share) AS score FROM told GROUP BY r)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0.0) AS DOUBLE) AS score
 FROM texts LEFT JOIN f ON f.r = texts.r""",
    "op4_sharding": f"""WITH RECURSIVE {_CRC_TABLE},
 d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size,
  xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda c: {_BYTE}), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32 FROM documents, crc_table),
 n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number FROM d),
 m AS (SELECT count(*) AS rows, CAST(greatest(1, (CASE WHEN count(*) > 1 THEN length(bin(count(*) - 1)) ELSE 0 END + 1) // 2) AS INTEGER) AS half FROM documents),
 o AS (SELECT *, CAST(1 << half AS UHUGEINT) AS wide FROM m),
 walk AS (SELECT row_number AS number, {_NEXT.format('CAST(row_number AS UHUGEINT)')} AS p FROM n, o UNION ALL SELECT number, {_NEXT.format('p')} FROM walk, o WHERE p >= rows)
 SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % 40 AS INTEGER) AS shard, CAST(p // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, row_number FROM n JOIN walk ON number = row_number, o WHERE p < rows""",
    # the tail of the binomial is summed term by term from logarithms of factorials
    "op2_quality_rules": f"""WITH {_CRC_TABLE},
 w AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 l AS (SELECT *, array_to_string(w, '') AS bare, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM w),
 win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 1))) AS i FROM w)),
 twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
 rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS at FROM twice) GROUP BY 1),
 c AS (SELECT l.doc_id, stratum, len(w) AS n_words, length(bare) AS word_chars, length(bare) - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(bare) - length(regexp_replace(bare, '[A-Z]', '', 'g')) AS n_capitals FROM l LEFT JOIN rep ON rep.doc_id = l.doc_id),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {', '.join(f'CAST({e} AS DOUBLE) AS {r}' for r, e in RULES.items())} FROM c),
 q AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
 marked AS (SELECT b.*, good, {_CRC.format('CAST(b.doc_id AS VARCHAR)')} % 2 = 1 AS holdout FROM b JOIN q ON q.doc_id = b.doc_id, crc_table WHERE NOT base_failed),
 levels AS (SELECT * FROM (VALUES {', '.join(f'({i}, {p})' for i, p in enumerate(QUANTILES))}) v(level, p)),
 cuts AS (SELECT stratum, level, {_CUTS} FROM marked, levels WHERE good AND NOT holdout GROUP BY stratum, level, p),
 cand AS (SELECT stratum, level, {_KEPT} FROM marked JOIN cuts USING (stratum) WHERE NOT holdout GROUP BY stratum, level, {_CUT_NAMES}),
 tested AS (SELECT stratum, level, {_CUT_NAMES}, count(*) FILTER (good) AS n, count(*) FILTER (good AND ({_FIRED})) AS k,
  count(*) FILTER (NOT good AND ({_FIRED})) / greatest(1, count(*) FILTER (NOT good)) - 5 * count(*) FILTER (good AND ({_FIRED})) / greatest(1, count(*) FILTER (good)) AS useful
  FROM marked JOIN cand USING (stratum) WHERE holdout GROUP BY stratum, level, {_CUT_NAMES}),
 tails AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.02) + (n - j) * ln(0.98)))) AS tail FROM tested WHERE n > 0),
 best AS (SELECT * FROM tails WHERE tail <= 0.05 / (SELECT count(*) FROM tested) AND useful > 0 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY useful DESC, level DESC) = 1)
 SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND NOT ({_FIRED}) AS kept, b.stratum, CAST(level AS INTEGER) AS certified_level FROM b LEFT JOIN best ON best.stratum = b.stratum""",
    # five hexadecimal digits are four letters of base 32
    "op1_warc": f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS h FROM pages),
 d AS (SELECT page_id, bytes, h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_FIVE} >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
 SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op3_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
 iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
 dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, greatest(1, len(w) - n + 2))) AS k FROM d, (SELECT DISTINCT n FROM i))),
 hit AS (SELECT doc_id, item_id, n, k FROM dw JOIN iw USING (n, g)),
 words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS at FROM hit) GROUP BY 1),
 items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS sha FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, '{_NONE}') AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
 FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
    # place k is that of byte k, from 0
    "op7_suffix_dedup": """WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
 w AS (SELECT doc_id, k, md5(array_slice(b, k + 1, k + 100)) AS g FROM (SELECT doc_id, b, unnest(range(0, greatest(0, n - 99))) AS k FROM t)),
 r AS (SELECT doc_id, k FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, k) > 1),
 g AS (SELECT doc_id, k, coalesce(k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) > 100, true) AS new FROM r),
 s AS (SELECT doc_id, k, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM g),
 c AS (SELECT doc_id, min(k) AS a, max(k) + 100 AS b FROM s GROUP BY doc_id, span),
 kept AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM c UNION ALL SELECT doc_id, -1, 0 FROM t)),
 text AS (SELECT t.doc_id, sha256(unhex(string_agg(CASE WHEN kept.a < coalesce(kept.b, n) THEN hex(array_slice(t.b, kept.a + 1, coalesce(kept.b, n))) ELSE '' END, '' ORDER BY kept.a))) AS sha FROM kept JOIN t ON t.doc_id = kept.doc_id GROUP BY 1),
 cut AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM c GROUP BY 1)
 SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha AS kept_sha256 FROM t JOIN text ON text.doc_id = t.doc_id LEFT JOIN cut ON cut.doc_id = t.doc_id""",
}

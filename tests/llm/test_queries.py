"""The registered queries over the smallest tables, against plain versions and SQL."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from lumenweave.llm import queries, quality_rules
from tests.llm import brute
from tests.llm.test_near_copies import smallest
from tests.test_oracles import TABLES, plain

QUERIES = queries.queries()


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "labels", "benchmark")}


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def rows_of(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = {r.doc_id: r for r in df.collect()}
    return rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df, want = QUERIES[name](spark, sf_dir), con.execute(queries.oracle_sql()[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), [d[0] for d in want.description])


def verdicts(docs, labels):
    """Doc ids that pass the rules certified on these tables, by plain counting."""
    quality, counts = {}, {}
    for r in labels:
        if r.quality is not None:
            quality[r.doc_id] = min(r.quality, quality.get(r.doc_id, 1))
    for r in docs:
        n_words, chars, symbols, dup, repeat = brute.quality_counts(r.text)
        lines = sum(bool(x.strip(" \t\n\x0b\f\r")) for x in (r.text or "").split("\n"))
        capitals = sum("A" <= c <= "Z" for c in r.text or "")
        base = n_words < 50 or 100 * repeat > 50 * n_words
        shares = (symbols / max(chars, 1), capitals / max(chars, 1), dup / max(lines, 1), repeat / max(n_words, 1), chars / max(n_words, 1))
        counts[r.doc_id] = r.lang, base, shares
    tested = []
    for lang in {c[0] for c in counts.values()}:
        own = {d: c[2] for d, c in counts.items() if c[0] == lang and not c[1] and d in quality}
        design, holdout = ([(s, quality[d]) for d, s in own.items() if crc(d) % 2 == half] for half in (0, 1))
        good = [s for s, q in design if q]
        share = lambda rows, fired, q: sum(fired(s) for s, x in rows if x == q) / max(1, sum(x == q for _, x in rows))
        for level, p in enumerate(quality_rules.QUANTILES if good else ()):
            cuts = [sorted(s[i] for s in good)[max(0, math.ceil(p * len(good)) - 1)] for i in range(5)]
            cuts = [c if share(design, lambda s, i=i, c=c: s[i] > c, 0) - 5 * share(design, lambda s, i=i, c=c: s[i] > c, 1) > 0 else math.inf for i, c in enumerate(cuts)]
            fired = lambda s, cuts=cuts: any(x > c for x, c in zip(s, cuts, strict=True))
            if holdout:
                useful = share(holdout, fired, 0) - 5 * share(holdout, fired, 1)
                tested.append((lang, level, cuts, sum(q for _, q in holdout), sum(fired(s) for s, q in holdout if q), useful))
    best = {}
    for lang, level, cuts, n, k, useful in tested:
        tail = sum(math.comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1))
        if n and tail <= 0.05 / len(tested) and useful > 0 and (useful, level) > best.get(lang, (-1, -1, None))[:2]:
            best[lang] = useful, level, cuts
    return {d for d, (lang, base, shares) in counts.items() if not base and not (lang in best and any(x > c for x, c in zip(shares, best[lang][2], strict=True)))}


def test_quality_verdicts(spark, tmp_path, sf_dir, tables):
    got = rows_of(spark, sf_dir, "op2_quality_rules")
    for r in tables["documents"]:
        n_words, *rest = brute.quality_counts(r.text)
        own = got[r.doc_id]
        assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words) == (n_words, *rest)
        assert own.base_failed == (n_words < 50 or 100 * rest[-1] > 50 * n_words)
    assert {d for d, r in got.items() if r.kept} == verdicts(tables["documents"], tables["labels"])
    # as many labels as it takes to certify something
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"{'w' if i % 5 else '%%'}{x}" for x in rng.integers(10**6, size=60 + i % 9)), "en" if i % 3 else None) for i in range(4000)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(4000)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    from types import SimpleNamespace as Row

    want = verdicts([Row(doc_id=d, text=t, lang=x) for d, t, x in docs], [Row(doc_id=i, quality=int(i % 5 > 0)) for i in range(4000)])
    assert 3000 < len(want) < 3400 and {d for d, r in rows_of(spark, str(tmp_path), "op2_quality_rules").items() if r.kept} == want


def test_shards(spark, sf_dir, tables):
    got = rows_of(spark, sf_dir, "op4_sharding")
    for r in tables["documents"]:
        raw = (r.text or "").encode()
        assert (got[r.doc_id].size, got[r.doc_id].text_crc32, got[r.doc_id].law, got[r.doc_id].grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    per = Counter(r.shard for r in got.values())
    assert len(got) == len(tables["documents"]) and set(per) == set(range(40)) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in got.values() if r.shard == s) == list(range(n)) for s, n in per.items())


def test_class_scores(spark, sf_dir, tables):
    got = rows_of(spark, sf_dir, "op5_class_lm")
    cut = {r.doc_id: [*brute.lower(r.text).encode().split(), b"\n"] for r in tables["documents"]}
    counts = Counter(w for d, own in cut.items() if crc(d) % 7 != 2 for w in own)
    total = sum(counts.values())
    for d, own in cut.items():
        r = got[d]
        assert r.held_out == (crc(d) % 7 == 2) and r.n_tokens == len(own) and r.n_known == sum(counts[w] > 0 for w in own) and r.train_tokens == total
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_quality_scores(spark):
    sf_dir = "/root/testdata/sf0.01"  # 200 documents hold too few bad ones to learn from
    got, labels = rows_of(spark, sf_dir, "op6_pu_classifier"), spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (crc(d) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    marked = [(got[r.doc_id].score, r.quality) for r in labels if r.doc_id in got and got[r.doc_id].held_out and r.quality is not None]
    good, bad = [s for s, q in marked if q], [s for s, q in marked if not q]
    assert len(good) > 30 and len(bad) > 5 and np.mean([a > b for a in good for b in bad]) > 0.9


def test_removed_bytes(spark, sf_dir, tables):
    got = sorted(tuple(r) for r in QUERIES["op7_suffix_dedup"](spark, sf_dir).collect())
    assert got == sorted(brute.repeats([(r.doc_id, r.text) for r in tables["documents"]]))


def test_fingerprints(spark, sf_dir, tables):
    got, docs = rows_of(spark, sf_dir, "op8_simhash"), sorted(tables["documents"], key=lambda r: r.doc_id)
    prints = [brute.simhash(r.text) for r in docs]
    want = {r.doc_id: (f"{p:016x}", docs[root].doc_id) for r, p, root in zip(docs, prints, brute.components(prints), strict=True)}
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == want


def test_token_ids(spark, sf_dir, tables, library):
    got = rows_of(spark, sf_dir, "op9_byte_bpe")
    for r in tables["documents"]:
        ids = library.encode_ordinary(r.text or "")
        assert tuple(got[r.doc_id])[1:] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode()))


def test_languages(spark, sf_dir, tables):
    got = rows_of(spark, sf_dir, "op10_language_id")
    learned = {r.lang for r in tables["documents"] if crc(r.doc_id) % 3 != 1 and r.lang is not None}
    for r in tables["documents"]:
        own = got[r.doc_id]
        assert own.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= own.score <= 1
        assert own.lang_pred == "und" if not any(map(str.isalpha, r.text or "")) else own.lang_pred in learned
    known = [(got[r.doc_id].lang_pred, r.lang) for r in tables["documents"] if got[r.doc_id].held_out and r.lang is not None and got[r.doc_id].lang_pred != "und"]
    assert np.mean([a == b for a, b in known]) > 0.97


def kept_letters(rows):
    """(doc_id, text) less all letters that lie within passages of an earlier row."""
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0], brute.xxhash64(r[1]))):
        raw = text.encode()
        mark = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                mark[i : i + 100] = 1
            seen.add(raw[i : i + 100])
        at, left = 0, []
        for letter in text:
            size = len(letter.encode())
            if not mark[at : at + size].all():
                left.append(letter)
            at += size
        out.append((d, "".join(left)))
    return out


def test_pipeline_end_to_end(spark, sf_dir, tables, library):
    rows = [(r.doc_id, r.text) for r in tables["documents"] if any(map(str.isalpha, r.text or ""))]
    rows = [(d, t) for (d, t), least in zip(rows, smallest(rows), strict=True) if d == least]
    rows = kept_letters(rows)
    items = [(r.item_id, r.text) for r in tables["benchmark"] if r.text]
    rows = [(d, t) for d, t in rows if not brute.contamination(t, items)[-1]]
    want = {}
    for d, t in rows:
        ids = library.encode_ordinary(t)
        want[d] = len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode())
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["pipeline"](spark, sf_dir).collect()} == want
    assert 100 < len(want) < len(tables["documents"])


def test_hashes_of_the_plain_versions():
    assert brute.xxhash64("") == xxhash.xxh64_intdigest(b"", 42) - (1 << 64)

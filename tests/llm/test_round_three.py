"""Lexical search, vector codes and licence scans against plain versions, with edge cases."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from lumenweave.llm import lexical_search, license_scan, vector_codes
from lumenweave.llm.queries import queries
from tests.llm import brute

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ranked(docs, items, top=10):
    cut = [(d, Counter(re.findall(TERM, brute.lower(t)))) for d, t in docs]
    cut = [(d, c) for d, c in cut if c]
    n, total = len(cut), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in items:
        asked, found = set(re.findall(TERM, brute.lower(text))), []
        for d, c in cut:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score:
                found.append((-score, d is None, d or 0, d))
        found.sort(key=lambda x: x[:3])
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(found[:top])]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_search_equals_all_scores(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    zipf = lambda n: " ".join(words[min(299, int(299 * x**3))] for x in rng.random(n))
    docs = [(i, zipf(int(5 + 60 * rng.random()))) for i in range(1500)]
    docs += [(5000 + i, "Copy of, one-text; W1 w2") for i in range(300)]  # ties beyond the top
    docs += [(None, "w7 w8 w9"), (3, "w7 w8 w9"), (3, "w7 w8 w9"), (6000, None), (6001, ""), (6002, "?! --"), (6003, "w1 ñandú " * 40_000), (6004, "ÉTÉ été\x00w5")]
    items = [(i, zipf(12)) for i in range(20)] + [(90, "copy w1 of"), (91, None), (92, ""), (93, "nothingknown"), (94, "w7 w8 w9"), (94, "w7 w8 w9"), (None, "ñandú ÉTÉ"), (95, "w0 " * 5000)]
    lead = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, query string, score int").repartition(7)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")
    index = lexical_search.built(lead)
    assert rows(lexical_search.search(index, asked)) == sorted(ranked(docs, items), key=str)
    assert index.blocks.count() > 7
    assert rows(lexical_search.search(index, asked, top=3)) == sorted(ranked(docs, items, 3), key=str)
    # many batches find the same
    before, lexical_search.BATCH_BYTES = lexical_search.BATCH_BYTES, 4000
    try:
        assert rows(lexical_search.search(index, asked)) == sorted(ranked(docs, items), key=str)
    finally:
        lexical_search.BATCH_BYTES = before


def test_search_skips_blocks(spark, monkeypatch):
    """Most blocks are left out where one has all of a query's terms, and no document is lost."""
    docs = [(i, f"common w{i % 50} x{i}") for i in range(3200)] + [(9000 + i, "rare find common") for i in range(12)]
    index = lexical_search.built(spark.createDataFrame(docs, "doc_id long, text string").repartition(1))
    batch = lexical_search.Batch(["rare find common"])
    batch.weights[:] = 1000
    held = index.blocks.toArrow().combine_chunks().to_batches()[0]
    bounds = [int(batch.bounds(t, peaks[0])[0]) for _, t, peaks, _ in batch.matched(held)]
    assert sum(b >= sorted(bounds)[-1] // 2 for b in bounds) <= 3 < len(bounds) / 10
    found = lexical_search.search(index, spark.createDataFrame([(1, "rare find common")], "item_id long, text string"))
    assert rows(found) == sorted(ranked(docs, [(1, "rare find common")]), key=str)


def test_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(lexical_search.built(none), items).count() == 0
    assert lexical_search.search(lexical_search.built(some), items.where("false")).count() == 0
    assert lexical_search.search(lexical_search.built(some), items).columns == ["item_id", "rank", "doc_id", "score"]


def compressed(vectors, parts, entries, rounds):
    """(vec_id, code, error, label_error, digest) of each kept row of (vec_id, vector, label)."""
    kept = [(i, label, [max(-(1 << 26), min(1 << 26, math.floor(256 * x))) for x in v]) for i, v, label in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    length = next(len(v) for _, _, v in kept if len(v) and len(v) % parts == 0)
    width = length // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    fits = [(i, label, cut(v)) for i, label, v in kept if len(v) == length]
    books = [[v[p] for _, _, v in fits[:entries]] for p in range(parts)]
    away = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x, p: min(range(len(books[p])), key=lambda e: (away(x, books[p][e]), e))
    for _ in range(rounds):
        held = [[[] for _ in book] for book in books]
        for _, _, v in fits:
            for p in range(parts):
                held[p][nearest(v[p], p)].append(v[p])
        books = [[tuple(sum(x) // len(own) for x in zip(*own, strict=True)) if own else c for c, own in zip(book, held[p], strict=True)] for p, book in enumerate(books)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out = []
    for i, label, v in fits:
        codes = [nearest(v[p], p) for p in range(parts)]
        out.append((i, label, "".join(f"{c:02x}" for c in codes), sum(away(v[p], books[p][c]) for p, c in enumerate(codes))))
    out += [(i, label, None, None) for i, label, v in kept if len(v) != length]
    of_label = Counter()
    for _, label, _, error in out:
        if error is not None:
            of_label[label] += error
    return [(i, code, error, of_label.get(label), digest) for i, label, code, error in out]


def test_codes_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 12)], int(rng.integers(3)) if i % 5 else None) for i in range(200)]
    same = [0.5] * 12
    vectors += [(300 + i, same, 9) for i in range(40)]  # ties
    vectors += [(-5, None, 1), (-4, [None] + same[1:], 1), (-3, [math.nan] * 12, 1), (-2, [math.inf] * 12, 1), (-1, [], 2), (400, [1.0] * 8, 2), (401, [1.0] * 7, 7)]
    vectors += [(1, same, 0), (1, same, 0), (None, [-0.001] * 12, None), (500, [1e30, -1e30] * 6, 4), (501, [300000.0] * 12, 4)]
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in vectors], "vec_id long, embedding array<double>, label int, code string, error int").repartition(5)
    got = rows(vector_codes.compressed(df, parts=3, entries=8, rounds=2))
    assert got == sorted(compressed(vectors, 3, 8, 2), key=str)
    # a plain join of the labels' sums where there are many
    before, vector_codes.FEW_LABELS = vector_codes.FEW_LABELS, 1
    try:
        assert rows(vector_codes.compressed(df, parts=3, entries=8, rounds=2)) == got
    finally:
        vector_codes.FEW_LABELS = before


def test_codes_of_few_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compressed(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r)[:4] for r in vector_codes.compressed(spark.createDataFrame([(1, [0.5] * 5, 1)], kind)).collect()] == [(1, None, None, None)]
    one = vector_codes.compressed(spark.createDataFrame([(7, [0.25] * 16, 1)], kind)).collect()
    assert [tuple(r)[:4] for r in one] == [(7, "00" * 16, 0, 0)]
    with pytest.raises(ValueError):
        vector_codes.fit(vector_codes.whole(spark.createDataFrame([], kind)), entries=300)


def test_restored_vectors_are_near(spark, sf_dir):
    found = vector_codes.whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    books = vector_codes.fit(found)
    back = vector_codes.restored(vector_codes.coded(found, books), books).join(found.select("vec_id", "v"), "vec_id").collect()
    assert len(back) == 500 and all(sum((a - b) ** 2 for a, b in zip(r.restored, r.v, strict=True)) == r.error for r in back)
    start = vector_codes.fit(found, rounds=0)
    assert sum(r.error for r in back) < sum(r.error for r in vector_codes.coded(found, start).collect())


def licences(text, templates):
    """n_words, n_base, first, last, base labels, labels, score of one text."""
    words = [w for w in re.findall(brute.WORD3, brute.lower(text)) if w]
    places, labels, base_labels, score = [], set(), set(), 0.0
    for _, label, base, k, drift, own in templates:
        by_diagonal = {}
        for i in range(len(words) - k + 1):
            for j in range(len(own) - k + 1):
                if words[i : i + k] == own[j : j + k]:
                    by_diagonal.setdefault(i - j, []).append(i)
        runs = []
        for d in sorted(by_diagonal):
            if not runs or d - runs[-1][-1] > drift:
                runs.append([])
            runs[-1].append(d)
        for run in runs:
            covered = sum(len({x for i in by_diagonal[d] for x in range(i, i + k)}) for d in run)
            start, stop = min(by_diagonal[d][0] for d in run), max(by_diagonal[d][-1] + k for d in run)
            share = min(1.0, covered / max(len(own), stop - start))
            score = max(score, share)
            if share >= (0.8 if k > 2 else 1.0):
                labels.add(label)
                if base:
                    base_labels.add(label)
                    places.append(start)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


def test_licences_equal_plain_ones(spark):
    templates = license_scan.numbered(license_scan.BASE, license_scan.TEMPLATES)
    mit, gpl = license_scan.TEMPLATES[13][1], next(t for label, t in license_scan.TEMPLATES if label == "gpl")
    words = mit.split()
    texts = [
        None, "", "?", "one", "CC-BY", "cc by cc BY", "cc by-nc 4.0", "All rights reserved.\n" * 3, "all rights all rights reserved", "general public", "The GNU General Public License, version 3 of it",
        mit, "before it " + mit + " and after. All rights reserved", " ".join(words[:20] + ["and"] + words[20:50] + words[52:]), " ".join(words[: len(words) // 2]), " ".join(w if i % 4 else "x" for i, w in enumerate(words)),
        mit + " " + gpl + " " + mit, "ordinary text with no licence " * 300, "all rights reserved " * 20_000, "Released under the MIT License. Licensed under the Apache License, Version 2.0. Released under the BSD license.",
    ]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, "cc by"), (5, "cc by"), (None, "cc by sa")]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, labels string, uid int").repartition(3)
    assert rows(license_scan.scanned(df)) == sorted(((d, *licences(t, templates)) for d, t in docs), key=str)
    found = {r.doc_id: r.labels.split(",") for r in license_scan.scanned(df.where("doc_id >= 6")).collect()}
    assert "cc-by-nc" in found[6] and "mit" in found[13] and "mit" not in found[14] and {"gpl", "gpl-3.0"} <= set(found[10]) and {"mit", "apache-2.0"} == set(found[19])
    assert license_scan.scanned(df.where("false")).count() == 0
    before, license_scan.MOST_GRAMS = license_scan.MOST_GRAMS, 40  # templates in several parts
    try:
        assert rows(license_scan.scanned(df)) == sorted(((d, *licences(t, templates)) for d, t in docs), key=str)
    finally:
        license_scan.MOST_GRAMS = before
    with pytest.raises(ValueError):
        license_scan.scanned(df, {"word": "x"})


def test_no_python_in_the_licence_scan(spark, sf_dir):
    plan = queries()["op13_license_scan"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)

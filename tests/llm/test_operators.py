"""Each operator against a plain version, over a small table with nulls, empty and long texts, ties, repeated rows and extra columns."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lumenweave.llm import bpe, class_lm, decontaminate, language_id, pu_classifier, quality_rules, queries, sharding, simhash, suffix_dedup, warc
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, d string, spans int"
LONG = " ".join(f"word{i % 997} ünïcode{i * 7 % 1009}" for i in range(9000))
SHARED = "this passage of well over a hundred bytes is shared by several documents and has to go from all of them but the first one. "


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \n\t", "one two three", "ONE Two thrEE", LONG, LONG + " tail", "a" * 5000, SHARED + "first", "before " + SHARED + "after", "x" + SHARED * 2, "ñandú é " * 40, "same line\nsame line\nother", "日本語 テキスト 日本語", "12 34 !!", SHARED + "first"]
    rows = [(i, t, "en" if i % 2 else None, "s", None, 1, "x", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id here", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r))


def test_simhash(docs, empty):
    source = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [brute.simhash(t) for _, t in source]
    roots = brute.components(prints)
    least = {}
    for (doc_id, _), root in zip(source, roots, strict=True):
        if doc_id is not None:
            least[root] = min(doc_id, least.get(root, doc_id))
    want = [(d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(source, prints, roots, strict=True)]
    for cell_rows in (20_000, 2):
        assert rows_of(simhash.near_duplicates(docs, cell_rows=cell_rows)) == sorted(want, key=lambda r: (r[0] is not None, r))
    assert simhash.near_duplicates(empty).count() == 0


def test_suffix_dedup(spark, docs, empty, monkeypatch):
    def key(r):
        return r[0] is not None, r

    source = [(r.doc_id, r.text) for r in docs.collect()]
    passage, other = SHARED + SHARED[:60], " ".join(f"other{i * i}" for i in range(60))
    same_ids = [(5, passage), (7, passage), (7, other), (7, other), (None, other + "!"), *((None, f"{SHARED[i % 50 :]} tail {i} {other[i % 7 : 150 + i % 90]}") for i in range(400))]
    several = spark.createDataFrame(same_ids, "doc_id long, text string").repartition(5)
    for rows, table, settings in ((source, docs, [(20_000, 3000)]), (same_ids, several, [(20_000, 3), (0, 3000)])):
        want = sorted(brute.repeats(rows), key=key)
        for group_rows, block in settings:
            monkeypatch.setattr(suffix_dedup, "INDEX_ROWS", block)
            assert sorted(map(tuple, suffix_dedup.deduplicated(table, 100, group_rows).collect()), key=key) == want
    assert suffix_dedup.deduplicated(empty).count() == 0
    kept = suffix_dedup.with_kept_text(docs)
    assert kept.columns == docs.columns
    kept = {r.doc_id: r for r in kept.where("doc_id <> 3").collect()}
    assert kept[0].text is None and kept[8].text == dict(source)[8] and "shared by several" not in kept[9].text and kept[9].source == "s" and kept[9].spans == 2
    assert suffix_dedup.with_kept_text(empty).count() == 0


def test_repeats_are_told_across_batches():
    rng = np.random.default_rng(8)
    rows = sorted({(int(a), int(c), int(r), int(p)) for a, c, r, p in rng.integers(0, (12, 3, 5, 40), (150, 4))})
    first = {}
    for row in rows:
        first.setdefault(row[:2], row)
    several = {a for a in range(12) if sum(k[0] == a for k in first) > 1}
    want = sorted((r, p, a, 2 if first[a, c] == (a, c, r, p) else 1) for a, c, r, p in rows if first[a, c] != (a, c, r, p) or a in several)
    for size in (1, 2, 7, 1000):
        told, got = suffix_dedup.Told(), []
        for k in range(0, len(rows), size):
            for part in told.next(*np.array(rows[k : k + size]).T):
                got += zip(*(x.tolist() for x in part), strict=True)
        assert sorted(got) == want


def test_spans_that_touch_are_one():
    assert suffix_dedup.merged(np.array([5, 0, 2, 20, 21]), np.array([9, 3, 5, 30, 22])) == [(0, 9), (20, 30)]
    assert suffix_dedup.merged(np.array([]), np.array([])) == []
    one, none = np.array([1, 1, 1, 2]), np.zeros(0, np.int64)
    assert [x.tolist() for x in suffix_dedup._spans(one, np.array([3, 4, 6, 7]), 10)] == [[1, 1, 2], [3, 6, 7], [14, 16, 17]]
    assert [x.tolist() for x in suffix_dedup._spans(none, none, 10)] == [[], [], []]


def test_suffix_index_matches_plain_search():
    rng = np.random.default_rng(5)
    strings = list(dict.fromkeys(bytes(rng.integers(97, 99, rng.integers(64, 140)).astype(np.uint8)) for _ in range(40)))
    strings += [strings[0][3:] + b"zz", strings[1][:70] + b"y"]
    seen, want = {}, []
    for i, s in enumerate(strings):
        windows = {(s[j : j + 64], j) for j in range(len(s) - 63)}
        want += [(i, j) for w, j in windows if seen.get(w, i) < i]
        for w, _ in windows:
            seen.setdefault(w, i)
    string, start = suffix_dedup.RunLengthIndex(strings, 64).repeats(strings)
    assert list(zip(string.tolist(), start.tolist(), strict=True)) == sorted(want)


def test_matching_statistics_of_strings_the_index_lacks():
    rng = np.random.default_rng(9)
    for letters in (2, 4, 200):
        text = bytes(rng.integers(0, letters, 4000).astype(np.uint8))
        strings = list(dict.fromkeys(text[i : i + int(rng.integers(100, 150))] for i in rng.integers(0, 3800, 30)))
        index = suffix_dedup.RunLengthIndex(strings, 70)
        queries = [text[i : i + 160] for i in rng.integers(0, 3800, 40)] + [bytes(rng.integers(0, 256, 120).astype(np.uint8)), strings[0], strings[1][:90] + b"\xff" + strings[2][5:95]]
        want = []
        for q, query in enumerate(queries):
            for i in range(len(query) - 69):
                has = [k for k, s in enumerate(strings) if query[i : i + 70] in s]
                if has:
                    want.append((q, i, has[0]))
        assert list(zip(*(x.tolist() for x in index.matches(queries)), strict=True)) == want and want


def test_decontaminate(spark, docs, empty):
    items = [("a", "One two"), ("b", "word5 ünïcode35 " + " ".join(f"word{i} ünïcode{i * 7}" for i in range(6, 16))), ("c", None), ("d", "..."), (None, "three"), ("e", SHARED), ("f", "no such passage " * 6)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    for r, text in zip(sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id)), [x[1] for x in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0]))], strict=True):
        assert tuple(r)[1:] == brute.contamination(text, [(i, t) for i, t in items if t])
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_a_passage_of_all_items_and_most_documents(spark):
    common = " ".join(f"common{i}" for i in range(20))
    items = [(f"i{i}", f"{common} own{i} " + " ".join(f"x{i}y{j}" for j in range(i % 30))) for i in range(300)]
    rows = [(i if i % 9 else None, f"start{i % 40} {common} {'own' + str(i % 400) if i % 2 else 'end'} {'tail ' * (i % 700)}" if i % 5 else "none of it") for i in range(1000)]
    bench, docs = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    verdict = {t: brute.contamination(t, items) for t in {t for _, t in rows}}
    want = sorted(((d, *verdict[t]) for d, t in rows), key=str)
    assert sorted(map(tuple, decontaminate.decontaminate(docs, bench).collect()), key=str) == want
    assert decontaminate.uncontaminated(docs, bench).count() == sum(not r[-1] for r in want) > 200


def test_bpe_matches_the_library(docs, empty):
    path = public_tokenizers.path(queries.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.tokenizer(open(path, "rb").read(), public_tokenizers.PATTERN)
    texts = [r.text or "" for r in docs.collect()] + ["z" * 700 + "\n" * 600, "<|endoftext|> ’’ 🙂🙂 ́̂", "ab" * 200, "abc" * 4000 + "cab" * 3000, " " * 9001 + "é" * 3001]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == library.encode_ordinary(text) and own.decode(ids) == text.encode()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert rows_of(bpe.round_trip(docs, path, public_tokenizers.PATTERN)) == sorted(want, key=lambda r: (r[0] is not None, r))
    assert bpe.encoded(empty, path, public_tokenizers.PATTERN).count() == 0


def test_texts_are_taken_together_by_length():
    texts = ["a", "b" * 5, "", "c", "dd", ""]
    assert list(bpe.together(texts, 3)) == [["a", "b" * 5], ["", "c", "dd"], [""]]
    assert list(bpe.together([], 3)) == []


def test_quality_counts(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = rows_of(quality_rules.judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert got == sorted(((r.doc_id, *brute.quality_counts(r.text)) for r in docs.collect()), key=lambda r: (r[0] is not None, r))
    assert quality_rules.judged(empty, labels).count() == 0


def test_binomial_tail_is_exact(spark):
    from math import comb

    for n, k, p in ((50, 0, 0.02), (300, 4, 0.02), (20, 20, 0.3)):
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert abs(got - sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))) < 1e-9


def test_binomial_tail_of_many_rows(spark):
    from math import erf, exp, lgamma, log, sqrt

    def tail(k, n, p):
        return sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log(1 - p)) for j in range(k + 1))

    def ours(k, n, p):
        rows = spark.createDataFrame([(k, n)], "k long, n long")
        return rows.select(quality_rules.binomial_tail(F.col("k"), F.col("n"), p)).first()[0]

    for n, k in ((40, 16), (40, 1), (17, 16), (5_000, 70), (5_000, 130), (100_000, 1_900), (100_000, 2_400), (3, 3), (0, 0)):
        assert abs(ours(k, n, 0.02) / tail(k, n, 0.02) - 1) < 1e-7
    n, k, p = 400_000_000, 7_995_000, 0.02  # laying out k numbers would not end
    z = (k + 0.5 - n * p) / sqrt(n * p * (1 - p))
    assert abs(ours(k, n, p) / (0.5 * (1 + erf(z / sqrt(2)))) - 1) < 0.01


def test_simhash_cells_of_many_fingerprints_are_dealt_again(spark):
    rng = np.random.default_rng(5)
    low = rng.integers(0, 1 << 40, 600).astype(np.int64)
    near = low[:200] ^ (1 << rng.integers(0, 40, 200)) ^ (1 << rng.integers(0, 40, 200))  # the upper bits of all are equal
    prints = np.unique(np.r_[low, near]).astype(np.uint64)
    nodes = spark.createDataFrame([(int(x),) for x in prints], "fp long")
    for cell_rows in (100, 3):
        found = {r.node: r.root for r in simhash.components(simhash.links(nodes, 4, cell_rows)).collect()}
        root = {int(x): int(x) for x in prints}
        close = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
        for _ in range(10):
            for a, b in close.tolist():
                a, b = int(prints[a]), int(prints[b])
                root[a] = root[b] = min(root[a], root[b])
        assert found == {x: r for x, r in root.items() if x != r}


def test_certified_cutoffs_reject_few_good_texts(spark):
    rows = [(i, " ".join(f"w{i * j}" for j in range(60)) if i % 4 else " ".join(f"x{i * j}%%%" for j in range(60)), "en") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(2000)], "doc_id long, quality int")
    got = quality_rules.judged(docs, labels).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((0, True), 0) == 0 and n.get((1, False), 0) <= 0.02 * sum(v for (q, _), v in n.items() if q)


def test_sharding(docs, empty):
    got = sharding.sharded(docs, 4).collect()
    assert sorted(r.slot * 4 + r.shard for r in got) == list(range(len(got)))
    assert all(r.text_crc32 >= 0 and r.size >= 16 for r in got)
    numbers = np.arange(1003)
    places = sharding.permute(numbers, 1003, 9)
    assert sorted(places.tolist()) == numbers.tolist() and (sharding.invert(places, 1003, 9) == numbers).all() and not (places == numbers).all()
    by_number = {r.row_number: r.slot * 4 + r.shard for r in got}
    assert sharding.permute(np.arange(len(got)), len(got), 20260101).tolist() == [by_number[i] for i in range(len(got))]
    assert sharding.sharded(empty).count() == 0


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/ b\r\n", "<p>é</p>"), (2, None, None), (3, "u", ""), (5, "u", "<p>é</p>"), (4, "u", "<p>é</p>"), (4, "u", "<p>é</p>"), (None, "u", "z" * 3_000_000)], "page_id long, url string, html string")
    for size in (64 << 20, 100):
        got = rows_of(warc.round_trip(pages, size).drop("url"))
        sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
        want = [(None, 3_000_000, sha("z" * 3_000_000), "response", None), (1, 9, sha("<p>é</p>"), "response", None), (2, 0, sha(""), "response", None), (3, 0, sha(""), "revisit", 2), *[(4, 9, sha("<p>é</p>"), "revisit", 1)] * 2, (5, 9, sha("<p>é</p>"), "revisit", 1)]
        assert [tuple(r) for r in got] == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_index_is_that_of_its_sidecars(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}"
    index = warc.normalise(warc.write_archives(warc.with_revisits(pages), folder, 500), folder)
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, warc.sidecars(spark, folder).collect()))
    one = next(tmp_path.glob("*.idx")).read_text().splitlines()[0]
    (tmp_path / "lost.members.warc.gz.idx").write_text(one.replace('"archive": "', '"archive": "lost') + '\n{"archive": "cut')
    got = warc.read_records(index.repartition("archive"), folder)
    assert sorted(r.page_id for r in got.collect()) == list(range(20)) and index.select("archive").distinct().count() > 1


def test_inflate_needs_whole_streams():
    import io

    data = zlib.compressobj(6, wbits=31)
    raw = data.compress(b"x" * 1000) + data.flush()
    assert b"".join(warc.inflated(io.BytesIO(raw + raw))) == b"x" * 2000
    with pytest.raises(ValueError):
        list(warc.inflated(io.BytesIO(raw[:-9])))


def test_language_id(spark, docs, empty):
    model = language_id.fit(spark.createDataFrame([("the house and the tree", "en"), ("el árbol y la casa", "es"), (None, "en"), ("x", None)], "text string, lang string"))
    names, scores = model.predict(["the tree", "la casa", "thehouse", None, "", "123 !!", "árboles", "² ½"])
    assert names == ["en", "es", "en", "und", "und", "und", "es", "und"] and all(0 <= s <= 1 for s in scores)
    assert language_id.fit(empty).predict(["abc"]) == (["und"], [0.0])
    assert language_id.identified(docs, model).count() == docs.count() and language_id.identified(empty, model).count() == 0
    assert language_id.with_language(docs, model).count() == sum(bool(language_id._LETTERS.search(r.text or "")) for r in docs.collect())


def test_most_frequent_of_each_group(spark):
    rows = [(lang, f"w{i}", i % 7) for lang in "ab" for i in range(200)] + [("c", "x", 1)]
    table = spark.createDataFrame(rows, "lang string, word string, n long").repartition(3)
    for most in (1, 30, 150, 1000):
        got = [(r.lang, r.word, r.n) for r in language_id.most_frequent(table, ["lang"], "word", most, most < 100, 8).collect()]
        assert len(set(got)) == len(got) and set(got) <= set(rows)
        for lang in "abc":
            kept, every = ([r[2] for r in x if r[0] == lang] for x in (got, rows))
            assert sorted(kept, reverse=True) == sorted(every, reverse=True)[:most]


def test_every_link_shares_a_mask():
    rng = np.random.default_rng(2)
    for blocks in (6, 7, 8, 9):
        own = np.array(simhash.masks(blocks, 4), np.int64).view(np.uint64)
        for _ in range(200):
            a = rng.integers(0, 2**63, dtype=np.uint64)
            b = a ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, 4, replace=False)))
            assert ((a & own) == (b & own)).any()
    assert [simhash.best_blocks(n, 4) for n in (0, 10**5, 10**7, 10**10)] == sorted(simhash.best_blocks(n, 4) for n in (0, 10**5, 10**7, 10**10))


def test_class_lm(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(class_lm, "VOCABULARY", 1500)
    monkeypatch.setattr(class_lm, "SEEDS", 60)
    corpus = class_lm.prepared(docs, F.coalesce(F.col("doc_id") % 7 != 6, F.lit(True)))
    model = class_lm.fit(corpus)
    got = class_lm.scored(corpus, model).collect()
    assert len(got) == docs.count() and np.allclose((10**model.step).sum(axis=1), 1)
    words = {r.doc_id: [class_lm.key_of(w) for w in brute.lower(r.text).encode().split()] for r in docs.collect()}
    train = [class_lm.key_of(w) for r in docs.collect() if r.doc_id is None or r.doc_id % 7 != 6 for w in [*brute.lower(r.text).encode().split(), b"\n"]]
    counts, place = Counter(train), {w: i for i, w in enumerate(corpus.words)}
    assert len(place) == 1500 < len(counts) and place[b"\n"] < 60 and (corpus.tokens, corpus.types) == (len(train), len(counts))
    assert min(counts[w] for w in place) >= max(c for w, c in counts.items() if w not in place)
    for r in got:
        own, base, score, before = [*words[r.doc_id], b"\n"], 0.0, 0.0, model.classes[place[b"\n"]]
        for w in own:
            base += np.log10((counts[w] + 1) / (len(train) + len(counts) + 1))
            g = class_lm.group_of(w.decode())
            here = model.classes[place[w] if w in place else 1500 + g]
            score += model.step[before, here] + (model.share[place[w]] if w in place else np.log10(counts[w]) - model.whole[g] if counts[w] else model.unseen[g])
            before = here
        assert r.n_tokens == len(own) and r.n_known == sum(counts[w] > 0 for w in own) and r.train_tokens == len(train)
        assert np.allclose((r.base_score, r.score), (base, score))
    # what follows a class is a class, and a class's words and the unknown ones of its groups share it
    parts = np.bincount(model.classes, weights=np.r_[10**model.share * (corpus.frequency > 0), 10**model.unseen], minlength=class_lm.CLASSES)
    rest = np.bincount(model.classes[1500:], weights=np.bincount([class_lm.group_of(w.decode()) for w in counts if w not in place], weights=[c for w, c in counts.items() if w not in place], minlength=class_lm.GROUPS) / 10**model.whole, minlength=class_lm.CLASSES)
    assert np.allclose((parts + rest)[np.unique(model.classes)], 1, atol=1e-6)
    none = class_lm.prepared(docs, F.lit(False))
    assert all(r.n_known == 0 and r.score < 0 for r in class_lm.scored(none, class_lm.fit(none)).collect())
    nothing = class_lm.prepared(empty, F.lit(True))
    assert class_lm.scored(nothing, class_lm.fit(nothing)).count() == 0


def test_words_go_to_the_class_of_their_contexts(spark):
    """Each of two sorts of words stands only before words of its own; rare ones are no seeds, but their classes tell them apart."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        rare = f"{'ab'[i % 2]}rare{i % 40}"
        rows.append((i, " ".join(f"{'ab'[i % 2]}{rng.integers(600)} {'xy'[i % 2]}{rng.integers(5)}" for _ in range(60)) + f" {rare} {'xy'[i % 2]}0 {rare} {'xy'[i % 2]}1"))
    table = spark.createDataFrame(rows, "doc_id string, text string")
    corpus = class_lm.prepared(table, F.lit(True))
    model = class_lm.fit(corpus)
    classes = {s: {int(model.classes[i]) for i, w in enumerate(corpus.words) if i >= class_lm.SEEDS and w.startswith(s)} for s in (b"a", b"b")}
    assert classes[b"a"] and classes[b"b"] and not classes[b"a"] & classes[b"b"]
    scores = {r.doc_id: r for r in class_lm.scored(corpus, model).collect()}
    assert len(scores) == 400 and all(r.score > r.base_score for r in scores.values())


def test_pu_classifier(spark, docs, empty):
    rows = [(i, f"good plain words number {i} here " * 3 if i % 3 else f"B{i}!! $$$ %%% " * 9) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(600) if i % 3 and i % 2] + [(0, None)], "doc_id long, quality int")
    ready = pu_classifier.prepared(table, labels, F.col("doc_id") % 5 != 0)
    weights, prior = pu_classifier.fit(ready, 8, 15)
    got = pu_classifier.scored(ready, weights).collect()
    good, bad = [r.score for r in got if r.doc_id % 3], [r.score for r in got if not r.doc_id % 3]
    assert min(good) > max(bad) and 0.3 < prior < 0.95
    blank = pu_classifier.prepared(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in pu_classifier.scored(blank, pu_classifier.fit(blank, 2, 2)[0]).collect()} == {0.5}
    nothing = pu_classifier.prepared(empty, labels, F.lit(True))
    assert pu_classifier.scored(nothing, pu_classifier.fit(nothing, 1, 1)[0]).count() == 0


def test_groups_and_slices_are_bounded():
    import pyarrow as pa

    from lumenweave.llm.common import by_bytes, by_groups

    keys = [1] * 3 + [2] * 9 + [3, 4, 5, 6, 7, 7]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(part, pa.int64())}) for part in (keys[:4], [], keys[4:])]
    assert [t["k"].to_pylist() for t in by_groups(["k"], 4)(batches)] == [[1] * 3, [2] * 9, [3, 4, 5, 6], [7, 7]]
    assert list(by_groups(["k"], 4)([])) == []
    texts = pa.RecordBatch.from_pydict({"text": ["a", None, "é" * 500, "b", ""]})
    assert [b["text"].to_pylist() for b in by_bytes([texts, texts.slice(0, 0)], 200)] == [["a", None], ["é" * 500], ["b", ""]]

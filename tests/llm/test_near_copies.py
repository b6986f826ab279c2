"""The pipeline's near copies against all pairs, over planted copies of Jaccard just above and below 0.8."""

import numpy as np
import pytest
import xxhash

from lumenweave.llm import near_copies, simhash


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def smallest(rows):
    """The smallest id reachable from each row by pairs of Jaccard 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    least = {}
    for (doc_id, _), r in zip(rows, root, strict=True):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return [least.get(r) for r in root]


@pytest.fixture(scope="module")
def planted():
    rng, texts = np.random.default_rng(3), [None, "", " \n", "one two three", "ONE two three", "12 34"]
    for i in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 60 + 10 * i)]
        texts.append(" ".join(words))
        for _ in range(3):  # each word put in takes away five shingles at most
            copy = list(words)
            for at in rng.choice(len(words), max(1, round(len(words) * rng.uniform(0.005, 0.035))), replace=False):
                copy[at] = f"new{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    return [(i if i % 17 else None, t) for i, t in enumerate(texts)]


def test_near_copies_match_all_pairs(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string").repartition(3)
    want = sorted(zip([d for d, _ in planted], smallest(planted), strict=True), key=str)
    assert sum(d is not None and d != c for d, c in want) > 30
    for cell_size in (4_000_000, 300):
        assert sorted(((r.doc_id, r.component_id) for r in near_copies.near_copies(docs, cell_size).collect()), key=str) == want
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_pipeline_keeps_one_of_near_copies(spark, planted):
    import corpus_pipeline

    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in planted], "doc_id long, text string, n_chars long")
    want = sorted(d for (d, _), c in zip(planted, smallest(planted), strict=True) if d is not None and d == c)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").where("doc_id IS NOT NULL").collect()) == want


def test_pipeline_decides_by_id_and_text(spark, tmp_path):
    import corpus_pipeline

    text, other, third = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    schema = "doc_id long, text string, th string"
    docs = spark.createDataFrame([(None, text, "x"), (None, text, "x"), (7, other, "x"), (7, third, "x"), (8, third, "x"), (None, third, "x")], schema)
    rows = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(None, text, "x"), (7, other, "x"), (7, third, "x")], key=str)
    spark.createDataFrame([("i", text), ("j", third)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.benchmark(spark, docs, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [(7, other, "x")]


def test_fingerprints_link_what_no_band_does(spark):
    """In a long text, one word of a least hash in every band is another one: no band is equal, few bits differ."""
    words = [f"w{x}" for x in np.random.default_rng(5).integers(0, 10**6, 12_000)]
    digests = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(len(words) - 4)], np.uint64)
    copy = list(words)
    for band in range(near_copies.BANDS):
        least = int((digests * near_copies._ODD[4 * band] + near_copies._ADD[4 * band]).argmin())
        copy[least + 2] = f"new{band}"
    a, b = (near_copies.shingles(" ".join(x)) for x in (words, copy))
    assert 0.95 < len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 1
    assert not (near_copies.bands(a) == near_copies.bands(b)).any()
    assert (near_copies.fingerprint(a) ^ near_copies.fingerprint(b)).bit_count() <= near_copies.RADIUS
    rows = [(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(reversed(words))), (4, ""), (5, None)]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)]


def test_fingerprint_is_that_of_the_operator():
    text = " ".join(f"w{i}" for i in range(300))
    assert near_copies.fingerprint(near_copies.shingles(text)) == simhash.fingerprint(text, 5, 0)
    assert near_copies.fingerprint(near_copies.shingles("")) == 0


def test_forest_connects_what_all_pairs_do():
    rng = np.random.default_rng(4)
    base = [rng.choice(10**6, 80, replace=False) for _ in range(3)]
    sets = [np.unique(np.where(rng.random(80) < rng.uniform(0, 0.2), rng.integers(10**6, 10**7, 80), base[i % 3])).astype(np.uint64) for i in range(90)]
    root = list(range(90))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    got = list(range(90))
    for i, j in near_copies.forest(sets):
        old, new = max(got[i], got[j]), min(got[i], got[j])
        got = [new if x == old else x for x in got]
    assert got == root and len(set(root)) > 3

"""Exchange clustering against the likelihood computed anew for every move, and long words."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from lumenweave.llm import class_lm


def whole(counts, own, classes):
    table = np.zeros((classes, classes))
    for (a, b), n in np.ndenumerate(counts):
        table[own[a], own[b]] += n
    return class_lm.likelihood(table)


def test_exchange_moves_every_element_to_its_best_class():
    rng = np.random.default_rng(4)
    counts = (rng.random((14, 14)) ** 6 * 60).astype(int).astype(float)
    classes, own = 4, np.arange(14) % 4
    weight, seen = counts.sum(axis=1), counts.sum(axis=0)
    for _ in range(12):
        moved = 0
        for w in np.argsort(-weight, kind="stable"):
            if not weight[w] and not seen[w]:
                continue
            values = [whole(counts, np.r_[own[:w], c, own[w + 1 :]], classes) for c in range(classes)]
            best = int(np.argmax(values))
            if values[best] > values[own[w]] + 1e-9:
                own = np.r_[own[:w], best, own[w + 1 :]]
                moved += 1
        if not moved:
            break
    got = class_lm.exchanged(counts, classes)
    assert whole(counts, got, classes) >= whole(counts, own, classes) - 1e-6
    for w in range(14):
        assert all(whole(counts, np.r_[got[:w], c, got[w + 1 :]], classes) <= whole(counts, got, classes) + 1e-6 for c in range(classes))


def test_best_classes_gain_what_the_likelihood_does():
    rng = np.random.default_rng(6)
    classes, words = 5, 20
    counts = (rng.random((words, words)) ** 5 * 40).astype(int).astype(float)
    np.fill_diagonal(counts, 0)
    own = rng.integers(classes, size=words)
    one = np.eye(classes)[own]
    table = one.T @ counts @ one
    best, gain = class_lm.best_classes(table, counts.T @ one, counts @ one, own)
    for w in range(words):
        values = [whole(counts, np.r_[own[:w], c, own[w + 1 :]], classes) for c in range(classes)]
        assert math.isclose(values[best[w]], max(values), rel_tol=1e-9) and math.isclose(gain[w], max(values) - values[own[w]], abs_tol=1e-6)


def test_rounds_raise_the_likelihood(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(class_lm, "SEEDS", 200)
    monkeypatch.setattr(class_lm, "TRIES", 10)  # few tokens tell little of many words, so that most moves together are wrong
    monkeypatch.setattr(class_lm, "SETTLED", 0.0)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    corpus = class_lm.prepared(docs, F.col("doc_id") % 7 != 2)
    model = class_lm.fit(corpus)
    assert len(model.likelihoods) > 1 and all(b > a for a, b in zip(model.likelihoods, model.likelihoods[1:], strict=False))
    assert len(set(model.classes.tolist())) > 10


def test_long_words_are_words(spark):
    long = "http://example.org/" + "x" * 100
    other = "=" * 300
    docs = spark.createDataFrame([(i, f"see {long} and {other} now") for i in range(60)] + [(99, f"{long} {'y' * 80}")], "doc_id long, text string")
    corpus = class_lm.prepared(docs, F.col("doc_id") < 99)
    assert b"\n" + hashlib.sha1(long.encode()).hexdigest().encode() in corpus.words and all(len(w) <= 64 for w in corpus.words)
    got = {r.doc_id: r for r in class_lm.scored(corpus, class_lm.fit(corpus)).collect()}
    assert got[99].n_known == 2 and got[99].n_tokens == 3 and got[0].n_known == 6
    total, types = 60 * 6, 6
    assert math.isclose(got[99].base_score, sum(math.log10((c + 1) / (total + types + 1)) for c in (60, 0, 60)), rel_tol=1e-9)

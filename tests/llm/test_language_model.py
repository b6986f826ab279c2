"""The model of language identification against plain counts, where its bounds cut the languages' lists apart."""

import math
from collections import Counter

import numpy as np
import pytest

from lumenweave.llm import language_id

SCHEMA = "text string, lang string"


def value(table, hashed, lang):
    """A key's log frequency in a language, or None where the model doesn't have the key."""
    at = table.found(np.array([hashed], np.uint64))[0]
    if at < 0:
        return None
    own = dict(zip(table.langs[table.ends[at] : table.ends[at + 1]].tolist(), table.values[table.ends[at] : table.ends[at + 1]].tolist(), strict=True))
    return table.floor + own.get(lang, 0.0)


def of_word(model, word, lang):
    return value(model.words, language_id.word_hashes([word])[0], lang)


def of_gram(model, gram, lang):
    return value(model.grams[len(gram)], language_id.gram_hashes(language_id._numbers(gram), len(gram))[0], lang)


def test_every_language_s_own_count_is_scored(spark):
    rows = [("aaaa " * 5 + "bbbb " * 3, "en"), ("bbbb " * 4 + "cccc", "es")]
    model = language_id.fit(spark.createDataFrame(rows, SCHEMA), most_words=1, most_grams=1)
    assert of_word(model, "cccc", 0) is None and np.isclose(of_word(model, "aaaa", 1), math.log(0.5 / 8), rtol=1e-6)
    assert np.allclose([of_word(model, "bbbb", i) for i in range(2)], [math.log(3 / 8), math.log(4 / 5)])
    for n in language_id.LENGTHS:
        counts = [Counter(p[j : j + n] for w in text.split() for p in [f" {w} "] for j in range(len(p) - n + 1)) for text, _ in rows]
        for c in counts:
            c.pop(" ", None)
        both = [g for g in counts[0] if g in counts[1] and of_gram(model, g, 0) is not None]
        for gram in both:
            assert np.allclose([of_gram(model, gram, i) for i in range(2)], [math.log(c[gram] / c.total()) for c in counts]), gram
        assert both or n == 5


def test_scores_equal_a_plain_model(spark, sf_dir):
    """Counts, back-off and scores of all texts, where the model's lists are long enough for everything."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    letters = lambda t: language_id._LETTERS.findall((t or "").lower())
    words, grams = {}, {}
    for r in rows:
        if r.lang is not None and r.text is not None and r.doc_id % 3:
            words.setdefault(r.lang, Counter()).update(letters(r.text))
    langs = sorted(x for x in words if words[x])
    for x in langs:
        grams[x] = {n: Counter() for n in language_id.LENGTHS}
        for w, k in words[x].items():
            for n in language_id.LENGTHS:
                for j in range(len(w) + 3 - n):
                    if f" {w} "[j : j + n] != " ":
                        grams[x][n][f" {w} "[j : j + n]] += k
    floor = math.log(0.5 / max(c.total() for c in words.values()))
    low = {n: math.log(0.5 / max(grams[x][n].total() for x in langs)) for n in language_id.LENGTHS}
    every = {w for c in words.values() for w in c if len(w) <= language_id.MAX_LETTERS}
    kept = {n: {g for x in langs for g in grams[x][n]} for n in language_id.LENGTHS}

    def score(w):
        if w in every:
            return [math.log(words[x][w] / words[x].total()) if words[x][w] else floor for x in langs]
        for n in language_id.LENGTHS:
            found = [g for j in range(len(w) + 3 - n) if (g := f" {w} "[j : j + n]) in kept[n]]
            if found:
                return [sum(math.log(grams[x][n][g] / grams[x][n].total()) if grams[x][n][g] else low[n] for g in found) / len(found) for x in langs]
        return [0.0] * len(langs)

    model = language_id.fit(docs.where("doc_id % 3 <> 0"), 10**6, 10**6)
    got = {r.doc_id: r for r in language_id.identified(docs, model).collect()}
    for r in rows:
        found = letters(r.text)
        if not any(map(language_id.has_letter, found)):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        total = np.sum([score(w) for w in found], axis=0)
        even = np.exp((total - total.max()) * min(1.0, 10 / len(found)))
        assert got[r.doc_id].lang_pred == langs[int(total.argmax())] and np.isclose(got[r.doc_id].score, even.max() / even.sum(), rtol=1e-3)


def test_languages_without_counts_and_long_runs(spark):
    run = "天地玄黃宇宙洪荒日月盈昃辰宿列張" * 5
    rows = [("the house and the tree are here", "en"), ("el árbol y la casa", "es"), ("12 34 !!", "xx"), ("", "yy"), ("a b", "zz"), (run, "zh")]
    model = language_id.fit(spark.createDataFrame(rows, SCHEMA))
    assert model.langs == ["en", "es", "zh", "zz"]
    names, _ = model.predict(["the house", "la casa", run, run[:20], "houses", "b a", "qqqqqqqqq"])
    assert names[:6] == ["en", "es", "zh", "zh", "en", "zz"]
    for n in language_id.LENGTHS:
        padded = f" {run} "
        counts = Counter(padded[j : j + n] for j in range(len(padded) - n + 1))
        counts.pop(" ", None)
        for gram, c in counts.items():
            assert np.isclose(of_gram(model, gram, 2), math.log(c / counts.total()), rtol=1e-5)


def test_no_language_is_left_out(spark):
    def word(i):
        return "".join(chr(0x4E00 + 7 * i + j) for j in range(3))

    model = language_id.fit(spark.createDataFrame([(word(i), f"l{i:03}") for i in range(70)], SCHEMA))
    assert model.predict([word(i) for i in range(70)])[0] == [f"l{i:03}" for i in range(70)]


def test_a_model_too_large_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_BYTES", 100)
    with pytest.raises(ValueError):
        language_id.fit(spark.createDataFrame([("the house and the tree", "en")], SCHEMA))


def test_rows_are_made_anew_when_there_are_many(spark):
    model = language_id.fit(spark.createDataFrame([("the house and the tree", "en"), ("la casa y el arbol", "es")], SCHEMA))
    cache = language_id.Rows(model)
    cache.most = 3
    texts = ["the tree and another house of the old town", "el arbol de la otra casa", "qq ww ee rr tt yy uu the"]
    assert model.predict(texts, cache) == model.predict(texts) and len(cache) <= 6

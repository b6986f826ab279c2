"""Licences in texts, by diagonal voting; DataFrame operations only.

Every text is cut into words once, as a written table. All its rolling word k-grams are hashed and joined to the places of the templates' k-grams. A hit votes for its diagonal, the
text's place less the template's; the votes of a text, template and diagonal are added up before and after the shuffle (a diagonal has no more places than the template has words). Diagonals
of a template that lie within its ``drift`` (an eighth of its words, four at most: inserted and missing words) of one another are merged into one span. A span is verified by
the words that its hits cover: their share of the span or the template, the longer of both, must reach what the template asks for.

Templates are of two kinds: phrases and statements up to ``SHORT`` words, by 2-grams, whose words must all stand there, and longer notices, by 5-grams, with a share of
0.8 or more. Among the phrases are the base ones, whose places are counted.

Defined cases: null and wordless texts have no words and no labels; templates of fewer words than two are an error; a place that several templates share has all their labels; repeated rows are
scanned each for itself, whatever their ids; very long texts are one row, as eight bytes a k-gram; an empty table gives no rows; other columns, whatever their names, are not read.
Equal 64-bit hashes count as equal k-grams: among 10^13 words and a thousand k-grams of templates, one is wrong with a chance of 1 in 2,000.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.llm.common import lowered, written

#: What parts words, and the base phrases.
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Common statements and notices of licences, as their publishers word them.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl-3.0", "GNU Affero General Public License"),
    ("mpl-2.0", "Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "Mozilla Public License, version 2.0."),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-nd", "CC BY-ND"),
    ("cc-by-sa", "CC BY-SA"),
    ("cc0", "CC0 1.0 Universal"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the “Software”), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]
SHORT, SHARE, MOST_GRAMS = 8, 0.8, 100_000


def words_of(text: str) -> list[str]:
    return [w for w in re.split(PARTING, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def numbered(base: dict[str, str], templates: list[tuple[str, str]]) -> list[tuple[int, str, bool, int, int, list[str]]]:
    """number, label, base, words of a gram, drift, words of each template."""
    rows = [(label, True, words_of(phrase)) for phrase, label in base.items()] + [(label, False, words_of(text)) for label, text in templates]
    if any(len(w) < 2 for _, _, w in rows):
        raise ValueError("templates of two words or more")
    return [(i, label, own, 2 if own or len(w) <= SHORT else 5, 0 if own or len(w) <= SHORT else min(4, len(w) // 8), w) for i, (label, own, w) in enumerate(rows)]


def _gram(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(words, i + j) for j in range(k)))


def _grams(words: Column, k: int) -> Column:
    """Hashes of all k-grams, in order."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: _gram(words, i, k))).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession, templates: list[tuple[int, str, bool, int, int, list[str]]], k: int) -> DataFrame:
    """gram, template, at: the places of the k-grams of the templates that are told by k-grams of this size."""
    rows = F.array(*(F.struct(F.lit(i).alias("template"), F.array(*map(F.lit, words)).alias("words")) for i, _, _, size, _, words in templates if size == k))
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.template", F.posexplode(_grams(F.col("t.words"), k)).alias("at", "gram"))


def cut(docs: DataFrame) -> DataFrame:
    """uid, doc_id and words of every text; a written table, as a row's uid must not be given twice."""
    words = F.filter(F.split(lowered(F.col("text")), PARTING), lambda w: w != "")
    return written(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", words.alias("words")), "words")


def votes(texts: DataFrame, templates: list[tuple[int, str, bool, int, int, list[str]]], k: int) -> DataFrame:
    """uid, template, diagonal, places (sorted) of what the k-grams of the texts hit. Templates come in parts of a bounded number of k-grams, each of which is broadcast."""
    parts, held = [[]], 0
    for t in (t for t in templates if t[3] == k):
        held += len(t[5])
        if held > MOST_GRAMS and parts[-1]:
            parts.append([])
            held = len(t[5])
        parts[-1].append(t)
    places = texts.select("uid", F.posexplode(_grams(F.col("words"), k)).alias("place", "gram"))
    hits = None
    for part in parts:
        found = places.join(F.broadcast(template_grams(texts.sparkSession, part, k)), "gram").select("uid", "template", (F.col("place") - F.col("at")).alias("diagonal"), "place")
        hits = found if hits is None else hits.unionByName(found)
    return hits.groupBy("uid", "template", "diagonal").agg(F.sort_array(F.collect_list("place")).alias("places"))


def spans(texts: DataFrame, templates: list[tuple[int, str, bool, int, int, list[str]]]) -> DataFrame:
    """uid, label, base, start, stop (in words), share, verified: every merged span, and the share of the span or its template that its hits cover."""
    told = None
    for k in sorted({t[3] for t in templates}):
        found = votes(texts, templates, k)
        beside = F.transform("places", lambda p, i: F.least(F.lit(k), F.coalesce(F.get("places", i + 1) - p, F.lit(k))))
        covered = F.aggregate(beside, F.lit(0), lambda a, v: a + v)
        rows = found.select("uid", "template", "diagonal", covered.alias("covered"), F.element_at("places", 1).alias("start"), (F.element_at("places", -1) + k).alias("stop"))
        told = rows if told is None else told.unionByName(rows)
    about = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(SHARE if k > 2 else 1.0).alias("asked"), F.lit(drift).alias("drift"), F.lit(len(w)).alias("size")) for _, label, base, k, drift, w in templates))
    told = told.withColumn("about", F.get(about, F.col("template")))
    line = Window.partitionBy("uid", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > F.col("about.drift"), F.lit(True))
    told = told.withColumn("apart", apart).withColumn("span", F.sum(F.col("apart").cast("int")).over(line))
    merged = told.groupBy("uid", "template", "span").agg(F.first("about").alias("about"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("covered").alias("covered"))
    share = F.least(F.lit(1.0), F.col("covered") / F.greatest("about.size", F.col("stop") - F.col("start")))
    merged = merged.withColumn("share", share)
    return merged.select("uid", "about.label", "about.base", "start", "stop", "share", (F.col("share") >= F.col("about.asked")).alias("verified"))


def scanned(docs: DataFrame, base: dict[str, str] = BASE, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a template that was found)."""
    texts = cut(docs)
    found = spans(texts, numbered(base, templates))
    place = F.col("base") & F.col("verified")
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    of = found.groupBy("uid").agg(
        F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        names(place).alias("base_labels"), names(F.col("verified")).alias("labels"), F.max("share").alias("score"),
    )
    rows = texts.select("uid", "doc_id", F.size("words").cast("long").alias("n_words")).join(of, "uid", "left")
    filled = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return rows.select("doc_id", "n_words", *(F.coalesce(c, filled[c]).alias(c) if c in filled else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")))

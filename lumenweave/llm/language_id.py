"""Language identification: known words first, then ever shorter character n-grams.

Training counts the lower-cased words (runs of letters) of every labelled text by language, and from these counts all character n-grams of the
words. The model keeps the words and n-grams of each length that are among the most frequent of some language, with their counts
in every language that has them. A word in the model adds its log frequency in each language; another word backs off to its longest n-grams that the model has, with
the mean of their log frequencies.

The model is sorted 64-bit hashes of its keys with lists of languages and values, as most keys are of few languages; tasks score dense rows of words, which they keep for a
while. A language adds ``most_words`` words and five times ``most_grams`` n-grams at most, whatever the number of languages: some 1 MB, all of which is broadcast; ``MOST_BYTES`` is
the most that is, and a model beyond is an error that asks for shorter lists.

Defined cases: null, empty and letterless texts are ``und`` with score 0; with no training text every text is; equal sums go to the
language that comes first by name; rows with null ``lang`` are not learned from, and a language whose texts have no letter is not learned. Runs above
``MAX_LETTERS`` are no words of the model, but their n-grams are learned and looked up as all others'. Repeated rows are learned from and predicted each for itself, whatever
their ids; an empty table gives no rows; very long texts are held one at a time, and other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.llm.common import by_bytes, written

#: Words a language, and n-grams a language and length, that the model keeps; characters a word of the model at most; what may be broadcast.
MOST_WORDS, MOST_GRAMS, MAX_LETTERS, MOST_BYTES = 20_000, 5_000, 40, 1 << 30
LENGTHS = (5, 4, 3, 2, 1)
_LETTERS = re.compile(r"[^\W\d_]+")
#: Numbers in the rows of words that a task keeps.
CACHE_NUMBERS = 1 << 20
FEW_LANGS = 10_000


def has_letter(word: str) -> bool:
    """Runs of ``_LETTERS`` may also be of numerals such as superscripts alone."""
    return any(map(str.isalpha, word))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def gram_hashes(letters: np.ndarray, n: int) -> np.ndarray:
    """Of every n letters in a row, given as numbers."""
    h = np.zeros(max(0, len(letters) - n + 1), np.uint64)
    for i in range(n):
        h = (h + letters[i : i + len(h)].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _numbers(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Table:
    """Values of keys by language: the sorted hashes of the keys, where each one's values begin, the values' languages, and what they are above the floor of all others."""

    keys: np.ndarray
    ends: np.ndarray
    langs: np.ndarray
    values: np.ndarray
    floor: float

    @classmethod
    def of(cls, hashes: np.ndarray, langs: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> Table:
        """Log frequencies; half a count of the largest total where a language has none, which is below all real frequencies whatever the languages' sizes."""
        floor = math.log(0.5 / totals.max()) if len(totals) else 0.0
        order = np.lexsort((langs, hashes))
        keys, first = np.unique(hashes[order], return_index=True)
        values = np.log(counts.astype(np.float64) / totals) - floor
        return cls(keys, np.r_[first, len(order)].astype(np.int64), langs[order].astype(np.int32), values[order].astype(np.float32), floor)

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the keys, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def added(self, rows: np.ndarray, keys: np.ndarray, out: np.ndarray) -> None:
        """Adds the values of the keys, above the floor, to these rows of ``out``."""
        sizes = self.ends[keys + 1] - self.ends[keys]
        places = np.arange(sizes.sum()) + np.repeat(self.ends[keys] - np.cumsum(sizes) + sizes, sizes)
        cells = np.repeat(rows, sizes) * out.shape[1] + self.langs[places]
        out += np.bincount(cells, weights=self.values[places], minlength=out.size).reshape(out.shape)

    def size(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.ends, self.langs, self.values))


class Rows(dict):
    """Numbers of words' rows in a task. New words are numbered as they are met, and the rows of all new ones are made together."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.table = np.zeros((0, len(model.langs)), np.float32)
        self.new: list[str] = []
        self.most = max(1_000, CACHE_NUMBERS // max(1, len(model.langs)))

    def __missing__(self, word: str) -> int:
        number = len(self.table) + len(self.new)
        self.new.append(word)
        if len(word) <= MAX_LETTERS:  # longer ones are too large to be kept
            self[word] = number
        return number

    def of(self, words: list[str]) -> np.ndarray:
        """Rows of the words; no more than ``most`` of them."""
        if len(self.table) > self.most:
            self.clear()
            self.table = self.table[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.table = np.concatenate([self.table, self.model.scores(self.new)])
            self.new = []
        return self.table[at]


@dataclass
class Model:
    langs: list[str]
    words: Table
    grams: dict[int, Table]

    def scores(self, words: list[str]) -> np.ndarray:
        """A row a word, a column a language."""
        out = np.zeros((len(words), len(self.langs)))
        at = self.words.found(word_hashes(words))
        at[np.fromiter(map(len, words), np.int64, len(words)) > MAX_LETTERS] = -1
        known, left = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        self.words.added(known, at[known], out)
        out[known] += self.words.floor
        if len(left):
            out[left] = self.unseen([words[i] for i in left.tolist()])
        return out.astype(np.float32)

    def unseen(self, words: list[str]) -> np.ndarray:
        """The same of words that the model does not have, by their longest n-grams that it has."""
        out, open_ = np.zeros((len(words), len(self.langs))), np.ones(len(words), bool)
        letters = _numbers("".join(f" {w} " for w in words))
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        owner, after = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes)
        for n in LENGTHS:
            table = self.grams.get(n)
            if table is None or not open_.any():
                continue
            h = gram_hashes(letters, n)
            inside = np.flatnonzero(open_[owner[: len(h)]] & (np.arange(len(h)) + n <= after[: len(h)]))
            at = table.found(h[inside])
            inside, at = inside[at >= 0], at[at >= 0]
            rows, hits = owner[inside], np.bincount(owner[inside], minlength=len(words))
            sums = np.zeros_like(out)
            table.added(rows, at, sums)
            done = hits > 0
            out[done] = sums[done] / hits[done, None] + table.floor
            open_ &= ~done
        return out

    def predict(self, texts: list[str | None], cache: Rows | None = None) -> tuple[list[str], list[float]]:
        cache = Rows(self) if cache is None else cache
        found = [_LETTERS.findall(text.lower()) if text else [] for text in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total, owner = np.zeros((len(found), len(self.langs))), np.repeat(np.arange(len(found)), sizes)
        flat = [w for own in found for w in own]
        for i in range(0, len(flat) if self.langs else 0, cache.most):
            own = owner[i : i + cache.most]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total[own[first]] += np.add.reduceat(cache.of(flat[i : i + cache.most]), first, dtype=np.float64)
        names, scores = [], []
        for own, sums in zip(found, total, strict=True):
            if not self.langs or not any(map(has_letter, own)):
                names.append("und")
                scores.append(0.0)
                continue
            # a long text is no more than ten words' worth of independent evidence
            even = np.exp((sums - sums.max()) * min(1.0, 10 / len(own)))
            best = int(sums.argmax())
            names.append(self.langs[best])
            scores.append(float(even[best] / even.sum()))
        return names, scores


def most_frequent(counts: DataFrame, group: list[str], key: str, most: int, few: bool, buckets: int = 4096) -> DataFrame:
    """The ``most`` rows of ``counts`` with the largest ``n`` of each group, ties by a hash of ``key``. No task sorts a group's rows: a histogram of ``n`` gives the
    count from which on all stay, and a histogram of hash buckets how far into the rows of the next count. ``few``: the groups are known to be so few that a row of each is broadcast."""
    line = Window.partitionBy(*group)
    sums = counts.groupBy(*group, "n").agg(F.count("*").alias("rows"))
    upto = sums.withColumn("upto", F.sum("rows").over(line.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = upto.where(F.col("upto") > most).groupBy(*group).agg(F.min_by(F.struct(F.col("n").alias("edge"), (F.lit(most) - F.col("upto") + F.col("rows")).alias("room")), "upto").alias("e"))
    edge = edge.select(*group, "e.edge", "e.room")
    marked = counts.join(F.broadcast(edge) if few else edge, group, "left")
    sure = marked.where("edge IS NULL OR n > edge").select(*counts.columns)
    tied = marked.where("n = edge").withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    per = tied.groupBy(*group, "bucket").agg(F.count("*").alias("rows"))
    per = per.select(*group, "bucket", (F.sum("rows").over(line.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")).alias("before"))
    tied = tied.join(per, [*group, "bucket"]).where("before < room")
    place = F.row_number().over(Window.partitionBy(*group, "bucket").orderBy(key))
    return sure.unionByName(tied.withColumn("place", place).where("place <= room - before").select(*counts.columns))


def fit(train: DataFrame, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> Model:
    """A model from ``text`` and ``lang``. What reaches the driver is bounded by the lists' lengths and the number of languages."""
    train = train.where("text IS NOT NULL AND lang IS NOT NULL")
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    counts = train.select("lang", words.alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = written(counts, "words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    few, number = len(langs) <= FEW_LANGS, {x: i for i, x in enumerate(langs)}
    if not langs:
        return Model([], Table.of(*(np.zeros(0, kind) for kind in (np.uint64, np.int64, np.int64, np.float64))), {})
    short = F.char_length("word") <= MAX_LETTERS

    def with_totals(rows: DataFrame, key: str, totals: DataFrame, on: list[str]) -> pa.Table:
        return rows.join(F.broadcast(totals) if few else totals, on).select(key, *({"lang", *on}), "n", "total").toArrow()

    def columns(rows: pa.Table) -> list[np.ndarray]:
        langs_of = rows["lang"].combine_chunks().dictionary_encode() if rows.num_rows else None
        own = np.array([number[x] for x in langs_of.dictionary.to_pylist()], np.int64)[langs_of.indices.to_numpy()] if langs_of else np.zeros(0, np.int64)
        return [own, rows["n"].to_numpy(), rows["total"].to_numpy().astype(np.float64)]

    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = most_frequent(counts.where(short), ["lang"], "word", most_words, few).select("word").distinct()
    top = with_totals(counts.join(kept, "word", "left_semi"), "word", totals, ["lang"])
    known = Table.of(word_hashes(top["word"].to_pylist()), *columns(top))
    padded = F.concat(F.lit(" "), "word", F.lit(" "))

    def cut_to(n: int) -> Column:  # a second argument of the lambda would be the place in the array
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("word") + 3 - n)), lambda i: F.substring(padded, i, F.lit(n)))

    def cut_long(n: int) -> Column:  # pieces of 40 places and what the last n-gram has beyond them
        return F.transform(F.sequence(F.lit(1), F.least(F.lit(MAX_LETTERS), F.char_length("piece") + 1 - n)), lambda i: F.substring("piece", i, F.lit(n)))

    pieces = F.regexp_extract_all(padded, F.lit(f"(.{{1,{MAX_LETTERS}}})(?=(.{{0,{max(LENGTHS) - 1}}}))"), F.lit(1))
    beyond = F.regexp_extract_all(padded, F.lit(f"(.{{1,{MAX_LETTERS}}})(?=(.{{0,{max(LENGTHS) - 1}}}))"), F.lit(2))
    long = counts.where(~short).select("lang", "n", F.explode(F.zip_with(pieces, beyond, lambda a, b: F.concat(a, b))).alias("piece"))
    cut_pieces = [F.when(F.char_length("piece") >= n, cut_long(n)).otherwise(F.array().cast("array<string>")) for n in LENGTHS]
    cut = counts.where(short).select("lang", "n", F.explode(F.flatten(F.array(*map(cut_to, LENGTHS)))).alias("gram")).union(long.select("lang", "n", F.explode(F.flatten(F.array(*cut_pieces))).alias("gram")))
    grams = cut.where("gram <> ' '").groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("length", F.char_length("gram"))
    grams = written(grams, "grams")
    totals = grams.groupBy("lang", "length").agg(F.sum("n").alias("total"))
    kept = most_frequent(grams, ["lang", "length"], "gram", most_grams, few).select("gram").distinct()
    common = with_totals(grams.join(kept, "gram", "left_semi"), "gram", totals, ["lang", "length"])
    tables = {}
    for n in LENGTHS:
        own = common.filter(pa.compute.equal(common["length"], n))
        if own.num_rows:
            tables[n] = Table.of(gram_hashes(_numbers("".join(own["gram"].to_pylist())), n)[::n], *columns(own))
    size = known.size() + sum(t.size() for t in tables.values())
    if size > MOST_BYTES:
        raise ValueError(f"a model of {size >> 20} MB for {len(langs)} languages: ask for fewer than {most_words} words and {most_grams} n-grams a language")
    return Model(langs, known, tables)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cache = Rows(own)
        for batch in by_bytes(batches, 2 << 20):
            names, scores = own.predict(batch["text"].to_pylist(), cache)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "lang_pred": names, "score": pa.array(scores, pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text has a language of the model, with a score of ``least`` at least. A model of no language keeps texts with a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def has(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        cache = Rows(own)
        for texts in batches:
            if not own.langs:
                yield pd.Series([bool(t) and any(map(has_letter, _LETTERS.findall(t))) for t in texts], dtype=bool)
                continue
            sizes = np.cumsum(texts.str.len().fillna(0).to_numpy()) // (2 << 20)  # some megabytes of text at once
            said: list[bool] = []
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
                names, scores = own.predict(texts.iloc[part].tolist(), cache)
                said += [name != "und" and score >= least for name, score in zip(names, scores, strict=True)]
            yield pd.Series(said, dtype=bool)

    return docs.where(has("text"))
